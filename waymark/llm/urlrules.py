"""URL filters: a sort-merge range join of reversed-host keys with nested prefix rules."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Ends the host part of a key; sorts below every character that a host or a path may hold.
END = "\x01"


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    """``a.example.org`` as ``org.example.a``: a domain's subdomains share its prefix."""
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def _levels(host: Column, path: Column) -> Column:
    """One key for the host and for each of its parent domains, each followed by the path.

    In this key space a rule (host, path) is a plain prefix, so its range is one interval, and any
    two rules' intervals are nested or apart.
    """
    labels = F.reverse(F.split(host, r"\.", -1))
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit(END), path),
    )


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over sorted rows: rules (``kind`` 0) push, keys outside a rule's interval pop it."""
    stack: list[tuple[str, str, str, int]] = []
    schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("action", pa.string()), ("reach", pa.int64())])
    for batch in batches:
        col = batch.to_pydict()
        out: list[tuple] = []
        for key, kind, host, path, rule, action, reach in zip(*(col[c] for c in ("key", "kind", "host", "path", "rule", "action", "reach")), strict=True):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, rule, action, reach))
            elif stack:
                out.append((host, path, *stack[-1][1:]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule that fits each distinct ``(host, path)`` of ``urls``.

    ``rules(host, path, action)``: a rule fits its host and all subdomains if the url's path starts
    with its path. The longest ``host + path`` wins, of equally long ones the longer host; of one rule
    given with several actions the smallest. Urls and rules are put in one order of reversed-host keys, range
    partitioned, and swept once with a stack of the rules that are open. A range begins with the
    rules that earlier ranges left open: those whose key is a prefix of the range's first key, found
    by an equi-join of the first keys' prefixes (one key per range) with the rules. Neither side is
    broadcast whole or held in memory.

    Returns ``host, path, rule, action`` for matched urls only. Null or empty hosts match nothing;
    repeated rules and urls count once; no rules or no urls give no rows.
    """
    keyed_rules = (
        rules.filter(F.col("host").isNotNull() & (F.col("host") != "") & F.col("path").isNotNull())
        .groupBy("host", "path").agg(F.min("action").alias("action"))
        .select(
            F.concat(reversed_host(F.col("host")), F.lit(END), F.col("path")).alias("key"), F.lit(0).alias("kind"),
            F.col("host"), F.col("path"), F.concat("host", "path").alias("rule"), "action",
            (F.length(F.concat("host", "path")) * 65536 + F.least(F.length("host"), F.lit(65535))).cast("long").alias("reach"),
        )
    )
    keyed_urls = (
        urls.filter(F.col("host") != "").select("host", "path").distinct()
        .select("host", "path", F.explode(_levels(F.col("host"), F.col("path"))).alias("key"))
        .select("key", F.lit(1).alias("kind"), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action"), F.lit(None).cast("long").alias("reach"))
    )
    both = keyed_rules.unionByName(keyed_urls)
    ranged = materialize(both.repartitionByRange("key").withColumn("range", F.spark_partition_id()), "url-ranges")
    firsts = ranged.groupBy("range").agg(F.min("key").alias("first"))
    prefixes = firsts.select("range", "first", F.explode(F.expr("sequence(1, length(first))")).alias("n")).select("range", "first", F.expr("substring(first, 1, n)").alias("key"))
    open_before = (
        ranged.filter("kind = 0").drop("range").join(prefixes, "key").filter(F.col("key") < F.col("first"))
        .select("key", "kind", "host", "path", "rule", "action", "reach", "range")
    )
    swept = (
        ranged.unionByName(open_before).repartition("range").sortWithinPartitions("range", "key", "kind")
        .select("key", "kind", "host", "path", "rule", "action", "reach")
        .mapInArrow(_sweep, "host string, path string, rule string, action string, reach long")
    )
    best = F.max_by(F.struct("rule", "action"), "reach")
    return swept.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.action")


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, *, default: str = "allow", url_col: str = "url"
) -> DataFrame:
    """Judge every row of ``pages``: adds ``host, path, rule, verdict``.

    ``rules`` is a table ``(host, path, action)`` or a list of such tuples. Where none fits, ``rule``
    is null and ``verdict`` is ``default``. A url that is null or has no ``://`` has an empty host and
    path; such rows are set aside before the join, and the matches are written before it, so that
    Spark can split a frequent url. All rows stay, repeated ones too; columns of the same names are
    replaced.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, action string")
    judged = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))}).drop("rule", "verdict")
    found = match_rules(judged.select("host", "path"), rules)
    found = materialize(found.select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("rule").alias("__rule"), F.col("action").alias("__action")), "url-verdicts")
    named, bare = judged.filter(F.col("host") != ""), judged.filter(F.col("host") == "")
    joined = named.join(found.hint("merge"), (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")), "left")
    rule, verdict = F.col("__rule").alias("rule"), F.coalesce("__action", F.lit(default)).alias("verdict")
    columns = judged.columns
    return joined.select(*columns, rule, verdict).unionByName(bare.select(*columns, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))
