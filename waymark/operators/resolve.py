"""Lookups that classify by how many rows they find, rank candidates, or let the first declarer win."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X

#: Module extensions in the order in which they are probed, and what a compiled name stands for.
MODULE_EXTENSIONS = ("ts", "tsx", "js", "jsx", "cjs", "mjs", "mts", "cts")
COMPILED = ((".cjs", (".cts",)), (".js", (".ts", ".tsx")), (".jsx", (".tsx",)), (".mjs", (".mts",)))


def first_declarer(declarations: DataFrame, key: str, path: str, *keep: str) -> DataFrame:
    """One row per ``key``: the declaration whose path comes first, segment by segment."""
    best = F.min(F.struct(X.segments(F.col(path)).alias("__order"), F.struct(path, *keep).alias("d"))).alias("m")
    return declarations.filter(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, "m.d.*")


def by_cardinality(wanted: DataFrame, known: DataFrame, key: str | list[str], *place: str) -> DataFrame:
    """``wanted`` with ``n``, ``resolution`` (resolved, unresolved, ambiguous) and the one place found.

    ``known`` is counted per key before the join, so a frequent key costs one row.
    """
    counted = known.groupBy(*([key] if isinstance(key, str) else key)).agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("p"))
    joined = wanted.join(counted, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    state = F.when(F.col("n") == 1, "resolved").when(F.col("n") == 0, "unresolved").otherwise("ambiguous")
    return joined.withColumn("resolution", state).withColumns({c: F.when(F.col("n") == 1, F.col(f"p.{c}")) for c in place}).drop("p")


def module_candidates(target: Column) -> Column:
    """``(rank, path)`` of every file a module path may stand for, best first."""
    exact = [F.struct(F.lit(0).alias("rank"), target.alias("path"))]
    rank = 1
    for ending, sources in COMPILED:
        for source in sources:
            stem = F.substring(target, F.lit(1), F.length(target) - len(ending))
            exact.append(F.struct(F.lit(rank).alias("rank"), F.when(target.endswith(ending), F.concat(stem, F.lit(source))).alias("path")))
            rank += 1
    for form in (".{}", "/index.{}"):
        for ext in MODULE_EXTENSIONS:
            exact.append(F.struct(F.lit(rank).alias("rank"), F.concat(target, F.lit(form.format(ext))).alias("path")))
            rank += 1
    return F.array(*exact)


def probe(targets: DataFrame, files: DataFrame, candidates: Column, *, target: str = "target", path: str = "path") -> DataFrame:
    """``target, found``: for each distinct target its best candidate that is a file, or null."""
    asked = targets.select(target).distinct()
    exploded = asked.select(target, F.inline(candidates)).filter("path IS NOT NULL")
    hit = exploded.join(files.select(F.col(path).alias("path")).distinct(), "path").groupBy(target).agg(F.min_by("path", "rank").alias("found"))
    return asked.join(hit, target, "left")


def bare_specifiers(specifiers: DataFrame, packages: DataFrame) -> DataFrame:
    """``source, target``: what a bare module name points to; the first package that fits decides.

    ``packages(name, dir, main, ord)``: the name itself means the main file (or the directory's
    index), a longer path one below the directory. Names are found by an equi-join on the
    specifier's segment prefixes.
    """
    prefixes = specifiers.select("source").distinct().select("source", F.explode(X.ancestors(F.col("source"), root=False)).alias("name"))
    fit = prefixes.join(packages, "name").groupBy("source").agg(F.min_by(F.struct("name", "dir", "main"), "ord").alias("p"))
    rest = F.substring(F.col("source"), F.length("p.name") + 2, F.length("source"))
    target = F.when(F.col("source") == F.col("p.name"), F.coalesce("p.main", X.join_path(F.col("p.dir"), F.lit("index")))).otherwise(X.join_path(F.col("p.dir"), rest))
    return fit.select("source", target.alias("target"))


def claim_lookup(addresses: DataFrame, claims: DataFrame) -> DataFrame:
    """``address, outcome, node_id``: found, ambiguous or not-found for each distinct address.

    ``claims(node_id, slug)`` also lists every node (slug null where it has no claim). An address is
    ``<node id>/<slug>`` or, where that names exactly one node, ``<last segment>/<slug>``. A full id wins.
    """
    node_part = F.regexp_extract("address", r"(?s)\A(.*)/[^/]*\z", 1)
    asked = (
        addresses.select("address").distinct().filter(F.col("address").contains("/"))
        .withColumn("__node", F.when((node_part == "") & F.startswith("address", F.lit("/")), F.lit(X.SYSTEM_ID)).otherwise(node_part))
        .withColumn("__slug", F.substring_index("address", "/", -1))
    )
    nodes = claims.select("node_id").distinct()
    short = nodes.groupBy(X.last_segment(F.col("node_id")).alias("__node")).agg(F.count("*").alias("__n"), F.min("node_id").alias("__short"))
    full = nodes.select(F.col("node_id").alias("__node"), F.col("node_id").alias("__full"))
    placed = asked.join(full, "__node", "left").join(short, "__node", "left").withColumn("node_id", F.coalesce("__full", F.when(F.col("__n") == 1, F.col("__short"))))
    have = claims.filter("slug IS NOT NULL").select("node_id", F.col("slug").alias("__slug")).distinct().withColumn("__found", F.lit(True))
    done = placed.join(have, ["node_id", "__slug"], "left")
    outcome = F.when(F.col("__found"), "found").when(F.col("node_id").isNull() & (F.col("__n") > 1), "ambiguous").otherwise("not-found")
    found = done.select("address", outcome.alias("outcome"), F.when(F.col("__found"), F.col("node_id")).alias("node_id"))
    plain = addresses.select("address").distinct().filter(~F.col("address").contains("/")).select("address", F.lit("not-found").alias("outcome"), F.lit(None).cast("string").alias("node_id"))
    return found.unionByName(plain)


def containing(queries: DataFrame, nodes: DataFrame, *, gram: int = 3) -> DataFrame:
    """``query, id``: the ids of ``nodes(id)`` that contain a query's text, by an inverted index of their substrings.

    Ids are exploded to their distinct substrings of ``gram`` characters (of fewer for shorter queries). A
    query joins the ids of the one of its own substrings that the fewest ids have, and those are verified;
    a substring that no id has ends the search. An empty query finds nothing.
    """
    size = F.least(F.length("query"), F.lit(gram))
    asked = queries.select("query").distinct().filter("query <> ''").withColumn("__size", size)
    cut = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(F.col(c), i, n)))
    ids = nodes.select("id").distinct()
    index = None
    for n in range(1, gram + 1):
        of = ids.filter(F.length("id") >= n).select("id", F.explode(cut("id", F.lit(n))).alias("__gram"))
        index = of if index is None else index.unionByName(of)
    wanted = asked.select("query", F.explode(cut("query", F.col("__size"))).alias("__gram"))
    index = index.join(wanted.select("__gram").distinct(), "__gram", "left_semi")
    frequency = index.groupBy("__gram").agg(F.count("*").alias("__n"))
    rarest = wanted.join(frequency, "__gram", "left").groupBy("query").agg(F.min_by("__gram", F.coalesce("__n", F.lit(0))).alias("__gram"))
    return rarest.join(index, "__gram").filter(F.contains("id", F.col("query"))).select("query", "id")


def node_lookup(queries: DataFrame, nodes: DataFrame, *, most: int = 20) -> DataFrame:
    """``query, outcome, id, candidates`` for each distinct query: a node by its id, or by its last segment if one node ends so.

    ``nodes(id)``. Outcomes: found, ambiguous, unknown. ``candidates`` are the ids that an ambiguous
    query abbreviates, or, for an unknown one, the ids that contain it (all ids, where none does): the first
    ``most`` in order, as only a person reads them. All joins are on equal keys (see ``containing``).
    """
    asked = queries.select("query").distinct().withColumn("__norm", F.coalesce(X.normalize_id(F.col("query")), F.col("query")))
    full = nodes.select(F.col("id").alias("__norm"), F.col("id").alias("__full")).distinct()
    ends = nodes.select(X.last_segment(F.col("id")).alias("query"), "id").distinct()
    # At most a list's worth of ids per key meets in one place: the first ``most`` by order of each partial list.
    first = lambda c: F.slice(F.array_sort(F.collect_set(c)), 1, most)
    counted = ends.groupBy("query").agg(F.count("*").alias("__n"), F.min("id").alias("__only"))
    placed = asked.join(full, "__norm", "left").join(counted, "query", "left")
    outcome = F.when(F.col("__full").isNotNull() | (F.col("__n") == 1), "found").when(F.col("__n") > 1, "ambiguous").otherwise("unknown")
    done = placed.select("query", outcome.alias("outcome"), F.coalesce("__full", F.when(F.col("__n") == 1, F.col("__only"))).alias("id"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("id"))
    many = done.filter("outcome = 'ambiguous'").select("query").join(ends, "query").withColumn("__r", rank).filter(F.col("__r") <= most)
    lost = done.filter("outcome = 'unknown'").select("query")
    near = containing(lost, nodes).withColumn("__r", rank).filter(F.col("__r") <= most)
    listed = many.select("query", F.col("id").alias("__id")).unionByName(near.select("query", F.col("id").alias("__id"))).groupBy("query").agg(first("__id").alias("candidates"))
    every = F.array(*(F.lit(r.id) for r in nodes.select("id").distinct().orderBy("id").limit(most).collect())).cast("array<string>")
    others = F.when(F.col("outcome") == "unknown", every).otherwise(F.array().cast("array<string>"))
    return done.join(listed, "query", "left").withColumn("candidates", F.coalesce("candidates", others))


def short_addresses(claims: DataFrame) -> DataFrame:
    """``node_id, slug, address``: the last segment stands for a node where no other node ends so."""
    nodes = claims.select("node_id").distinct().withColumn("__last", X.last_segment(F.col("node_id")))
    unique = nodes.groupBy("__last").agg(F.count("*").alias("__n"))
    named = nodes.join(unique, "__last").select("node_id", F.when(F.col("__n") == 1, F.col("__last")).otherwise(F.col("node_id")).alias("__as"))
    return claims.join(named, "node_id").select("node_id", "slug", F.concat("__as", F.lit("/"), "slug").alias("address"))


def decision_references(tokens: DataFrame, records: DataFrame, prefix: str) -> DataFrame:
    """``token, n_refs, outcome``: ok, missing, superseded or duplicated for each distinct token.

    ``tokens(token)`` name a record of ``records(number, status, path)`` by its digits as text:
    ``7`` is not ``0007``. A number with several records is duplicated.
    """
    used = tokens.groupBy("token").agg(F.count("*").alias("n_refs")).withColumn("number", X.decision_number(F.col("token"), prefix))
    known = records.groupBy("number").agg(F.count("*").alias("__n"), F.bool_or(F.col("status") == "superseded").alias("__old"))
    outcome = F.when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "duplicated").when(F.col("__old"), "superseded").otherwise("ok")
    return used.join(known, "number", "left").select("token", "n_refs", outcome.alias("outcome"))


def decision_records(files: DataFrame, places: Sequence[str] = ("adr", "doc/adr", "docs/adr")) -> DataFrame:
    """``id, number, path`` of records ``<place>/<digits>-*.md``; only the first place that has any counts."""
    name = X.basename(F.col("path"))
    digits = F.when(name.contains("-"), F.regexp_extract(name, r"(?s)\A([0-9]+)-.*\.md\z", 1)).otherwise(F.lit(""))
    found = files.withColumn("__dir", X.parent_dir(F.col("path"))).withColumn("__digits", digits).filter((F.col("__digits") != "") & F.col("__dir").isin(*places))
    rank = F.array_position(F.array(*map(F.lit, places)), F.col("__dir"))
    best = found.agg(F.min(rank).alias("__best"))
    return found.withColumn("__rank", rank).join(F.broadcast(best), F.col("__rank") == F.col("__best")).select(
        F.concat_ws("/", "__dir", "__digits").alias("id"), F.col("__digits").alias("number"), "path"
    )


def record_status(text: Column) -> Column:
    """The status word of a record: from front matter, else inline, else below a Status heading; else ``unknown``."""
    front = F.regexp_extract(text, r"\A---[ \t]*\r?\n((?s:.*?))\n[ \t]*---[ \t]*\r?(?:\n|\z)", 1)
    in_front = F.regexp_extract(front, r"(?m)^[ \t]*status:(.*)$", 1)
    inline = F.regexp_extract(text, r"Status:([^\n]*)", 1)
    heading = F.regexp_extract(text, r"(?mi)^[ \t]*#+[ \t]*status[ \t]*\r?\n(?:[ \t]*\r?\n)*[ \t]*([^\s][^\n]*)", 1)
    return F.coalesce(X.status_word(in_front), X.status_word(inline), X.status_word(heading), F.lit("unknown"))
