"""Tokens, comments and headings in text, and how often a slug is declared."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X


def lines_of(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep, line, content``: lines from 1, at most one trailing carriage return dropped."""
    return docs.select(*keep, F.posexplode(F.split(F.col(text), "\n", -1)).alias("__pos", "__raw")).select(
        *keep, (F.col("__pos") + 1).cast("int").alias("line"), F.regexp_replace("__raw", r"\r\z", "").alias("content")
    )


def payloads(line: Column, token: str) -> Column:
    """What follows each ``token`` (which ends in one space) up to the next white space of any script.

    Scanning goes on right after the token, so a payload may itself hold tokens.
    """
    return F.regexp_extract_all(line, F.lit(f"(?U){re.escape(token)}(?=(\\S+))"), 1)


def scan_tokens(docs: DataFrame, text: str, token: str, *keep: str) -> DataFrame:
    """``keep, line, slug`` of each token whose payload is a valid slug; others are prose."""
    hits = lines_of(docs.filter(F.col(text).contains(token)), text, *keep).filter(F.col("content").contains(token))
    return hits.select(*keep, "line", F.explode(payloads(F.col("content"), token)).alias("slug")).filter(X.is_valid_slug(F.col("slug")))


def landmark_winners(occurrences: DataFrame, *place: str) -> DataFrame:
    """``slug, n`` and the first place of each slug by the columns ``place``."""
    return occurrences.groupBy("slug").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("w")).select("slug", "n", "w.*")


def slug_cardinality(occurrences: DataFrame, used: DataFrame) -> DataFrame:
    """``slug, n`` of used slugs that more than one place declares; none at all is another rule's case."""
    return occurrences.groupBy("slug").agg(F.count("*").alias("n")).filter("n > 1").join(used.select("slug").distinct(), "slug", "left_semi")


def html_comments(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep, ord, line, comment`` of each complete comment, with the line on which it begins.

    Each comment's place is sought from the end of the one before.
    """
    found = docs.select(*keep, F.col(text).alias("__t"), F.regexp_extract_all(F.col(text), F.lit(r"(?s)<!--(.*?)-->"), 1).alias("__c"))
    starts = F.expr(
        "aggregate(__c, named_struct('at', 1, 'starts', cast(array() as array<int>)), (s, c) -> named_struct("
        "'at', locate('<!--', __t, s.at) + length(c) + 7, 'starts', concat(s.starts, array(locate('<!--', __t, s.at))))).starts"
    )
    placed = found.filter(F.size("__c") > 0).withColumn("__s", starts).select(*keep, "__t", "__s", F.posexplode("__c").alias("ord", "comment"))
    before = F.expr("substring(__t, 1, element_at(__s, ord + 1) - 1)")
    return placed.select(*keep, "ord", (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line"), "comment")


def slug_prefixes(headings: DataFrame) -> DataFrame:
    """``path, symbol, line``: each symbol that names a heading ``(path, slug, line)``: its slug, or what ends before one of its dashes."""
    words = F.split("slug", "-", -1)
    symbols = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), "-"))
    return headings.filter("slug <> ''").select("path", "line", F.explode(symbols).alias("symbol"))


def resolve_headings(headings: DataFrame, wanted: DataFrame) -> DataFrame:
    """``path, symbol, n, line``: headings ``(path, slug, line)`` that ``wanted(path, symbol)`` names.

    A heading fits if its slug is the symbol or begins with the symbol and a dash: an equi-join on
    the slugs' dash prefixes, counted first. ``n`` tells unresolved (0), resolved (1) and ambiguous
    (more) apart.
    """
    found = slug_prefixes(headings).groupBy("path", "symbol").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    return wanted.distinct().join(found, ["path", "symbol"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
