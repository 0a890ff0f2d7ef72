"""Keyed rows compared by digests of key ranges: only ranges that differ are read and compared key by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges on each of the two levels.
FAN = 64


def ranged(rows: DataFrame, fan: int = FAN) -> DataFrame:
    """``rows(part, key, value)`` with the range of their key: ``top`` and, within it, ``low``."""
    place = F.pmod(F.xxhash64("part", "key"), F.lit(fan * fan))
    return rows.select("part", "key", "value", F.floor(place / fan).cast("int").alias("top"), (place % fan).cast("int").alias("low"))


def range_digests(rows: DataFrame) -> DataFrame:
    """``top, low, n, one, two`` of ``ranged`` rows: how many there are, and sums of two hashes, in any order."""
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), "part", "key", "value").cast("decimal(38,0)"))
    return rows.groupBy("top", "low").agg(F.count("*").alias("n"), total(1).alias("one"), total(2).alias("two"))


def _unequal(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    sums = ["n", "one", "two"]
    both = old.join(new.withColumnsRenamed({c: f"{c}_" for c in sums}), keys, "full")
    same = F.lit(True)
    for c in sums:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    return both.filter(~same).select(*keys)


def differing_ranges(old: DataFrame, new: DataFrame) -> tuple[list[int], DataFrame]:
    """The first-level ranges whose ``range_digests`` differ (at most as many as there are), and all that differ as ``top, low``."""
    above = lambda d: d.groupBy("top").agg(*(F.sum(c).alias(c) for c in ("n", "one", "two")))
    tops = sorted(r.top for r in _unequal(above(old), above(new), ["top"]).collect())
    return tops, _unequal(old.filter(F.col("top").isin(tops)), new.filter(F.col("top").isin(tops)), ["top", "low"])


def changes(old: DataFrame, old_digests: DataFrame, new: DataFrame, new_digests: DataFrame) -> DataFrame:
    """``part, key, change`` (added, lost or changed) between two ``ranged`` tables.

    Where ``old`` is stored by ``top``, only the folders of ranges that differ are read.
    """
    tops, ranges = differing_ranges(old_digests, new_digests)
    few = lambda rows: rows.filter(F.col("top").isin(tops)).join(ranges, ["top", "low"], "left_semi").select("part", "key", "value")
    both = few(old).withColumn("was", F.lit(True)).join(few(new).select("part", "key", F.col("value").alias("value_"), F.lit(True).alias("is_")), ["part", "key"], "full")
    what = F.when(F.col("was").isNull(), "added").when(F.col("is_").isNull(), "lost").when(~F.col("value").eqNullSafe(F.col("value_")), "changed")
    return both.select("part", "key", what.alias("change")).filter("change IS NOT NULL")
