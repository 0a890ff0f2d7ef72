"""Positions told by the intervals around them, as one sweep per text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def inside(positions: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """``positions(keys, at, ...)`` with ``inside``: whether one of the ``intervals(keys, start, stop)`` holds the position.

    Intervals may nest and overlap; they hold their start and end before their stop. Both lie on one line
    per text, where the furthest stop seen so far tells of each position: intervals and positions are
    one row each, never pairs.
    """
    others = [c for c in positions.columns if c not in keys and c != "at"]
    points = positions.select(*keys, "at", F.lit(None).cast("long").alias("__stop"), F.struct(*others, F.lit(True).alias("__here")).alias("__row"))
    spans = intervals.select(*keys, F.col("start").cast(dict(positions.dtypes)["at"]).alias("at"), F.col("stop").cast("long").alias("__stop"), F.lit(None).cast(dict(points.dtypes)["__row"]).alias("__row"))
    upto = Window.partitionBy(*keys).orderBy("at", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = points.unionByName(spans).withColumn("__far", F.max("__stop").over(upto)).filter("__row IS NOT NULL")
    return swept.select(*keys, "at", *(F.col("__row")[c].alias(c) for c in others), F.coalesce(F.col("__far") > F.col("at"), F.lit(False)).alias("inside"))
