"""Churn of claims over a stream of changes: how many came after each claim's mark, as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def churn_stream(changes: DataFrame, marks: DataFrame, *, key: str, time: str, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """``window, key, n_later``: per time window the changes after each key's mark, duplicates by id once.

    ``changes(event_id, key, time)`` is a stream; ``marks(key, mark)`` a table that each micro-batch is
    joined with. The watermark bounds the state: of windows, and of ids seen. Changes later than
    ``late`` are dropped; a key without a mark has no churn.
    """
    once = changes.withWatermark(time, late).dropDuplicatesWithinWatermark(["event_id"])
    after = once.join(marks, key).filter(F.col(time) > F.col("mark"))
    return after.groupBy(F.window(time, window), key).agg(F.count("*").alias("n_later"))
