"""Size budgets: the worst chain and the largest part of what is over."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.regions import segments


def worst_chain(chains: DataFrame, cap: int) -> DataFrame:
    """The one chain ``(id, chain_bytes)`` that is furthest over ``cap``; of equals the first id; none if all fit.

    One aggregate row per task, then one; nothing is ordered.
    """
    over = chains.filter(F.col("chain_bytes") > cap)
    best = over.groupBy().agg(F.min_by(F.struct("id", "chain_bytes"), F.struct((-F.col("chain_bytes")).alias("n"), "id")).alias("w"))
    return best.filter("w IS NOT NULL").select("w.*")


def largest_part(parts: DataFrame, key: str, size: str, order: str, *keep: str) -> DataFrame:
    """Per ``key`` the total and the largest part; the last of equals wins."""
    best = F.max_by(F.struct(order, size, *keep), F.struct(size, order)).alias("b")
    return parts.groupBy(key).agg(F.sum(size).alias("total"), best).select(key, "total", "b.*")


def file_parts(files: DataFrame, fence: str) -> DataFrame:
    """``path, ord, name, text``: the parts of each node file ``files(path, text)`` in order: block, generated regions, prose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, k, name, text) for path, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, (name, text) in enumerate(segments(whole or "", fence))]
            if rows:
                kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "ord", "name", "text"])

    return files.select("path", "text").mapInArrow(run, "path string, ord int, name string, text string")
