"""Helpers that the corpus operators share: tables in the shared folder, words, Arrow rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_root

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it again: lineage ends there.

    The rows survive lost executors, and several readers do not compute them twice.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/waymark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` made and no later step reads."""
    spark = df.sparkSession
    mine = f"{shared_root(spark)}/waymark/"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if mine.rsplit(":", 1)[-1].lstrip("/") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def text_bytes(name: str = "text") -> Column:
    """The text as UTF-8 bytes, empty where it is null."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text's bytes."""
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")


def rows_of(batches: Iterator[pa.RecordBatch], limit_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit_bytes`` at most (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * limit_bytes / max(batch.nbytes, 1)))
        for start in range(0, n, step):
            yield batch.slice(start, min(step, n - start))
