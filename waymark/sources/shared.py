"""The folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names, as the place for checkpoints and intermediate tables.

    Only where it is unset, in a local session, a temporary folder of this user takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), f"spark-waymark-{spark.sparkContext.applicationId}")
    return root.rstrip("/")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Let ``DataFrame.checkpoint`` write to the shared folder if no folder was set before."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it again.

    Plans that build on it begin at a scan, several of them do not compute it twice, and it outlives
    executors and needs none of their memory. It stays until the shared folder is cleared.
    """
    path = f"{shared_root(df.sparkSession)}/waymark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
