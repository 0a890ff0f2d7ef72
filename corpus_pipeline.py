"""A corpus from raw documents to a training mix, stage by stage; belongs to the corpus operators.

Each stage takes all that the one before kept, as Parquet, and its decisions take effect: rejected
documents, surplus copies and leaked benchmark passages go, repeated passages are cut from the text,
and the last stage repeats documents by their source's target.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import materialize, table
from waymark.llm.decontam import drop_leaks
from waymark.llm.mixing import mix_documents
from waymark.llm.quality import judge_quality
from waymark.llm.repeats import cut_documents
from waymark.llm.simhash import keep_one

#: Scores below this are rejected.
QUALITY_THRESHOLD = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold.

    Null and empty texts are scored like others; equal rows stay or go together; own columns ``score`` and
    ``predicted`` keep their values; an empty table stays empty.
    """
    own = docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c in ("score", "predicted")})
    judged = judge_quality(own, table(spark, sf_dir, "labels"), threshold=QUALITY_THRESHOLD)
    return judged.filter(F.col("predicted") == 1).select(*own.columns).toDF(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, the one with the smallest id.

    Texts without words (null, empty) are copies of each other; rows with a null id all stay; of rows with
    one id one stays; an empty table stays empty; columns pass through under any name.
    """
    return keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that stand elsewhere too.

    Null and empty texts stay as they are; a document of which nothing is left goes, so rows with equal texts
    of 50 words or more all go; ``n_chars`` follows the text; an empty table stays empty.
    """
    return cut_documents(docs, window=50)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; an empty benchmark or table changes nothing; equal rows stay or go together.
    """
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target asks, ``copy`` counting from 0.

    Rows with one id are taken alike; documents without words count nothing and may stay; an empty table
    stays empty. The mix is decided from ids, sources and word counts. If the
    documents have a column ``copy``, the count takes its place in the last column as ``copy_number``.
    """
    mixed = mix_documents(docs).filter("repeats > 0").groupBy(F.col("doc_id").alias("__id")).agg(F.max("repeats").alias("__repeats"))
    copies = docs.join(materialize(mixed, "repeats"), docs["doc_id"].eqNullSafe(F.col("__id")))
    number = F.explode(F.expr("sequence(0, __repeats - 1)")).alias("copy_number" if "copy" in docs.columns else "copy")
    return copies.select(*docs.columns, number)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The classifier's training cannot be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
