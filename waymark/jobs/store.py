"""Stored graphs: published whole or not at all, carried on by the next build, compared with a rebuilt one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff
from ..operators.history import carry_over
from ..sources.files import Notation
from ..sources.shared import stored
from .graph import GraphTables, Refused, committed_stamps, compile_graph, lock_rows, stamp_claims

#: The form of stored rows; another one is refused.
FORM = 1


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _markers(spark: SparkSession, root: str) -> list[str]:
    store, folder = _files(spark, f"{root}/markers")
    return sorted(f.getPath().getName() for f in store.listStatus(folder)) if store.exists(folder) else []


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the version that the last marker names; None where nothing was published."""
    numbers = [m for m in _markers(spark, root) if m.isdigit()]
    if not numbers:
        return None
    form, version = spark.read.text(f"{root}/markers/{numbers[-1]}").first()[0].split(" ")
    if form != str(FORM):
        raise Refused(f"stored graph has form {form}, not {FORM}: build it again")
    return f"{root}/versions/{version}"


def _mark(spark: SparkSession, root: str, version: str, after: int) -> None:
    """Put the marker of a version in place, by one rename; the number of another build's marker is not taken."""
    store, temporary = _files(spark, f"{root}/markers/.{version}")
    out = store.create(temporary)
    out.write(bytearray(f"{FORM} {version}\n".encode()))
    out.close()
    _, final = _files(spark, f"{root}/markers/{after + 1:012d}")
    if store.exists(final) or not store.rename(temporary, final):
        store.delete(temporary, False)
        raise Refused("another build was published meanwhile")


def publish(rows: DataFrame, root: str) -> str:
    """Store ``rows(part, key, value)`` below ``root`` as the new version; its folder.

    Parts go to a new folder, the marker comes last: readers follow the last marker, so they see the old
    version or the new one, and a run that fails in between leaves the old one. Rows are stored by their
    keys' ranges, with the ranges' digests beside them.
    """
    spark, version = rows.sparkSession, uuid.uuid4().hex
    after = int(next(reversed([m for m in _markers(spark, root) if m.isdigit()]), "0"))
    folder = f"{root}/versions/{version}"
    diff.ranged(rows).repartition("top", "low").write.partitionBy("top").parquet(f"{folder}/rows")
    diff.range_digests(_rows(spark, folder)).write.parquet(f"{folder}/digests")
    _mark(spark, root, version, after)
    return folder


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("part string, key string, value string, low int, top int").parquet(f"{folder}/rows")


def read(spark: SparkSession, root: str) -> DataFrame:
    """``part, key, value`` of the current version."""
    folder = current(spark, root)
    if folder is None:
        raise Refused(f"no graph is stored in {root}: build it")
    return _rows(spark, folder).select("part", "key", "value")


def changes(rows: DataFrame, root: str) -> DataFrame:
    """``part, key, change`` from the current version below ``root`` to ``rows``; see ``diff.changes``."""
    spark = rows.sparkSession
    folder = current(spark, root)
    if folder is None:
        raise Refused(f"no graph is stored in {root}: build it")
    new = stored(diff.ranged(rows), "ranged")
    return diff.changes(_rows(spark, folder), spark.read.schema("top int, low int, n long, one decimal(38,0), two decimal(38,0)").parquet(f"{folder}/digests"), new, diff.range_digests(new))


def build(files: DataFrame, root: str, head: str | None, notation: Notation = Notation()) -> GraphTables:
    """Compile ``files``, stamp the claims at ``head`` (None: no commit yet, no stamps) and publish the graph.

    A refused block stops the build before anything is written.
    """
    graph = compile_graph(files, notation)
    refused = graph.errors.orderBy("path").first()
    if refused is not None:
        raise Refused(f"{refused.path}: {refused.error}")
    stamps = None if head is None else stored(stamp_claims(graph, graph.texts, head, notation), "stamps")
    publish(lock_rows(graph, stamps), root)
    return graph


def drift(graph: GraphTables, root: str) -> DataFrame:
    """``part, key, change``: where the stored graph is not what ``graph`` would be stored as.

    Stamps are carried over from the stored graph, never given anew, so they alone are no change.
    """
    spark = graph.files.sparkSession
    stamps = committed_stamps(read(spark, root))
    carried = carry_over(graph.claims.select("node_id", "slug").distinct(), stamps, ["node_id", "slug"], ["verified_sha", "verified_digest"]).filter(F.col("verified_sha").isNotNull())
    return changes(lock_rows(graph, carried), root)
