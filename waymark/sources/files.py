"""Tracked files as a DataFrame, and what can be read of them."""

from __future__ import annotations

import os
import subprocess
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators.ignore import drop_ignored, parse_rules
from .shared import shared_root


@dataclass(frozen=True)
class Notation:
    """How a repository writes its declarations: file name, fence, and tokens (each ends in a space)."""

    node_file: str = "AGENTS.md"
    fence: str = "graph"
    landmark: str = "※ "
    claim: str = "⊨ "
    decision: str = "§ "


def list_tracked(root: str, *flags: str) -> list[str]:
    """Paths that git tracks below ``root`` (or lists by other flags), by segment order."""
    done = subprocess.run(["git", "-C", root, "--literal-pathspecs", "ls-files", "-z", *flags], check=True, capture_output=True)
    return sorted((p.decode("utf-8", "surrogateescape") for p in done.stdout.split(b"\0") if p), key=lambda p: p.split("/"))


def from_repository(spark: SparkSession, root: str, *, ignore_file: str | None = None, partitions: int | None = None) -> DataFrame:
    """``path, content`` of a work tree's tracked files, less those that its ignore file drops.

    The driver lists paths only; tasks read contents, from ``root`` on a file system that they share.
    Files that are gone are left out.
    """
    paths = spark.createDataFrame([(p,) for p in list_tracked(root)], "path string")
    if ignore_file and os.path.exists(os.path.join(root, ignore_file)):
        with open(os.path.join(root, ignore_file), encoding="utf-8", errors="replace") as f:
            paths = drop_ignored(paths, parse_rules(f.read()))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        found.append((path, f.read()))
                except (FileNotFoundError, IsADirectoryError):
                    continue
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found]), pa.array([c for _, c in found], pa.binary())], ["path", "content"])

    spread = paths.repartition(partitions or spark.sparkContext.defaultParallelism)
    return spread.mapInArrow(read, "path string, content binary")


def from_folder(spark: SparkSession, folder: str) -> DataFrame:
    """``path, content`` of all files below a folder in any store Spark reads; hidden names are left out by Spark."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    base = folder.rstrip("/") + "/"
    return read.select(F.element_at(F.split("path", F.lit("\\Q" + base.split(":", 1)[-1].lstrip("/") + "\\E")), -1).alias("path"), "content")


def readable(files: DataFrame) -> DataFrame:
    """``path, ext, text``: files without a NUL byte in their first 8 KiB, decoded leniently."""
    plain = files.filter("content IS NOT NULL AND position(X'00', substring(content, 1, 8192)) = 0")
    return plain.select("path", X.extension(F.col("path")).alias("ext"), F.expr("make_valid_utf8(cast(content AS string))").alias("text"))


def named(files: DataFrame, names: Sequence[str]) -> DataFrame:
    """Files with one of these base names; the filter runs before contents are touched."""
    return files.filter(X.basename(F.col("path")).isin(*names))


def history(spark: SparkSession, root: str, *, chunk: int = 50_000) -> DataFrame:
    """``seq, sha, subject, file``: one row per commit and file it touches, oldest first, from one log.

    The log is read as a stream; the driver holds ``chunk`` rows at a time and writes them to the
    shared folder.
    """
    path = f"{shared_root(spark)}/waymark/history-{uuid.uuid4().hex}"
    schema = "seq long, sha string, subject string, file string"
    spark.createDataFrame([], schema).write.parquet(path)
    rows: list[tuple] = []

    def put() -> None:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
        rows.clear()

    seq, sha, subject = 0, "", ""
    with subprocess.Popen(["git", "-C", root, "-c", "core.quotePath=false", "log", "--reverse", "--name-only", "--format=%x01%H%x02%s"], stdout=subprocess.PIPE) as log:
        for raw in log.stdout:
            line = raw.decode("utf-8", "replace").rstrip("\n")
            if line.startswith("\x01"):
                seq += 1
                sha, subject = line[1:].split("\x02", 1)
            elif line:
                rows.append((seq, sha, subject.strip(), line))
                if len(rows) >= chunk:
                    put()
    if log.returncode:
        raise subprocess.CalledProcessError(log.returncode, "git log")
    if rows:
        put()
    return spark.read.schema(schema).parquet(path)


def lineage(spark: SparkSession, root: str, *, chunk: int = 50_000) -> tuple[DataFrame, DataFrame, str]:
    """Commits ``(sha, seq)``, their parents ``(sha, ord, parent)``, and the head, from one log in topological order."""
    base = f"{shared_root(spark)}/waymark/lineage-{uuid.uuid4().hex}"
    kinds = {"commits": "sha string, seq long", "parents": "sha string, ord int, parent string"}
    rows: dict[str, list[tuple]] = {name: [] for name in kinds}

    def put() -> None:
        for name, schema in kinds.items():
            spark.createDataFrame(rows[name], schema).write.mode("append").parquet(f"{base}/{name}")
            rows[name].clear()

    put()
    seq, sha = 0, ""
    with subprocess.Popen(["git", "-C", root, "log", "--topo-order", "--reverse", "--format=%H %P"], stdout=subprocess.PIPE) as log:
        for raw in log.stdout:
            sha, *parents = raw.decode().split()
            seq += 1
            rows["commits"].append((sha, seq))
            rows["parents"] += [(sha, k, p) for k, p in enumerate(parents)]
            if len(rows["commits"]) >= chunk:
                put()
    if log.returncode:
        raise subprocess.CalledProcessError(log.returncode, "git log")
    put()
    return (*(spark.read.schema(schema).parquet(f"{base}/{name}") for name, schema in kinds.items()), sha)


def versions(root: str, touched: DataFrame) -> DataFrame:
    """``sha, file, text`` for the rows of ``touched(sha, file)``: the file at that commit, null if it was not there.

    Tasks read the contents, each from one git process, as ``from_repository`` does.
    """

    def read(batches):
        import pyarrow as pa

        with subprocess.Popen(["git", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as blobs:
            for batch in batches:
                texts = []
                for sha, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    blobs.stdin.write(f"{sha}:{file}\n".encode("utf-8", "surrogateescape"))
                    blobs.stdin.flush()
                    head = blobs.stdout.readline().split()
                    size = int(head[2]) if len(head) == 3 and head[1] == b"blob" else None
                    texts.append(None if size is None else blobs.stdout.read(size + 1)[:size].decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["sha", "file", "text"])

    return touched.select("sha", "file").distinct().mapInArrow(read, "sha string, file string, text string")


def changed_files(spark: SparkSession, root: str) -> DataFrame:
    """``file``: tracked files whose work tree differs from the head."""
    done = subprocess.run(["git", "-C", root, "diff", "--name-only", "-z", "HEAD"], check=True, capture_output=True)
    return spark.createDataFrame([(p.decode("utf-8", "surrogateescape"),) for p in done.stdout.split(b"\0") if p], "file string")
