"""Rendered text put into files: generated regions spliced, one rule file per node, stale ones pruned."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.spans import Malformed, scan, splice
from .graph import GraphTables

#: Fixed value: the first line of a rule file that a run may replace or delete.
STAMP = "<!-- generated: rules of a node -->"


def spliced(files: DataFrame, bodies: DataFrame, marker: str = "@graph") -> DataFrame:
    """``path, content, state`` of the ``files(path, content)`` that ``bodies(path, body)`` name.

    ``content`` holds the body as its generated region, all else byte for byte. ``state``: same, changed, or
    why it is left as it is (no generated region, a malformed one, not UTF-8).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, states = [], []
            for content, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    made = splice(content, body or "", marker)
                    states.append("no generated region" if made is None else "same" if made == content else "changed")
                    contents.append(content if made is None else made)
                except (Malformed, UnicodeDecodeError) as e:
                    states.append(f"malformed: {e}" if isinstance(e, Malformed) else "not UTF-8")
                    contents.append(content)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.binary()), pa.array(states)], ["path", "content", "state"])

    return files.join(bodies, "path").select("path", "content", "body").mapInArrow(run, "path string, content binary, state string")


def spans(texts: DataFrame, key: str, text: str, patterns: dict[str, str] | None = None, marker: str = "@graph") -> DataFrame:
    """``key, kind, start, stop`` in bytes: fences, comments and the generated region of markdown, or what ``patterns`` match."""
    kind = dict(texts.dtypes)[key]
    compiled = {k: re.compile(p.encode(), re.S) for k, p in (patterns or {}).items()}

    def found(raw: str) -> Iterator[tuple[str, int, int]]:
        if compiled:
            data = raw.encode("utf-8", "surrogatepass")
            for name, p in compiled.items():
                yield from ((name, m.start(), m.end()) for m in p.finditer(data))
            return
        try:
            lines, region = scan(raw, marker)
        except Malformed:
            return
        yield from lines
        if region:
            yield "generated", region.start, region.stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *span) for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for span in found(raw or "")]
            if rows:
                types = (batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [key, "kind", "start", "stop"])

    return texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, kind string, start long, stop long")


def rule_files(graph: GraphTables, folder: str = "rules") -> tuple[DataFrame, DataFrame]:
    """``path, text`` of one rule file per node with claims, and ``path, ids``: names that several nodes would take.

    A file begins with ``STAMP``; its claims stand in the order of their slugs. Colliding nodes get no file.
    """
    claims = graph.claims.select("node_id", "slug", F.concat(F.lit("- "), X.flat(F.col("text")), F.lit(" ("), X.flat(F.col("anchor")), F.lit(")\n")).alias("line"))
    per = claims.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slug", "line"))), lambda c: c["line"]), "").alias("lines"))
    named = per.select(F.concat(F.lit(f"{folder}/"), X.rule_slug(F.col("node_id")), F.lit(".md")).alias("path"), "node_id", F.concat(F.lit(f"{STAMP}\n# "), "node_id", F.lit("\n\n"), "lines").alias("text"))
    taken = named.groupBy("path").agg(F.sort_array(F.collect_set("node_id")).alias("ids"))
    twice = taken.filter(F.size("ids") > 1)
    return named.join(twice.select("path"), "path", "left_anti").select("path", "text"), twice


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write ``files(path, text)`` below ``root`` in tasks; ``path, state``: written or same.

    ``root`` lies on a file system that all tasks share. A file is written under a name of its own and
    renamed, so a task that is lost, repeated or run twice leaves the old file or the whole new one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target, data = os.path.join(root, path), text.encode("utf-8")
                try:
                    with open(target, "rb") as f:
                        same = f.read() == data
                except FileNotFoundError:
                    same = False
                if not same:
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    temporary = f"{target}.{uuid.uuid4().hex}.tmp"
                    with open(temporary, "wb") as f:
                        f.write(data)
                        f.flush()
                        os.fsync(f.fileno())
                    os.replace(temporary, target)
                states.append("same" if same else "written")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(states)], ["path", "state"])

    return files.select("path", "text").mapInArrow(run, "path string, state string")


def stale(present: DataFrame, rendered: DataFrame) -> DataFrame:
    """``path`` of the ``present(path, text)`` files that bear the stamp and are not ``rendered(path)`` any more; others are left alone."""
    return present.filter(F.startswith("text", F.lit(STAMP + "\n"))).select("path").join(rendered.select("path"), "path", "left_anti")


def prune(spark: SparkSession, gone: DataFrame, root: str) -> DataFrame:
    """Delete the files ``gone(path)`` below ``root`` in tasks; ``path`` of those that were there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for path in batch.column(0).to_pylist():
                try:
                    os.remove(os.path.join(root, path))
                    done.append(path)
                except FileNotFoundError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])

    return gone.select("path").mapInArrow(run, "path string")
