"""Substring dedup by seed and extend: winnowed anchors find, word windows prove, what repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, rows_of, text_bytes, text_key
from .words import anchor_of_windows, run_hashes, word_hashes

#: Words in a seed; a window of W words holds W - SEED + 1 of them.
SEED = 10
_BASES = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


def _marked_windows(anchors: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Windows whose anchor is marked.

    A repeated window's words choose the same anchor wherever they stand, so a window whose anchor is
    unique in the corpus is no repeated one.
    """
    return np.flatnonzero(np.isin(anchors, marked))


def _spans(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Sorted window starts as maximal word ranges [from, to)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window) + 1
    return [(int(p[0]), int(p[-1]) + window) for p in np.split(starts, cut)]


def repeated_spans(docs: DataFrame, *, window: int = 35, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Find all windows of ``window`` words whose sequence starts more than once in the corpus.

    Returns ``parsed(<id>, k1, k2, n_words, whole_sha256)``, a row per document, and
    ``found(k1, k2, starts, packed)``, a row per distinct text that has repeated windows, with their
    starts and the text's compressed words.

    1. Seed: in each window the smallest hash among its runs of SEED words is its anchor. Equal
       texts are one from here on, by a 128-bit key: one row of each goes on, by its row number, so
       later joins have no key that copies share.
    2. Anchors that occur once are dropped (counted with map-side sums); the others are joined
       back to their texts: a window that repeats has an anchor that repeats.
    3. Extend: around each anchor left, the windows it anchors are hashed (96 bits) and counted over
       the corpus, again by sums and a join, so no pairs of documents are formed: a passage in a
       third of all documents costs one row for each of its words and documents.

    Texts of fewer words than ``window`` have none. Null counts as no words.
    """
    kind = dict(docs.dtypes)[id_col]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in rows_of(batches):
            made: list[list] = [[] for _ in range(5)]
            for raw in batch.column(4).to_pylist():
                words = raw.split()
                joined = b" ".join(words)
                hashes = word_hashes(words)
                at = np.unique(anchor_of_windows(hashes, window, SEED))
                seeds = run_hashes(hashes, SEED, _BASES[0])[at] if len(at) else np.empty(0, np.uint64)
                for column, value in zip(made, (len(words), hashlib.sha256(joined).hexdigest(), seeds.view(np.int64), at.astype(np.int32), squeeze(joined) if len(at) else None), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(made[0], pa.int64()), pa.array(made[1]), pa.array(made[2], pa.list_(pa.int64())), pa.array(made[3], pa.list_(pa.int32())), pa.array(made[4], pa.binary())],
                [id_col, "row", "k1", "k2", "n_words", "whole_sha256", "seeds", "places", "packed"],
            )

    keyed = docs.select(F.col(id_col), text_bytes().alias("text")).select(id_col, F.monotonically_increasing_id().alias("row"), *text_key(F.col("text")), "text")
    parsed = materialize(
        keyed.mapInArrow(parse, f"`{id_col}` {kind}, row long, k1 long, k2 long, n_words long, whole_sha256 string, seeds array<long>, places array<int>, packed binary"), "parsed"
    )
    with_seeds = parsed.filter(F.size("seeds") > 0)
    texts = with_seeds.groupBy("k1", "k2").agg(F.min_by(F.struct("row", "seeds", "places"), "row").alias("t")).select("t.*")
    anchors = texts.select("row", F.inline(F.arrays_zip("seeds", "places"))).withColumnsRenamed({"seeds": "seed", "places": "place"})
    repeated = materialize(anchors.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1").select("seed"), "seeds")
    marks = materialize(anchors.join(repeated, "seed").groupBy("row").agg(F.collect_list("place").alias("places")), "marks")
    sought = materialize(with_seeds.select("row", "k1", "k2", "packed").join(marks, "row"), "sought")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        names = ["w1", "w2", "row", "start"]
        for batch in rows_of(batches, 1 << 20):
            out: list[list[np.ndarray]] = [[] for _ in names]
            for row, raw, places in zip(np.asarray(batch.column(0)), batch.column(1).to_pylist(), batch.column(2), strict=True):
                hashes = word_hashes(expand(raw).split())
                starts = _marked_windows(anchor_of_windows(hashes, window, SEED), places.values.to_numpy())
                first, second = (run_hashes(hashes, window, b)[starts] for b in _BASES)
                for column, value in zip(out, (first.view(np.int64), (second >> np.uint64(32)).astype(np.uint32).view(np.int32), np.full(len(starts), row), starts.astype(np.int32)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names)

    windows = sought.select("row", "packed", "places").mapInArrow(extend, "w1 long, w2 int, row long, start int")
    more = materialize(windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").select("w1", "w2"), "windows")
    starts = windows.join(more, ["w1", "w2"]).groupBy("row").agg(F.sort_array(F.collect_list("start")).alias("starts"))
    found = materialize(sought.select("row", "k1", "k2", "packed").join(starts, "row"), "repeats")
    for done in (repeated, marks, sought, more):
        discard(done)
    return parsed.select(id_col, "k1", "k2", "n_words", "whole_sha256"), found


def _cut(found: DataFrame, window: int) -> DataFrame:
    """``k1, k2, n_removed, kept, spans`` of each text in ``found``: ``kept`` are the words left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in rows_of(batches):
            removed, kept, spans = [], [], []
            for raw, starts in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                words = expand(raw).split()
                ranges = _spans(starts.values.to_numpy(), window)
                left, at = [], 0
                for a, b in ranges:
                    left += words[at:a]
                    at = b
                left += words[at:]
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
                spans.append([{"from": a, "to": b} for a, b in ranges])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))],
                ["k1", "k2", "n_removed", "kept", "spans"],
            )

    return found.select("k1", "k2", "packed", "starts").mapInArrow(run, "k1 long, k2 long, n_removed long, kept binary, spans array<struct<`from`: int, `to`: int>>")


def _copied(parsed: DataFrame, window: int) -> DataFrame:
    """Keys of texts that more than one document has and that are long enough to repeat as a whole."""
    return parsed.filter(F.col("n_words") >= window).groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1").select("k1", "k2", F.lit(True).alias("copied"))


def remove_repeats(docs: DataFrame, *, window: int = 35, id_col: str = "doc_id") -> DataFrame:
    """What is left of each document without the words of repeated windows.

    A word goes if any run of ``window`` consecutive words that covers it also starts elsewhere, in
    another document or the same one; all copies go, the first too. Windows are judged on the input.

    Returns ``<id>, n_words, n_removed, kept_sha256, spans`` with a row per document: the SHA-256 of
    the words left, joined by one space, and the maximal word ranges removed. Rows that are repeated
    (equal texts, ids equal or not, null ids too) are copies of each other. Null and empty texts have
    0 words; an empty table gives an empty table; other columns are not carried along.
    """
    parsed, found = repeated_spans(docs, window=window, id_col=id_col)
    cut = _cut(found, window).select("k1", "k2", "n_removed", F.sha2("kept", 256).alias("sha"), "spans")
    changes = materialize(cut.join(_copied(parsed, window), ["k1", "k2"], "full_outer"), "changes")
    discard(found)
    joined = parsed.join(changes, ["k1", "k2"], "left")
    whole = F.array(F.struct(F.lit(0).alias("from"), F.col("n_words").cast("int").alias("to")))
    return joined.select(
        id_col, "n_words",
        F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copied"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "whole_sha256")).alias("kept_sha256"),
        F.when(F.col("copied"), whole).otherwise(F.coalesce("spans", F.expr("cast(array() as array<struct<`from`: int, `to`: int>>)"))).alias("spans"),
    )


def cut_documents(docs: DataFrame, *, window: int = 35, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with all columns, the repeated words gone from ``text``; see ``remove_repeats``.

    Texts that change keep their other words joined by one space; texts that do not change stay as
    they are. A document of which nothing is left is dropped. ``n_chars``, if there is such a column,
    follows the text.
    """
    names = docs.columns
    parsed, found = repeated_spans(docs, window=window, id_col=id_col)
    cut = _cut(found, window).select("k1", "k2", F.col("kept").cast("string").alias("__kept"))
    changes = materialize(cut.join(_copied(parsed, window), ["k1", "k2"], "full_outer"), "changes")
    for done in (parsed, found):
        discard(done)
    changes = changes.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.when(F.col("copied"), F.lit("")).otherwise(F.col("__kept")).alias("__kept"))
    k1, k2 = text_key(text_bytes())
    joined = docs.join(changes, (k1 == F.col("__k1")) & (k2 == F.col("__k2")), "left").withColumn("text", F.coalesce("__kept", "text"))
    joined = joined.filter(F.col("__kept").isNull() | (F.col("__kept") != ""))
    if "n_chars" in names:
        joined = joined.withColumn("n_chars", F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return joined.select(*names)
