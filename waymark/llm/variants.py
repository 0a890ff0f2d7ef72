"""Spelling variants: words one edit apart, found through Bloom filters of the vocabulary by length."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bit_rows, counted, filled, masks, mix, passing, places, slots_for
from .common import materialize, rows_of, text_bytes

#: Words are of a to z and U+00C0 to U+00FF, whose UTF-8 begins with the byte C3.
_OTHER = re.compile(rb"[\xC2\xC4-\xF7][\x80-\xBF]*")
_KEPT = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or 0x80 <= c <= 0xBF or c == 0xC3 else 0x20 for c in range(256))
#: Distinct words that a task adds up before it passes them on.
REMEMBER = 400_000
#: Lengths from here on share a filter shard per power of two, so there are at most some 300 shards.
LONG = 256
#: Blocks of 8 bytes that go out in one broadcast (32 MB), and edits that a task holds at once.
SLOTS, EDITS = 1 << 22, 1 << 16
#: Position weights are powers of an odd number, so a deletion shifts the rest by its inverse modulo 2^64.
_BASE = 0xD6E8FEB86659FD93
_UNSHIFT = np.uint64(pow(_BASE, -1, 1 << 64))
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def runs_of(text: bytes) -> list[bytes]:
    """Maximal runs of letters of a UTF-8 text, A to Z lower-cased."""
    return _OTHER.sub(b" ", text).translate(_KEPT).split()


def count_words(docs: DataFrame, spoil: int, least_length: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: how often each word of ``least_length`` code points or more stands in the texts.

    With ``spoil`` a run whose checksum with its document's id divides by it loses one code point
    first (0: none does). A null id counts as an empty one.
    """

    def per_text(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in rows_of(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seed, words = crc32(f"{'' if key is None else key}:".encode()), {}
                for run, n in Counter([r for r in runs_of(text) if len(r) >= least_length]).items():
                    if spoil and not (h := crc32(run, seed)) % spoil:
                        whole = run.decode()
                        at = h % len(whole)
                        run = (whole[:at] + whole[at + 1 :]).encode()
                    words[run] = words.get(run, 0) + n
                yield words

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
        yield from counted(per_text(batches), REMEMBER, schema, lambda keys: [pa.array(keys, pa.binary()).cast(pa.string())])

    counts = docs.select(F.col(id_col), text_bytes(text_col)).mapInArrow(tally, "word string, n long")
    return counts.filter(F.length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n"))


def length_class(length: int) -> int:
    return length if length < LONG else LONG + length.bit_length()


def _by_length(words: list[str], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length, and their characters as a matrix of some ``most`` cells."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        step = max(1, most // max(1, int(lengths[same[0]])))
        for start in range(0, len(same), step):
            rows = same[start : start + step]
            letters = "".join([words[r] for r in rows]).encode("latin-1")
            yield rows, np.frombuffer(letters, np.uint8).reshape(len(rows), -1)


def _weights(length: int) -> np.ndarray:
    powers = np.full(length, np.uint64(_BASE))
    powers[:1] = 1
    return np.multiply.accumulate(powers)


def _shards(sizes: dict[int, int]) -> tuple[dict[int, tuple[int, int]], int]:
    """First block and blocks of each length class, and all blocks."""
    shards, first = {}, 0
    for kind in sorted(sizes):
        shards[kind] = (first, slots_for(sizes[kind]))
        first += shards[kind][1]
    return shards, first


def _edits(letters: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Edited forms of equally long words: their length, hashes, rows, places, and the new character (-1: deleted).

    Each pair of words one edit apart is met from one side only: the longer word gives up a character
    (the first of a run of equal ones), or a character turns into a greater one.
    """
    length = letters.shape[1]
    powers = _weights(length)
    terms = _VALUES[letters] * powers
    upto = np.add.accumulate(terms, axis=1)
    whole = upto[:, -1:]
    first = np.ones(letters.shape, bool)
    first[:, 1:] = letters[:, 1:] != letters[:, :-1]
    rows, at = np.nonzero(first)
    gone = (upto - terms) + (whole - upto) * _UNSHIFT
    yield length - 1, gone[rows, at], rows, at, -1
    rest = whole - terms
    for char in alphabet:
        rows, at = np.nonzero(letters < char)
        if len(rows):
            yield length, rest[rows, at] + powers[at] * _VALUES[char], rows, at, int(char)


def near_words(vocabulary: DataFrame, sizes: dict[int, int], slots: int = SLOTS) -> DataFrame:
    """``word, n, near, near_n``: each pair of words of ``vocabulary(word, n)`` that one edit parts, once.

    Words consist of characters up to U+00FF; only those that the vocabulary uses are put in.
    ``sizes`` holds the number of words per ``length_class``. The filters go out ``slots`` blocks at a
    time; if the vocabulary needs more, as many rounds follow as it needs, each over the lengths whose
    filters it holds. Only edited forms that pass meet the vocabulary in a join, which drops those that
    passed by chance.
    """
    spark = vocabulary.sparkSession
    shards, total = _shards(sizes)

    def to_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            for _, letters in _by_length(batch.column(0).to_pylist(), EDITS):
                hashes = mix((_VALUES[letters] * _weights(letters.shape[1])).sum(axis=1, dtype=np.uint64))
                yield bit_rows(places(hashes, *shards[length_class(letters.shape[1])]), masks(hashes))

    used = vocabulary.select(F.explode(F.split("word", "")).alias("c")).distinct().filter("c <> ''").collect()
    alphabet = np.array(sorted(ord(row.c) for row in used), np.uint8)
    found = None
    for start in range(0, total, slots):
        size = min(slots, total - start)
        inside = {k for k, (first, n) in shards.items() if first < start + size and first + n > start}
        blocks = spark.sparkContext.broadcast(filled(vocabulary.select("word").mapInArrow(to_bits, "slot long, mask long"), start, size))

        def probe(batches: Iterator[pa.RecordBatch], start=start, size=size, inside=inside, blocks=blocks) -> Iterator[pa.RecordBatch]:
            for batch in rows_of(batches, 1 << 20):
                words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                for which, letters in _by_length(words, EDITS):
                    if not {length_class(letters.shape[1]), length_class(letters.shape[1] - 1)} & inside:
                        continue
                    sources, forms = [], []
                    for length, hashes, rows, at, char in _edits(letters, alphabet):
                        if length_class(length) not in inside:
                            continue
                        hashes = mix(hashes)
                        slot = places(hashes, *shards[length_class(length)]) - np.uint64(start)
                        if size < total:
                            here = np.flatnonzero(slot < np.uint64(size))
                            hashes, slot, rows, at = hashes[here], slot[here], rows[here], at[here]
                        passed = passing(blocks.value, hashes, slot)
                        new = "" if char < 0 else chr(char)
                        for row, place in zip(which[rows[passed]].tolist(), at[passed].tolist(), strict=True):
                            sources.append(row)
                            forms.append(words[row][:place] + new + words[row][place + 1 :])
                    if sources:
                        arrays = [pa.array([words[r] for r in sources]), pa.array(counts[sources]), pa.array(forms)]
                        yield from rows_of(iter([pa.RecordBatch.from_arrays(arrays, names=["word", "n", "near"])]))

        passed = vocabulary.select("word", "n").mapInArrow(probe, "word string, n long, near string")
        pairs = passed.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")
        if size < total:
            pairs = materialize(pairs, "near-words")
            blocks.destroy()
        found = pairs if found is None else found.unionByName(pairs)
    return found


def group_variants(docs: DataFrame, spoil: int = 0, least_length: int = 7, least: int = 2, ratio: int = 10, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of ``least_length`` code points with ``least`` occurrences.

    A word's form is the most frequent word one edit away (the first in code-point order among
    equals), if it stands ``ratio`` times as often; forms lead to forms, and ``root`` is where they
    end. Every chain ends, since counts grow by ``ratio`` (2 or more) at each step.

    Null and empty texts hold no words; texts and runs of any length are read whole; rows that repeat
    count as often as they stand there; an empty table gives no rows. Other columns of ``docs`` are not
    read. A frequent word is one row per task, as tasks add up what they read; no word has more partners
    than edits.
    """
    if ratio < 2:
        raise ValueError("forms must be at least twice as frequent, or chains need not end")
    words = materialize(count_words(docs, spoil, least_length, id_col, text_col).filter(F.col("n") >= least), "vocabulary")
    length = F.length("word").cast("int")
    kind = F.when(length < LONG, length).otherwise(LONG + F.length(F.conv(length.cast("string"), 10, 2)))
    sizes, most = {}, 0
    for row in words.groupBy(kind.alias("kind")).agg(F.count("*").alias("words"), F.max("n").alias("most")).collect():
        sizes[row.kind], most = row.words, max(most, row.most)
    if not sizes:
        return words.select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"))
    pairs = near_words(words, sizes, slots)
    either = pairs.select(F.explode(F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("p"))
    best = either.select("p.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    far = -F.col("best.less") >= ratio * F.col("n")
    joined = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("best.near")).alias("form"), F.when(far, -F.col("best.less")).alias("form_n")
    )
    known = materialize(joined, "forms")
    ends = known.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    steps = max(1, int(math.log(max(most, 1), ratio)) + 1)
    for _ in range(math.ceil(math.log2(steps))):
        ahead = ends.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        ends = materialize(ends.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
