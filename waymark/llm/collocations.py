"""Phrases that stand together more often than their parts let expect, from exact counts of frequent word sequences."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .bloom import bit_rows, filled, masks, mix, passing, places, slots_for
from .common import materialize, rows_of, text_bytes

#: A to Z lower-cased, what ends a piece becomes a full stop, tabs become spaces.
_PLAIN = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x2E if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c for c in range(256))
#: Distinct words that a task numbers, distinct phrases that it adds up, and sequences that it counts at once.
REMEMBER, CHUNK = 300_000, 1 << 21
#: Blocks of 8 bytes in one broadcast filter (32 MB at most). A fuller filter lets more through and drops nothing.
SLOTS = 1 << 22
#: Counters that a hash partition should need, which sets how many there are.
COUNTERS = 1 << 20
#: Parts that a language's phrases are ranked in before its first ones are ranked together.
PARTS = 64
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Numbers:
    """Numbers for the words of one language, as a task meets them; 0 is the break between pieces."""

    def __init__(self) -> None:
        self.ids: defaultdict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.ids[b"."] = 0
        self.values = np.zeros(1, np.uint64)

    def read(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        words = [w for w in b" . ".join([t.translate(_PLAIN).replace(b".", b" . ") for t in texts]).split(b" ") if w]
        return words, np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    def hashes(self, numbers: np.ndarray, seed: int, known: np.ndarray) -> np.ndarray:
        """A hash for each place, 0 at breaks and words that the filter ``known`` does not hold."""
        fresh = list(self.ids)[len(self.values) :]
        if fresh:
            new = mix(np.fromiter((xxh64_intdigest(w, seed) for w in fresh), np.uint64, len(fresh))) | np.uint64(1)
            held = np.zeros(len(new), np.uint64)
            kept = passing(known, new, places(new, 0, len(known)))
            held[kept] = new[kept]
            self.values = np.concatenate([self.values, held])
        return self.values[numbers]


def lang_seed(lang: str) -> int:
    return xxh64_intdigest(lang.encode())


def longer(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of sequences that go on by one word."""
    return mix(hashes * _STEP + words)


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    groups: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        groups.setdefault(lang, []).append(text)
    yield from groups.items()


def read_texts(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
    """Language, words, their numbers, and their hashes, of a few MB of text at a time."""
    langs: defaultdict[str, Numbers] = defaultdict(Numbers)
    for batch in rows_of(batches):
        for lang, texts in _by_lang(batch):
            if sum(len(x.ids) for x in langs.values()) > REMEMBER:
                langs.clear()
            words, numbers = langs[lang].read(texts)
            yield lang, words, numbers, langs[lang].hashes(numbers, lang_seed(lang), known)


def count_words(texts: DataFrame) -> DataFrame:
    """``lang, word, n`` over ``texts(lang, text)``; the row of a null word holds all words of its language."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, tuple[Numbers, np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (numbers, counts) in langs.items():
                words = pa.array(list(numbers.ids)[1:], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words, pa.array(counts[1:])], names=["lang", "word", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([None], pa.string()), pa.array([int(counts[1:].sum())])], names=["lang", "word", "n"])
            langs.clear()

        for batch in rows_of(batches):
            for lang, texts in _by_lang(batch):
                numbers, counts = langs.get(lang) or (Numbers(), np.zeros(1, np.int64))
                here = np.bincount(numbers.read(texts)[1], minlength=len(numbers.ids)).astype(np.int64)
                here[: len(counts)] += counts
                langs[lang] = numbers, here
            if sum(len(x.ids) for x, _ in langs.values()) > REMEMBER:
                yield from flush()
        yield from flush()

    return texts.mapInArrow(tally, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def filter_of(hashes: DataFrame, keys: int, slots: int) -> np.ndarray:
    """A filter of at most ``slots`` blocks over the rows ``hash`` (bits of mixed hashes)."""
    size = min(slots, slots_for(keys))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            yield bit_rows(places(values, 0, size), masks(values))

    return filled(hashes.mapInArrow(bits, "slot long, mask long"), 0, size)


class Summary:
    """A Misra-Gries summary of counted hashes that loses none whose sum reaches ``threshold``.

    It holds more counters than the mass read divided by the threshold; with more keys than that, every
    counter is lowered by what the surplus ones hold. A key is undercounted by ``lost`` at most, which
    stays below the threshold: where lowering would pass it, the capacity is doubled instead (then the
    counters above the cut alone hold as much mass as justifies that).
    """

    def __init__(self, threshold: int, capacity: int = 1024) -> None:
        self.threshold, self.capacity, self.lost, self.mass = threshold, capacity, 0, 0
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add counts, or another summary's counters, whose ``lost`` is to be added by the caller."""
        self.mass += int(counts.sum())
        self.capacity = max(self.capacity, self.mass // self.threshold + 1)
        keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
        self.keys, self.counts = keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts
        while len(self.keys) > self.capacity:
            cut = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            if self.lost + cut >= self.threshold:
                self.capacity *= 2
                continue
            kept = self.counts > cut
            self.keys, self.counts = self.keys[kept], self.counts[kept] - cut
            self.lost += cut

    def survivors(self) -> np.ndarray:
        """Keys whose sum may reach the threshold: all that do, and few others."""
        return self.keys[self.counts + self.lost >= self.threshold]


def frequent_hashes(sequences: DataFrame, threshold: int, partitions: int) -> DataFrame:
    """``hash`` of each key of ``sequences(hash, n)`` whose sum may reach ``threshold``: one summary per hash partition."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, held, rows = Summary(threshold), [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)))
            rows += batch.num_rows
            if rows > max(1 << 18, summary.capacity):
                summary.merge(*map(np.concatenate, zip(*held, strict=True)))
                held, rows = [], 0
        if held:
            summary.merge(*map(np.concatenate, zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(summary.survivors())], names=["hash"])

    return sequences.repartition(partitions, "hash").mapInArrow(summarise, "hash long")


def _summed(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Hashes and how often each stands in some ``CHUNK`` of them."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int32))], names=["hash", "n"])

    for part in parts:
        held.append(part)
        size += len(part)
        if size >= CHUNK:
            yield batch()
            held, size = [], 0
    if size:
        yield batch()


def phrase_counts(texts: DataFrame, words: DataFrame, threshold: int, longest: int, slots: int = SLOTS) -> DataFrame:
    """``lang, phrase, size, f`` of each sequence of 2 to ``longest`` words of a piece with ``f >= threshold``.

    ``words(lang, word, n)`` are the frequent ones. A sequence can reach the threshold only if its words,
    then its pairs do: pairs of frequent words go through the summaries first, longer sequences of
    frequent pairs after them, as 64-bit hashes. What survives is counted exactly, by words, in a last
    pass: a task hands each hash partition one row with its phrases, and the partition adds the rows up;
    it holds the survivors only, as many as its summary. Filters let too much through where they are
    full, never too little.
    """
    spark = texts.sparkSession

    def word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            values = np.fromiter((xxh64_intdigest(word.encode(), lang_seed(lang)) for lang, word in pairs), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array((mix(values) | np.uint64(1)).view(np.int64))], names=["hash"])

    sums = words.agg(F.count("*").alias("words"), F.sum("n").alias("mass")).first()
    if not sums.words:
        return spark.createDataFrame([], "lang string, phrase string, size int, f long")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sums.mass * (longest - 1) // (threshold * COUNTERS)))
    known = spark.sparkContext.broadcast(filter_of(words.select("lang", "word").mapInArrow(word_hashes, "hash long"), sums.words, slots))

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, _, _, a in read_texts(batches, known.value):
            at = np.flatnonzero((a[:-1] != 0) & (a[1:] != 0))
            yield longer(a[at], a[at + 1])

    def survivors(sequences, label: str) -> tuple[DataFrame, int]:
        rows = texts.mapInArrow(lambda batches: _summed(sequences(batches)), "hash long, n int")
        found = materialize(frequent_hashes(rows, threshold, partitions), label)
        return found, found.count()

    pairs, n_pairs = survivors(pairs_of, "pairs")
    joined = spark.sparkContext.broadcast(filter_of(pairs, n_pairs, slots))

    def growing(a: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Size, places and hashes of all sequences of frequent pairs."""
        at = np.flatnonzero((a[:-1] != 0) & (a[1:] != 0))
        hashes = longer(a[at], a[at + 1])
        passed = passing(joined.value, hashes, places(hashes, 0, len(joined.value)))
        at, hashes = at[passed], hashes[passed]
        starts = np.zeros(len(a) + longest, bool)
        starts[at] = True
        yield 2, at, hashes
        for size in range(3, longest + 1):
            on = np.flatnonzero(starts[at + size - 2])
            at = at[on]
            hashes = longer(hashes[on], a[at + size - 1])
            yield size, at, hashes

    def long_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, _, _, a in read_texts(batches, known.value):
            yield from (hashes for size, _, hashes in growing(a) if size > 2)

    more, n_more = survivors(long_of, "sequences") if longest > 2 else (pairs.limit(0), 0)
    sought = spark.sparkContext.broadcast(filter_of(pairs.unionByName(more), n_pairs + n_more, slots))

    def exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for lang, words, numbers, a in read_texts(batches, known.value):
            counts = {}
            for size, at, hashes in growing(a):
                at = at[passing(sought.value, hashes, places(hashes, 0, len(sought.value)))]
                code, top = numbers[at], int(numbers.max(initial=0)) + 1
                for k in range(1, size):
                    code = np.unique(code * top + numbers[at + k], return_inverse=True)[1]
                _, first, n = np.unique(code, return_index=True, return_counts=True)
                for i, c in zip(at[first].tolist(), n.tolist(), strict=True):
                    counts[lang, size, b" ".join(words[i : i + size])] = c
            yield counts

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per hash partition: its phrases and how often each stands in what the task has read."""
        held: dict[tuple[str, int, bytes], int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            parts: dict[int, list[tuple]] = {}
            for (lang, size, phrase), n in held.items():
                parts.setdefault(xxh64_intdigest(phrase, size) % partitions, []).append((lang, size, phrase, n))
            held.clear()
            columns = [[list(column) for column in zip(*rows, strict=True)] for rows in parts.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), *(pa.array([c[i] for c in columns], pa.list_(t)) for i, t in enumerate(kinds))], names=["part", "lang", "size", "phrase", "f"])

        for counts in exactly(batches):
            for key, n in counts.items():
                held[key] = held.get(key, 0) + n
            if len(held) >= REMEMBER:
                yield from flush()
        if held:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, bytes], int] = {}
        for batch in batches:
            langs, sizes, phrases, counts = (batch.column(i).flatten().to_pylist() for i in range(1, 5))
            for lang, size, phrase, n in zip(langs, sizes, phrases, counts, strict=True):
                key = lang, size, phrase
                sums[key] = sums.get(key, 0) + n
        rows = [(lang, phrase, size, n) for (lang, size, phrase), n in sums.items() if n >= threshold]
        if rows:
            langs, phrases, sizes, counts = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int32()), pa.array(counts, pa.int64())], names=["lang", "phrase", "size", "f"])

    kinds = (pa.string(), pa.int32(), pa.binary(), pa.int64())
    packed = texts.mapInArrow(tally, "part long, lang array<string>, size array<int>, phrase array<binary>, f array<long>")
    return packed.repartition(partitions, "part").mapInArrow(merge, "lang string, phrase string, size int, f long")


def mine_collocations(docs: DataFrame, threshold: int = 100, longest: int = 5, scale: int = 1000, inside: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases by the score of their weakest cut.

    A phrase has 2 to ``longest`` words of one piece and ``a >= threshold`` occurrences among ``n`` words
    of its language; a cut with ``l`` and ``r`` occurrences of its parts scores ``scale * a * n / (l * r)``,
    rounded down, in decimals of 38 digits (more raise an error). Phrases inside a longer one that has
    ``inside`` per cent of their occurrences are dropped.

    Null texts hold no words, a null language is ``und``; texts of any length are read whole; repeated
    rows count as often as they stand there; an empty table gives no rows; other columns are not read. A
    frequent phrase is one row per task and some megabytes of text, and a language's phrases are ranked
    in parts first.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_bytes(text_col))
    words = materialize(count_words(texts).filter((F.col("n") >= threshold) | F.col("word").isNull()), "words")
    frequent, totals = words.filter("word IS NOT NULL"), words.filter("word IS NULL").select("lang", "n")
    phrases = materialize(phrase_counts(texts, frequent, threshold, longest, slots), "phrases")
    known = frequent.select("lang", F.col("word").alias("part"), F.col("n").alias("f")).unionByName(phrases.select("lang", F.col("phrase").alias("part"), "f"))

    split = phrases.withColumn("w", F.split("phrase", " "))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    ends = F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1)))
    covers = split.filter("size > 2").select("lang", ends.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    free = split.join(covers, ["lang", "phrase"], "left").filter(F.coalesce(F.lit(100) * F.col("most") < F.lit(inside) * F.col("f"), F.lit(True)))

    cuts = free.select("lang", "phrase", "f", "size", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "n", "l", "r")}
    exact = cuts.withColumns({f"{c}_": v for c, v in wide.items()}).withColumn("score", F.expr(f"CAST({scale} AS DECIMAL(38,0)) * a_ * n_ div (l_ * r_)"))
    weakest = exact.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = weakest.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
