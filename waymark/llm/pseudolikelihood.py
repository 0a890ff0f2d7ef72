"""LM scoring by masked pseudo-likelihood: a bidirectional window network over word classes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, text_bytes

#: Word numbers (hashed), word endings (hashed), and classes: the first OWN hold one word each; one more is the margin.
WORDS, ENDINGS, CLASSES, OWN = 1 << 22, 16, 128, 96
#: Neighbours that the network sees on each side, and its widths.
SIDE, WIDTH, HIDDEN = 2, 12, 32
#: Logits are cut here, so that no power overflows.
LARGEST = 60.0
#: What a word weighs besides its count, so that words that stand nowhere else have a chance.
FLOOR = 0.1
_SHAPES = ((CLASSES + 1, WIDTH), (2 * SIDE * WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,))
_SIZES = [int(np.prod(s)) for s in _SHAPES]


_WHITE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def numbers_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all words of some texts, one after the other, and how many each text has.

    A number is a hash of the word, its lowest bits a hash of its last two bytes.
    """
    joined = b"\n".join(texts)
    words = joined.split()
    whole = np.fromiter(map(crc32, words), np.int64, len(words)) % WORDS
    text = np.frombuffer(joined, np.uint8)
    white = _WHITE[text]
    ends = np.flatnonzero(~white & np.append(white[1:], True)) if len(text) else np.empty(0, np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    n = np.searchsorted(ends, begin + size) - np.searchsorted(ends, begin)
    before = np.where((ends > 0) & ~white[ends - 1], text[ends - 1], 0).astype(np.int64)
    return whole // ENDINGS * ENDINGS + (text[ends] * np.int64(167) + before * 59) // 8 % ENDINGS, n


def word_numbers(raw: bytes) -> np.ndarray:
    return numbers_of([raw])[0]


@dataclass
class Vocabulary:
    """Each word number's class and its count over the whole corpus, and the classes' weights."""

    of: np.ndarray
    counts: np.ndarray
    weights: np.ndarray

    @classmethod
    def build(cls, counts: np.ndarray) -> Vocabulary:
        """The OWN most frequent words have a class each; the others are classed by ending, in bands of like weight."""
        used = np.flatnonzero(counts)
        order = used[np.lexsort((used, -counts[used]))]
        bands = (CLASSES - OWN) // ENDINGS
        of = OWN + (bands - 1) * ENDINGS + np.arange(WORDS) % ENDINGS
        rest = order[OWN:]
        mass = np.cumsum(counts[rest]) - counts[rest]
        band = np.minimum(mass * bands // max(counts[rest].sum(), 1), bands - 1).astype(np.int64)
        of[rest] = OWN + band * ENDINGS + rest % ENDINGS
        of[order[:OWN]] = np.arange(len(order[:OWN]))
        return cls(of.astype(np.uint8), counts.astype(np.int32), np.bincount(of, counts + FLOOR, CLASSES))

    def log_share(self, numbers: np.ndarray) -> np.ndarray:
        """The log share of each word in its class, the place it stands at left out of all counts."""
        return np.log((np.maximum(self.counts[numbers] - 1, 0) + FLOOR) / np.maximum(self.weights[self.of[numbers]] - 1, FLOOR))


class WindowNetwork:
    """Predicts a word's class from the classes of SIDE words before and after it."""

    def __init__(self, flat: np.ndarray) -> None:
        parts = np.split(np.asarray(flat, np.float32), np.cumsum(_SIZES)[:-1])
        self.embed, self.inner, self.shift, self.outer, self.base = (p.reshape(s).copy() for p, s in zip(parts, _SHAPES, strict=True))

    @classmethod
    def start(cls, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        scale = (0.3, 0.15, 0.0, 0.15, 0.0)
        return np.concatenate([rng.normal(0, s, n) if s else np.zeros(n) for s, n in zip(scale, _SIZES, strict=True)]).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.embed, self.inner, self.shift, self.outer, self.base)])

    def forward(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = self.embed[context].reshape(len(context), -1)
        h = np.tanh(x @ self.inner + self.shift)
        return x, h, h @ self.outer + self.base

    def log_chances(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        z = np.minimum(self.forward(context)[2], LARGEST)
        own = z[np.arange(len(z)), target]
        return own - np.log(np.exp(z, out=z).sum(axis=1))

    def step(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One gradient step on the mean negative log-likelihood."""
        x, h, z = self.forward(context)
        g = np.exp(np.minimum(z, LARGEST, out=z), out=z)
        g *= 1 / (len(g) * g.sum(axis=1, keepdims=True))
        g[np.arange(len(g)), target] -= 1 / len(g)
        gh = (g @ self.outer.T) * (1 - h * h)
        gx = (gh @ self.inner.T).reshape(-1, WIDTH)
        self.outer -= rate * (h.T @ g)
        self.base -= rate * g.sum(axis=0)
        self.inner -= rate * (x.T @ gh)
        self.shift -= rate * gh.sum(axis=0)
        where = context.ravel()
        for k in range(WIDTH):
            self.embed[:, k] -= rate * np.bincount(where, gx[:, k], CLASSES + 1).astype(np.float32)


def contexts(classes: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    """For each position the classes of SIDE neighbours before and after it, within its text; past the ends, the margin.

    ``classes`` are those of some texts, one after the other, of ``n`` words each (without it: of one text).
    """
    n = np.array([len(classes)]) if n is None else n
    at = np.arange(len(classes)) + SIDE * (np.repeat(np.arange(len(n)), n) + 1)
    padded = np.full(len(classes) + SIDE * (len(n) + 1), CLASSES, np.int64)
    padded[at] = classes
    return np.stack([padded[at + d] for d in (*range(-SIDE, 0), *range(1, SIDE + 1))], axis=1)


def count_words(docs: DataFrame) -> np.ndarray:
    """How often each word number occurs in all texts; sums per task, then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(WORDS, np.int64)
        for batch in rows_of(batches):
            number, n = np.unique(numbers_of(batch.column(0).to_pylist())[0], return_counts=True)
            sums[number] += n
        used = np.flatnonzero(sums)
        for start in range(0, len(used), 1 << 16):
            part = used[start : start + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(sums[part])], ["word", "n"])

    table = docs.select(text_bytes().alias("text")).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(WORDS, np.float64)
    counts[table.column("word").to_numpy()] = table.column("n").to_numpy()
    return counts


def targets(n: int, turn: int, rounds: int, stride: int) -> np.ndarray:
    """The positions of a text of ``n`` words that are targets in a round; with ``stride <= rounds`` all rounds cover all."""
    return np.arange((n * 7 + turn * max(1, stride // rounds)) % stride, n, stride)


def train(docs: DataFrame, vocabulary: Vocabulary, *, rounds: int = 2, stride: int | None = None, rate: float = 0.5, seed: int = 5) -> np.ndarray:
    """Parameters trained on every document: per round each task descends on its own, then all are averaged.

    A task takes each ``stride``-th position of every text, in batches of 512; by default ``stride``
    is the number of rounds and the start moves by one a round, so each position is a target once. Averages are weighted by positions; they are formed
    over (parameter, value) rows, so the driver gets one row per parameter.
    """
    spark = docs.sparkSession
    stride = rounds if stride is None else stride
    known = spark.sparkContext.broadcast(vocabulary)
    flat = WindowNetwork.start(seed)
    texts = docs.select(text_bytes().alias("text"))
    for turn in range(rounds):
        now = spark.sparkContext.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], now=now, turn=turn) -> Iterator[pa.RecordBatch]:
            network, seen = WindowNetwork(now.value), 0
            for batch in rows_of(batches):
                numbers, n = numbers_of(batch.column(0).to_pylist())
                classes = known.value.of[numbers]
                first = np.repeat((n * 7 + turn * max(1, stride // rounds)) % stride, n)
                place = np.arange(len(classes)) - np.repeat(np.cumsum(n) - n, n)
                at = np.flatnonzero((place >= first) & ((place - first) % stride == 0))
                x, y = contexts(classes, n)[at], classes[at]
                order = np.random.default_rng(seen).permutation(len(y))
                for start in range(0, len(y), 512):
                    part = order[start : start + 512]
                    network.step(x[part], y[part], rate / (1 + seen / 2e5) / (1 + turn))
                    seen += len(part)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(range(len(now.value)), pa.int32()), pa.array(network.flat().astype(np.float64) * seen), pa.array(np.full(len(now.value), float(seen)))], ["at", "value", "weight"])

        rows = texts.mapInArrow(run, "at int, value double, weight double").groupBy("at").agg((F.sum("value") / F.sum("weight")).alias("value")).toArrow()
        if rows.num_rows:
            flat = flat.copy()
            flat[rows.column("at").to_numpy()] = rows.column("value").to_numpy()
    return flat


def score_likelihood(docs: DataFrame, *, rounds: int = 2, stride: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """``<id>, n_words, log_likelihood, mean_log_likelihood, unseen_share`` for every row of ``docs``.

    Every word is hidden in turn and predicted from both sides; the conditional log-probabilities of
    all positions of the whole text are added up. A word's chance is that of its class in its window
    (network) times its share of the class, by counts over the corpus that leave out the very place:
    a hidden word must not vouch for itself. Classes of rarer words go by their endings, so context
    reaches them. ``unseen_share`` is the share of positions whose word stands nowhere else in the
    corpus (but for equal hashes): texts that occur twice have next to none. Null and empty texts have
    0 words, sum 0 and a null mean and share. An empty table gives an empty table. Repeated rows are each
    counted, learnt from and scored; texts of any length are scored whole; other columns are not read, so
    their names do not clash.
    """
    vocabulary = Vocabulary.build(count_words(docs))
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    model = spark.sparkContext.broadcast((vocabulary, train(docs, vocabulary, rounds=rounds, stride=stride)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, flat = model.value
        network = WindowNetwork(flat)
        for batch in rows_of(batches, 1 << 20):
            flat_numbers, n = numbers_of(batch.column(1).to_pylist())
            sums, new = np.zeros(len(n)), np.zeros(len(n))
            if len(flat_numbers):
                target = known.of[flat_numbers]
                context = contexts(target, n)
                each = known.log_share(flat_numbers)
                new = np.bincount(np.repeat(np.arange(len(n)), n), known.counts[flat_numbers] <= 1, len(n))
                for start in range(0, len(target), 8192):
                    each[start : start + 8192] += network.log_chances(context[start : start + 8192], target[start : start + 8192])
                sums = np.bincount(np.repeat(np.arange(len(n)), n), each, len(n))
            mean, share = (pa.array(np.where(n > 0, x / np.maximum(n, 1), np.nan), pa.float64(), from_pandas=True) for x in (sums, new))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sums), mean, share], [id_col, "n_words", "log_likelihood", "mean_log_likelihood", "unseen_share"])

    return docs.select(id_col, text_bytes().alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_words long, log_likelihood double, mean_log_likelihood double, unseen_share double")
