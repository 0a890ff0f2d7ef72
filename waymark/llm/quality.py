"""Quality classifier: a factorisation machine over hashed words and structure statistics."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import rows_of, text_bytes

#: Width of the hashed word space; structure statistics follow it.
WORDS = 1 << 15
#: Names of the structure statistics, each between 0 and about 1.
STATS = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "symbol", "punctuation", "white", "lines_repeated",
    "words_repeated", "short_lines", "mark_words", "doubled_marks", "non_ascii", "top_word", "empty", "log_chars", "chars_known",
)
WHOLE = ("tinyint", "smallint", "int", "bigint")
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_PUNCT = b".,;:!?'\"()-"
_SYMBOL = bytes(c for c in range(33, 127) if chr(c) not in ".,;:!?'\"()-" and not chr(c).isalnum())
_WHITE = b" \t\n\r\x0b\x0c"
_HIGH = bytes(range(128, 256))


_MARKS = re.compile(rb"([^\w\s\x80-\xff])\1")
_LETTERS = re.compile(rb"[0-9A-Za-z\x80-\xff]")


def features(raw: bytes, n_chars: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a whole text: word weights of length 1, the statistics, and the metadata ``n_chars``."""
    words = raw.split()
    n, size = len(words), max(len(raw), 1)
    bag = Counter(words)
    share = lambda chars: 1 - len(raw.translate(None, chars)) / size
    lines = [x for x in raw.split(b"\n") if x.strip()]
    stats = (
        math.log1p(len(raw)) / 12, math.log1p(n) / 10, min(1.0, sum(map(len, words)) / max(n, 1) / 20), share(_UPPER), share(_DIGIT),
        share(_SYMBOL), share(_PUNCT), share(_WHITE), 1 - len(set(lines)) / max(len(lines), 1), 1 - len(bag) / max(n, 1),
        sum(len(x) < 30 for x in lines) / max(len(lines), 1), sum(c for w, c in bag.items() if not _LETTERS.search(w)) / max(n, 1),
        min(1.0, len(_MARKS.findall(raw)) / max(n, 1)), share(_HIGH), max(bag.values(), default=0) / max(n, 1), float(n == 0),
        math.log1p(max(n_chars or 0, 0)) / 12, float(n_chars is not None),
    )
    ids = np.fromiter((crc32(w) for w in bag), np.int64, len(bag)) % WORDS
    values = np.log1p(np.fromiter(bag.values(), np.float32, len(bag)))
    values /= max(float(np.sqrt((values * values).sum())), 1e-6)
    return np.concatenate([ids, np.arange(WORDS, WORDS + len(STATS))]), np.concatenate([values, np.asarray(stats, np.float32)])


@dataclass
class FactorisationMachine:
    """bias + sum w_i x_i + sum over pairs of <v_i, v_j> x_i x_j, through a logistic link."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, ids: np.ndarray, x: np.ndarray) -> float:
        """Linear time: the pair sum is half of (sum of v x) squared less the sum of (v x) squared."""
        vx = self.v[ids] * x[:, None]
        z = self.bias + float(self.w[ids] @ x) + 0.5 * float((vx.sum(0) ** 2 - (vx * vx).sum(0)).sum())
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))

    def score_many(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """``score`` of each row, all at once; no row is without features, as statistics always are."""
        if not rows:
            return np.empty(0)
        ids, x = (np.concatenate(c) for c in zip(*rows, strict=True))
        begin = np.cumsum([0] + [len(i) for i, _ in rows[:-1]])
        vx = self.v[ids] * x[:, None]
        pairs = np.add.reduceat(vx, begin, axis=0) ** 2 - np.add.reduceat(vx * vx, begin, axis=0)
        z = self.bias + np.add.reduceat(self.w[ids] * x, begin).astype(np.float64) + 0.5 * pairs.sum(1, dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, rank: int = 4, epochs: int = 12, rate: float = 0.08, decay: float = 1e-5, seed: int = 7) -> FactorisationMachine:
        """AdaGrad on the logistic loss, in mini-batches; both classes carry the same total weight."""
        rng = np.random.default_rng(seed)
        n = WORDS + len(STATS)
        w, v = np.zeros(n), rng.normal(0, 0.02, (n, rank))
        gw, gv, gb, bias = np.full(n, 1e-2), np.full((n, rank), 1e-2), 1e-2, 0.0
        if not rows:
            return cls(0.0, w.astype(np.float32), v.astype(np.float32))
        ones = float(labels.mean())
        weight = np.where(labels == 1, 0.5 / max(ones, 1e-6), 0.5 / max(1 - ones, 1e-6))
        size = 64
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for start in range(0, len(order), size):
                part = order[start : start + size]
                ids = np.concatenate([rows[k][0] for k in part])
                x = np.concatenate([rows[k][1] for k in part])
                at = np.repeat(np.arange(len(part)), [len(rows[k][0]) for k in part])
                begin = np.searchsorted(at, np.arange(len(part)))
                vx = v[ids] * x[:, None]
                s = np.add.reduceat(vx, begin, axis=0)
                z = bias + np.add.reduceat(w[ids] * x, begin) + 0.5 * (s * s - np.add.reduceat(vx * vx, begin, axis=0)).sum(1)
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) * weight[part] / len(part)
                each = g[at] * x
                used, where = np.unique(ids, return_inverse=True)
                dw = np.bincount(where, each, len(used)) + decay * w[used]
                dv = np.stack([np.bincount(where, each * (s[at, f] - vx[:, f]), len(used)) for f in range(rank)], 1) + decay * v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                w[used] -= rate * dw / np.sqrt(gw[used])
                v[used] -= rate * dv / np.sqrt(gv[used])
                gb += g.sum() ** 2
                bias -= rate * g.sum() / math.sqrt(gb)
        return cls(bias, w.astype(np.float32), v.astype(np.float32))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves remainder 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches):
        made = [features(b, n) for b, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([i.astype(np.int32) for i, _ in made], pa.list_(pa.int32())), pa.array([x for _, x in made], pa.list_(pa.float32()))], ["label", "ids", "x"]
        )


def known_chars(docs: DataFrame) -> Column:
    """The documents' own ``n_chars``, null where there is no such column of whole numbers."""
    return F.col("n_chars").cast("long") if dict(docs.dtypes).get("n_chars") in WHOLE else F.lit(None).cast("long")


def fit_quality(docs: DataFrame, labels: DataFrame, *, max_rows: int = 6000, seed: int = 11, label_col: str = "quality") -> FactorisationMachine:
    """Fit on ``max_rows`` labelled rows at most, none of them held out, chosen by a seeded hash.

    ``max_rows`` bounds what is chosen, sent to the driver as features, and learnt. Rows with a null
    id or label are left out; of several labels for one id the smallest counts. Without labels the
    model scores 0.5 everywhere.
    """
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min(label_col).alias("label"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_rows)
    )
    texts = docs.select("doc_id", F.struct(text_bytes().alias("text"), known_chars(docs).alias("n_chars")).alias("t")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.first("label").cast("int").alias("label"), F.min("t").alias("t"))
    found = texts.select("label", "t.text", "t.n_chars").mapInArrow(_featurise, "label int, ids array<int>, x array<float>").toArrow()
    rows = [(i.values.to_numpy().astype(np.int64), x.values.to_numpy()) for i, x in zip(found.column("ids"), found.column("x"), strict=True)]
    return FactorisationMachine.fit(rows, found.column("label").to_numpy().astype(np.float64))


def score_quality(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """Adds ``score``, 0 to 1, to every row of ``docs`` from its whole ``text`` and, if there is one, its ``n_chars``.

    Null and empty texts are scored like any other, from their statistics. Row order within a
    partition stays; other columns pass through, and an old ``score`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.w, model.v))
    docs = docs.drop("score")
    text_at = docs.columns.index("text")
    chars_at = docs.columns.index("n_chars") if dict(docs.dtypes).get("n_chars") in WHOLE else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = FactorisationMachine(*shared.value)
        for batch in rows_of(batches):
            raw = [(t or "").encode() for t in batch.column(text_at).to_pylist()]
            chars = batch.column(chars_at).to_pylist() if chars_at is not None else [None] * len(raw)
            scores = machine.score_many([features(b, n) for b, n in zip(raw, chars, strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def judge_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, max_rows: int = 6000) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from ``threshold`` on).

    The model is learnt by ``fit_quality`` on labelled rows that are not held out, and applied by
    ``score_quality``: null and empty texts are scored, too, texts of any length are read whole, equal rows
    score alike, an empty table stays empty, and without labels all scores are 0.5. Columns named ``score``
    or ``predicted`` are replaced, others pass through.
    """
    scored = score_quality(docs, fit_quality(docs, labels, max_rows=max_rows))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
