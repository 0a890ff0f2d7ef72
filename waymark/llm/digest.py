"""Document fingerprints: which quartile each bucket of hashed byte triplets falls in, and the length."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows_of, text_bytes, text_key

#: Offsets of a triplet's second and third byte from its first. Wide gaps spread a language's habits
#: over many buckets, so that what tells texts apart is not drowned by them; the narrow one serves short texts.
TRIPLETS = ((1, 2), (3, 7), (4, 9), (5, 11))
BUCKETS = 256
#: Difference of two buckets by the distance of their quartiles; opposite ends count double.
STEPS = np.array([0, 1, 2, 6])
#: What lengths, and each ratio of quartiles, can add to a difference at most.
LENGTH_BOUND, RATIO_BOUND = 16, 4
#: Mean difference of unrelated buckets (STEPS over all pairs of quartiles), for all buckets: likeness 0.
LIMIT = BUCKETS * 26 // 16
#: Bytes that are hashed at once.
CHUNK = 1 << 16
_K1, _K2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def bucket_counts(data: bytes) -> np.ndarray:
    """How many of the text's byte triplets fall in each bucket."""
    whole, counts = np.frombuffer(data, np.uint8), np.zeros(BUCKETS, np.int64)
    reach = max(far for _, far in TRIPLETS)
    for start in range(0, len(whole), CHUNK):
        part = whole[start : start + CHUNK + reach].astype(np.uint32)
        for kind, (near, far) in enumerate(TRIPLETS, 1):
            n = min(CHUNK, len(part) - far)
            if n > 0:
                x = part[:n] | part[near : near + n] << np.uint32(8) | part[far : far + n] << np.uint32(16) | np.uint32(kind << 24)
                x *= _K1
                x ^= x >> np.uint32(15)
                x *= _K2
                counts += np.bincount(x >> np.uint32(24), minlength=BUCKETS)
    return counts


def length_code(n: int) -> int:
    """Four steps for each doubling."""
    if n < 4:
        return n
    top = n.bit_length() - 1
    return 4 * top + (n >> (top - 2) & 3)


def digest(data: bytes) -> str:
    """132 hex digits: two for the length, two for the quartiles' ratios, one for every two buckets."""
    counts = bucket_counts(data)
    ordered = np.sort(counts)
    q1, q2, q3 = (int(ordered[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).reshape(-1, 4)
    packed = (codes * np.array([64, 16, 4, 1], np.uint8)).sum(axis=1, dtype=np.uint8)
    ratios = [min(15, 16 * q // max(q3, 1)) for q in (q1, q2)]
    return f"{length_code(len(data)):02x}{ratios[0]:x}{ratios[1]:x}{packed.tobytes().hex()}"


def likeness(one: str, other: str) -> float:
    """1 for equal digests, 0 where they differ as unrelated ones do or more."""
    if one == other:
        return 1.0
    heads = [(int(d[:2], 16), int(d[2], 16), int(d[3], 16)) for d in (one, other)]
    apart = [abs(a - b) for a, b in zip(*heads, strict=True)]
    total = min(apart[0], LENGTH_BOUND) + min(apart[1], RATIO_BOUND) + min(apart[2], RATIO_BOUND)
    first, second = (np.frombuffer(bytes.fromhex(d[4:]), np.uint8) for d in (one, other))
    for shift in (0, 2, 4, 6):
        total += int(STEPS[np.abs((first >> shift & 3).astype(np.int8) - (second >> shift & 3).astype(np.int8))].sum())
    return 1.0 - min(total, LIMIT) / LIMIT


def fingerprint_documents(docs: DataFrame, text_col: str = "text", into: str = "fingerprint") -> DataFrame:
    """The rows of ``docs`` with the digest of their text in the column ``into`` (replaced if there).

    A null text counts as empty; texts of any length are read whole, ``CHUNK`` bytes at a time; equal
    texts have equal digests, so repeated rows do; an empty table stays empty. Nothing is shuffled.
    """
    kept = docs.drop(into)
    carried = kept.withColumn("__bytes", text_bytes(text_col))
    schema = kept.withColumn(into, F.lit("")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            digests = pa.array([digest(text) for text in batch.column(batch.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], digests], names=[*batch.schema.names[:-1], into])

    return carried.mapInArrow(work, schema)


def with_likeness(pairs: DataFrame, one: str, other: str, into: str = "likeness") -> DataFrame:
    """``pairs`` with the likeness of two columns of digests; null where one of them is null."""

    @F.pandas_udf("double")
    def compare(a, b):
        return a.combine(b, lambda x, y: None if x is None or y is None else likeness(x, y)).astype("float64")

    return pairs.withColumn(into, compare(one, other))


def _edited(text: str, following: str, share: int) -> str:
    k = len(text) // share
    return text[: len(text) - k] + following[:k]


def compare_edits(docs: DataFrame, share: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of each text and of its edited form, and how alike they and the next text's are.

    The next document has the next lower id (after the lowest: the highest); the edited form has its last
    ``1 / share`` of code points replaced by as many from the next text's beginning (all, if it has fewer).
    Returns ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    Texts are shuffled once, by ranges of ids, and streamed through sorted ranges. Only the first and
    the last document of each range are kept to be compared across ranges, which is two rows per range.
    Null texts count as empty, null ids come after all others, rows with one id are ordered by a hash of
    their texts (equal texts in any order, which gives the same rows); a single document is its own
    next; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    results = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    schema = pa.schema([("n_chars", pa.int64()), *((n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def judge(text: str, mine: str, following: str, its: str) -> tuple:
        edited = _edited(text, following, share).encode()
        other = digest(edited)
        return len(text), sha256(edited).hexdigest(), mine, other, likeness(mine, other), likeness(mine, its)

    def table(ids: list, id_type: pa.DataType, rows: list[tuple], roles: list[str | None], part: int, texts: list[str | None]) -> pa.RecordBatch:
        cells = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)]
        arrays = [pa.array(ids, id_type), *cells, pa.array(roles, pa.string()), pa.array([part] * len(ids), pa.int64()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=[id_col, *schema.names, "role", "part", "text"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, id_type = TaskContext.get().partitionId(), None, None
        for batch in rows_of(batches):
            id_type = batch.schema.field(0).type
            ids, rows, roles, texts = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = digest(text.encode())
                if held:
                    ids.append(held[0])
                    rows.append(judge(held[1], held[2], text, mine))
                    roles.append(None)
                    texts.append(None)
                else:
                    ids.append(key)
                    rows.append((None,) * 6)
                    roles.append("first")
                    texts.append(text)
                held = key, text, mine
            yield table(ids, id_type, rows, roles, part, texts)
        if held:
            yield table([held[0]], id_type, [(None,) * 6], ["last"], part, [held[1]])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            rows = [judge(a, digest(a.encode()), b, digest(b.encode())) for a, b in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema))], names=[id_col, *schema.names])

    order = [F.col(id_col).desc_nulls_last(), F.col("k1"), F.col("k2")]
    keyed = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *text_key(text_bytes(text_col)))
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(id_col, "text")
    done = materialize(ranged.mapInArrow(stream, f"`{id_col}` {kind}, {results}, role string, part long, text string"), "digests")
    ends = done.filter("role IS NOT NULL").select(F.col(id_col), "text", "role", "part")
    parts = [r.part for r in ends.filter("role = 'last'").select("part").orderBy("part").collect()]
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part long, then long")
    lasts = ends.filter("role = 'last'").select(F.col(id_col), "text", "part").join(following, "part")
    firsts = ends.filter("role = 'first'").select(F.col("part").alias("then"), F.col("text").alias("next_text"))
    closing = lasts.join(firsts, "then").select(id_col, "text", "next_text").mapInArrow(across, f"`{id_col}` {kind}, {results}")
    return done.filter("role IS NULL").select(id_col, *schema.names).unionByName(closing)
