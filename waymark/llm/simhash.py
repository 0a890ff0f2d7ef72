"""SimHash near-dedup by the generalised pigeonhole principle over partitions of correlated bits."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import discard, materialize, rows_of, text_bytes
from .components import connected_components

BITS = 64
#: Entries of one bucket that are compared with each other; the nodes of larger buckets are dealt anew.
LARGE = 2000
#: What a signature row and a compared pair cost, in nanoseconds, when thresholds are allotted.
ROW_NS, PAIR_NS = 1500.0, 3.0
#: Keys of so many bits or fewer are counted in arrays by each task.
COUNTED_BITS = 16
#: Sets of a dense bucket that meet in one task are of two blocks of so many.
BLOCK = 512


def shingle_hashes(raw: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words, A-Z lower-cased and joined by one space.

    Fewer words: of the whole sequence; no words: none.
    """
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    runs = [b" ".join(words)] if len(words) < width else list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    return np.fromiter(map(xxh64_intdigest, runs, repeat(42)), np.uint64, len(runs))


def majority_bits(hashes: np.ndarray) -> int:
    """Bit b is set if it is set in over half of the hashes; 0 for none."""
    total = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 255 * 64):
        bits = np.unpackbits(hashes[start : start + 255 * 64].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255
        total += bits[:full].reshape(-1, 255, BITS).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[full:].sum(0, dtype=np.uint8)
    return int(np.packbits((2 * total > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def _second_lane(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles, from a 64-bit finaliser."""
    h = (hashes + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def fingerprints(docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id") -> DataFrame:
    """``<id>, f0``: the 64-bit SimHash of every row, as signed longs."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            out = np.fromiter((majority_bits(shingle_hashes(raw, shingle)) for raw in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], [id_col, "f0"])

    return docs.select(id_col, text_bytes().alias("text")).mapInArrow(run, f"`{id_col}` {kind}, f0 long")


def _set_code(distinct: np.ndarray) -> int:
    """One number for a set of shingles, given as its sorted hashes."""
    return xxh64_intdigest(distinct.tobytes(), 42)


def set_prints(docs: DataFrame, *, shingle: int = 5, id_col: str = "doc_id") -> DataFrame:
    """``<id>, f0, f1, f2, size``: two independent SimHashes of each row's set of shingles, a hash of the set, and its size class.

    Sets whose sizes differ by a factor of 1.25 at most (as a similarity of 0.8 asks) are of one class or of two neighbouring ones.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            out, size = np.empty((3, batch.num_rows), np.uint64), np.zeros(batch.num_rows, np.int32)
            for row, raw in enumerate(batch.column(1).to_pylist()):
                distinct = np.unique(shingle_hashes(raw, shingle))
                out[:, row] = majority_bits(distinct), majority_bits(_second_lane(distinct)), _set_code(distinct)
                size[row] = size_class(len(distinct))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.view(np.int64)) for x in out), pa.array(size)], [id_col, "f0", "f1", "f2", "size"])

    return docs.select(id_col, text_bytes().alias("text")).mapInArrow(run, f"`{id_col}` {kind}, f0 long, f1 long, f2 long, size int")


def size_class(n: int) -> int:
    """The number of the step of factor 1.25 that ``n`` lies on; rounding errors only make neighbours of equals."""
    return int(math.log(max(n, 1)) / math.log(1.25) * (1 - 1e-12))


#: Further lanes of SimHash bits that tell candidates from links before sets are compared, and how many may differ.
SKETCH = 14
SKETCH_BOUND = 169


def sketches(sets: DataFrame) -> DataFrame:
    """``f2, s0..``: SKETCH further lanes of 64 SimHash bits of each set ``(f2, hashes)``.

    They are 896 bits. At a similarity of 0.8 some 136 of them differ, with a deviation of 11;
    SKETCH_BOUND is three deviations above.
    """
    names = [f"s{k}" for k in range(SKETCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            out = np.empty((SKETCH, batch.num_rows), np.uint64)
            for row, hashes in enumerate(batch.column(1)):
                lane = _second_lane(hashes.values.to_numpy().view(np.uint64))
                for k in range(SKETCH):
                    lane = _second_lane(lane)
                    out[k, row] = majority_bits(lane)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.view(np.int64)) for x in out)], ["f2", *names])

    return sets.select("f2", "hashes").mapInArrow(run, "f2 long, " + ", ".join(f"{n} long" for n in names))


def shingle_sets(docs: DataFrame, *, shingle: int = 5) -> DataFrame:
    """``f2, hashes``: each row's set of shingles under its code, as in ``set_prints``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            sets = [np.unique(shingle_hashes(raw, shingle)) for raw in batch.column(0).to_pylist()]
            codes = np.fromiter(map(_set_code, sets), np.uint64, len(sets))
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["f2", "hashes"])

    return docs.select(text_bytes().alias("text")).mapInArrow(run, "f2 long, hashes array<long>")


@dataclass(frozen=True)
class Part:
    """Some bits of a fingerprint; pairs within ``left + right`` differences in them are candidates.

    Every node stores the keys within ``left`` flips of its own and is looked up under those within
    ``right``; with ``left == right`` one set of keys serves for both.
    """

    bits: tuple[int, ...]
    left: int
    right: int

    def keys(self, f: np.ndarray) -> np.ndarray:
        key = np.zeros(len(f), np.uint64)
        for k, b in enumerate(self.bits):
            key |= ((f >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
        return key


def flips(width: int, most: int) -> np.ndarray:
    """Masks of ``width`` bits with ``most`` bits set at most."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(width), k)], np.uint64)


def group_bits(correlation: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Deal the bits into ``parts`` groups of (nearly) equal size, correlated bits together."""
    strength = np.abs(correlation.copy())
    np.fill_diagonal(strength, 0)
    free, out = set(range(len(strength))), []
    for p in range(parts):
        size = len(free) // (parts - p)
        pool = sorted(free)
        first = max(pool, key=lambda b: (strength[b, pool].max(), -b))
        group = [first]
        while len(group) < size:
            rest = sorted(free - set(group))
            group.append(max(rest, key=lambda b: (strength[b, group].mean(), -b)))
        free -= set(group)
        out.append(tuple(sorted(group)))
    return out


def _within(rates: np.ndarray, most: int) -> np.ndarray:
    """Chance of 0, up to 1, ... up to ``most`` differences of independent bits with these rates."""
    p = np.zeros(len(rates) + 1)
    p[0] = 1
    for r in rates:
        p[1:] = p[1:] * (1 - r) + p[:-1] * r
        p[0] *= 1 - r
    return np.cumsum(p)[: most + 1]


def allot(bits: list[tuple[int, ...]], equal: list[float], differ: np.ndarray, nodes: int, bound: int, *, rows_per: float = 1, share: float = 1) -> tuple[float, list[int]]:
    """Thresholds per partition by dynamic programming over estimated work; -1 leaves one out.

    With m partitions whose thresholds add up to ``bound - m + 1``, two fingerprints within ``bound``
    differences are within the threshold of one partition at least. ``equal`` are the pairs with
    equal keys as counted over all nodes; for more differences they grow as if bits were independent.
    ``rows_per`` multiplies rows and ``share`` pairs where buckets are cut by size classes.
    """
    total = bound - len(bits) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group, pairs in zip(bits, equal, strict=True):
        chance = _within(differ[list(group)], bound)
        after: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for e in range(-1, min(bound, len(group)) + 1):
                if e >= 0:
                    a, b = (e + 1) // 2, e // 2
                    rows = sum(math.comb(len(group), k) for k in range(a + 1)) + (sum(math.comb(len(group), k) for k in range(b + 1)) if a != b else 0)
                    more = nodes * rows * rows_per * ROW_NS + share * pairs * chance[e] / max(chance[0], 1e-300) * PAIR_NS * math.comb(e, b)
                else:
                    more = 0.0
                if rank := after.get(spent + e):
                    if rank[0] <= cost + more:
                        continue
                after[spent + e] = (cost + more, [*chosen, e])
        best = after
    return best.get(total, (math.inf, []))


@dataclass(frozen=True)
class Plan:
    """Partitions with thresholds, and whether buckets are cut by size classes; ``seconds`` is the estimate."""

    parts: list[Part]
    sized: bool = False
    seconds: float = 0.0


def plan_parts(nodes: DataFrame, bound: int, *, lane: str = "f0", size: str | None = None) -> Plan:
    """Partitions and thresholds from statistics of all distinct fingerprints ``nodes(f0, ...)``.

    One pass adds up how often each two bits are set together (a 64 by 64 table); a second counts,
    for 2 to ``bound + 1`` partitions of correlated bits, the pairs that share each partition's key;
    the cheapest allotment of thresholds is taken. With a column ``size`` of size classes, each
    allotment is also priced with buckets cut by class: two rows for one, and only the pairs of one or
    neighbouring classes, by the classes' counts.
    """

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            f = np.asarray(batch.column(0)).view(np.uint64)
            for start in range(0, len(f), 1 << 16):
                x = np.unpackbits(f[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                sums += (x.T @ x).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS), pa.int32()), pa.array(list(sums), pa.list_(pa.int64()))], ["bit", "with"])

    counts = nodes.select(lane).mapInArrow(together, "bit int, with array<long>").groupBy("bit").agg(*(F.sum(F.col("with")[j]).alias(f"c{j}") for j in range(BITS)))
    table = {r[0]: r[1:] for r in counts.collect()}
    n = nodes.count()
    if n < 2:
        return Plan([])
    both = np.array([table[b] for b in range(BITS)], np.float64) / n
    p = np.diag(both)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    correlation = (both - np.outer(p, p)) / np.outer(spread, spread)
    differ = 2 * p * (1 - p)
    choices = [group_bits(correlation, m) for m in range(2, bound + 2)]
    parts = [Part(g, 0, 0) for groups in choices for g in groups]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = {k: np.zeros(1 << len(part.bits), np.int64) for k, part in enumerate(parts) if len(part.bits) <= COUNTED_BITS}
        for batch in rows_of(batches):
            f = np.asarray(batch.column(0)).view(np.uint64)
            for k, part in enumerate(parts):
                key = part.keys(f).view(np.int64)
                if k in small:
                    small[k] += np.bincount(key, minlength=len(small[k]))
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), k, np.int32)), pa.array(key), pa.array(np.ones(len(f), np.int64))], ["part", "key", "n"])
        for k, count in small.items():
            used = np.flatnonzero(count)
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k, np.int32)), pa.array(used), pa.array(count[used])], ["part", "key", "n"])

    shared = nodes.select(lane).mapInArrow(keys, "part int, key long, n long").groupBy("part", "key").agg(F.sum("n").alias("n"))
    pairs = dict(shared.groupBy("part").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2.0)).collect())
    ways: list[tuple[bool, float, float]] = [(False, 1.0, 1.0)]
    if size:
        # At most one row for each step of factor 1.25 that a size can lie on: some 150.
        classes = dict(nodes.groupBy(size).count().collect())
        ways.append((True, 2.0, sum(c * (2 * c + 2 * classes.get(k + 1, 0)) for k, c in classes.items()) / n**2))
    best, at = Plan([], seconds=math.inf), 0
    for groups in choices:
        equal = [max(pairs.get(at + k, 0.0), n * (n - 1) / 2 * 2.0 ** -len(g)) for k, g in enumerate(groups)]
        at += len(groups)
        for sized, rows_per, share in ways:
            cost, thresholds = allot(groups, equal, differ, n, bound, rows_per=rows_per, share=share)
            if cost / 1e9 < best.seconds:
                best = Plan([Part(g, (e + 1) // 2, e // 2) for g, e in zip(groups, thresholds, strict=True) if e >= 0], sized, cost / 1e9)
    return best


def _signatures(nodes: DataFrame, plan: Plan, names: list[str]) -> DataFrame:
    """``bucket, side, f0..``: each node under the keys of its lane ``names[0]``. ``side`` is twice the partition's
    number, and one more for what is only looked up; what is stored is looked up, too, if one set serves.

    The lanes ``names`` come out as ``f0, f1, ...`` in that order. In a sized plan each node stands
    in the buckets of its own size class and of the next.
    """
    parts = plan.parts
    lanes = [f"f{k}" for k in range(len(names))]
    masks = [[flips(len(p.bits), r) for r in ((p.left,) if p.left == p.right else (p.left, p.right))] for p in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 1 << 18):
            f = [np.asarray(c).view(np.uint64) for c in batch.columns[: len(lanes)]]
            steps = [np.asarray(batch.column(len(lanes))).astype(np.uint64) + np.uint64(up) for up in (1, 2)] if plan.sized else [None]
            for k, (part, sides) in enumerate(zip(parts, masks, strict=True)):
                key = part.keys(f[0])
                for side, mask in enumerate(sides):
                    block = max(1, (1 << 17) // len(mask))
                    for start in range(0, len(key), block):
                        bucket = (key[start : start + block, None] ^ mask).ravel()
                        mixed = (bucket + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15)) if len(part.bits) > 56 else bucket | np.uint64(k << 56)
                        rest = [pa.array(np.full(len(bucket), 2 * k + side, np.int8)), *(pa.array(np.repeat(x[start : start + block], len(mask)).view(np.int64)) for x in f)]
                        for step in steps:
                            under = mixed if step is None else mixed + np.repeat(step[start : start + block], len(mask)) * np.uint64(0xD6E8FEB86659FD93)
                            yield pa.RecordBatch.from_arrays([pa.array(under.view(np.int64)), *rest], ["bucket", "side", *lanes])

    source = nodes.select(*(F.col(n).alias(f"f{k}") for k, n in enumerate(names)), *(["size"] if plan.sized else []))
    return source.mapInArrow(run, "bucket long, side byte, " + ", ".join(f"{n} long" for n in lanes))


def _near(f: np.ndarray, one: int, many: np.ndarray, bound: int, bound_all: int) -> np.ndarray:
    """Which of the entries ``many`` are within the bounds of the entry ``one``."""
    first = np.bitwise_count(f[0, one] ^ f[0, many])
    if len(f) == 1:
        return first <= bound
    return (first <= bound) & (first + np.bitwise_count(f[1, one] ^ f[1, many]) <= bound_all)


def _pairs(f: np.ndarray, a: np.ndarray, b: np.ndarray, bound: int, bound_all: int, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """All pairs of ``a`` and ``b`` within the bounds, in blocks; None if there are over ``most``."""
    out, total = [], 0
    step = max(1, (1 << 19) // max(len(b), 1))
    for start in range(0, len(a), step):
        part = a[start : start + step]
        i, j = np.nonzero(np.bitwise_count(f[0, part][:, None] ^ f[0, b]) <= bound)
        i, j = part[i], b[j]
        if len(f) > 1 and len(i):
            good = np.bitwise_count(f[0, i] ^ f[0, j]) + np.bitwise_count(f[1, i] ^ f[1, j]) <= bound_all
            i, j = i[good], j[good]
        out.append((i, j))
        total += len(i)
        if total > most:
            return None
    i, j = (np.concatenate(x) for x in zip(*out, strict=True))
    return i[i != j], j[i != j]


def spanning(i: np.ndarray, j: np.ndarray, far: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a minimum spanning forest of ``n`` entries by the distances ``far``, in rounds that each halve the trees."""
    order = np.argsort(far, kind="stable")
    i, j = i[order], j[order]
    tree, out = np.arange(n), []
    while True:
        apart = tree[i] != tree[j]
        i, j = i[apart], j[apart]
        if not len(i):
            break
        nearest = np.full(n, len(i))
        for end in (i, j):
            np.minimum.at(nearest, tree[end], np.arange(len(i)))
        take = np.unique(nearest[nearest < len(i)])
        out.append((i[take], j[take]))
        one, two, top = tree[i[take]], tree[j[take]], np.arange(n)
        while (top[one] != top[two]).any():
            low, high = np.minimum(top[one], top[two]), np.maximum(top[one], top[two])
            np.minimum.at(top, high, low)
            top = top[top]
        tree = top[tree]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (i, j)


def link_bucket(f: np.ndarray, side: np.ndarray, bound: int, bound_all: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (rows of ``f``) that join all entries of a bucket which links connect.

    Buckets with few links are compared in blocks; of pairs that are no forest the nearest stay that make one. Large or dense
    ones grow one component at a time: each entry reached is compared with those not reached yet, so a
    group of near copies costs little more than its size. Edges are fewer than entries.
    """
    n = f.shape[1]
    none = np.empty(0, np.int64)
    crossed = bool(side.any())
    if crossed and side.all():
        return none, none
    if n <= 4096:
        a, b = (np.flatnonzero(side == 0), np.flatnonzero(side)) if crossed else (np.arange(n), np.arange(n))
        if (found := _pairs(f, a, b, bound, bound_all, 6 * n)) is not None:
            i, j = found
            return spanning(i, j, np.bitwise_count(f[:2, i] ^ f[:2, j]).sum(0, dtype=np.int64), n) if len(i) >= n else found
    waiting = np.arange(n)
    out_i, out_j = [], []
    while len(waiting):
        queue, waiting = [int(waiting[0])], waiting[1:]
        while queue and len(waiting):
            at = queue.pop()
            near = _near(f, at, waiting, bound, bound_all)
            if crossed:
                near &= side[waiting] != side[at]
            if near.any():
                got = waiting[near]
                out_i.append(np.full(len(got), at))
                out_j.append(got)
                queue += got.tolist()
                waiting = waiting[~near]
    return np.concatenate(out_i or [none]), np.concatenate(out_j or [none])


def first_meeting(differ: np.ndarray, plan: Plan) -> np.ndarray:
    """The first partition in which fingerprints meet that differ in the bits ``differ``; they meet in one at least."""
    out = np.full(len(differ), len(plan.parts), np.int64)
    for k in range(len(plan.parts) - 1, -1, -1):
        part = plan.parts[k]
        mask = np.uint64(sum(1 << b for b in part.bits))
        out[np.bitwise_count(differ & mask) <= part.left + part.right] = k
    return out


def cross_pairs(f: np.ndarray, side: np.ndarray, bound: int, bound_all: int, plan: Plan, part: int, others: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of a bucket within the bounds whose labels (the last row of ``f``) differ, block by block.

    A pair is given by the first partition of the plan in which it meets, and with ``others`` only if
    the other lane (row 1 of ``f``) does not give it, being over the bound there. Rows between that and
    the last two are a sketch, in which SKETCH_BOUND bits may differ.
    """
    crossed = bool(side.any())
    a, b = (np.flatnonzero(side == 0), np.flatnonzero(side)) if crossed else (np.arange(f.shape[1]),) * 2
    step = max(1, (1 << 19) // max(len(b), 1))
    for start in range(0, len(a), step):
        i, j = _pairs(f, a[start : start + step], b, bound, bound_all, f.shape[1] ** 2)
        apart = f[-1, i] != f[-1, j] if crossed else (f[-1, i] != f[-1, j]) & (i < j)
        if others:
            apart &= np.bitwise_count(f[1, i] ^ f[1, j]) > bound
        i, j = i[apart], j[apart]
        apart = first_meeting(f[0, i] ^ f[0, j], plan) == part
        if len(f) > 4:
            far = np.zeros(len(i), np.int64)
            for row in f[2:-2]:
                far += np.bitwise_count(row[i] ^ row[j])
            apart &= far <= SKETCH_BOUND
        if apart.any():
            yield i[apart], j[apart]


def _edges(signatures: DataFrame, lanes: int, bound: int, bound_all: int, *, labelled: Plan | None = None, others: bool = False) -> DataFrame:
    """``a0.., b0..`` from rows of buckets: probe and verify, bucket by bucket in sorted partitions.

    ``labelled``: the signatures' plan, if the last lane is a label and all pairs of different labels
    are asked for; then the rows are ``a, b, crowd, blocks`` of the lane before it. Of a bucket with more pairs than
    entries in them those entries are given instead, as ``a``, with the number of their block as ``b``, a
    hash of them all as ``crowd`` and the number of blocks; ``crowd`` is null for pairs.
    """
    names = [f"{end}{k}" for end in "ab" for k in range(lanes)] if labelled is None else ["a", "b", "crowd", "blocks"]
    block = BLOCK

    def joined(f: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        if labelled is not None:
            return pa.RecordBatch.from_arrays([*(pa.array(f[-2, x].view(np.int64)) for x in (i, j)), *[pa.nulls(len(i), pa.int64())] * 2], names)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (*f[:, i], *f[:, j])], names)

    def crowded(members: np.ndarray) -> pa.RecordBatch:
        number, crowd = np.arange(len(members)) // block, np.uint64(_set_code(members))
        every = [np.full(len(members), x).view(np.int64) for x in (crowd, number[-1] + 1)]
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (members, number, *every)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            bucket, number, *f = columns
            side = number & 1
            f = np.stack(f).view(np.uint64)
            cut = np.flatnonzero(np.diff(bucket)) + 1
            starts, ends = np.append(0, cut), np.append(cut, len(bucket))
            many = ends - starts > 1
            found, size = [], 0
            if labelled is not None:
                for a, b in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
                    paired, own, pairs = np.zeros(b - a, bool), [], 0
                    for i, j in cross_pairs(f[:, a:b], side[a:b], bound, bound_all, labelled, int(number[a]) >> 1, others):
                        paired[i] = paired[j] = True
                        pairs += len(i)
                        own = [*own, (i + a, j + a)] if pairs <= b - a else []
                    if pairs > np.count_nonzero(paired):
                        yield crowded(np.unique(f[-2, a:b][paired]))
                        continue
                    found += own
                    size += pairs
                    if size > 1 << 16:
                        yield joined(f, found)
                        found, size = [], 0
                if found:
                    yield joined(f, found)
                return
            for a, b in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
                i, j = link_bucket(f[:, a:b], side[a:b], bound, bound_all)
                if len(i):
                    found.append((i + a, j + a))
            if found:
                yield joined(f, found)

        held: list[list[np.ndarray]] = []
        for batch in batches:
            columns = [np.asarray(c) for c in batch.columns]
            if not len(columns[0]):
                continue
            last = int(np.searchsorted(columns[0], columns[0][-1]))  # the last bucket may go on in the next batch
            if last or (held and held[-1][0][-1] != columns[0][0]):
                yield from linked([np.concatenate(c) for c in zip(*held, [c[:last] for c in columns], strict=True)])
                held = []
            held.append([c[last:] for c in columns])
        if held:
            yield from linked([np.concatenate(c) for c in zip(*held, strict=True)])

    rows = signatures.repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def near_groups(prints: DataFrame, *, bound: int = 2, lanes: int = 1, bound_all: int | None = None) -> DataFrame:
    """``f0[, f1], group``: the connected components of fingerprints linked at ``bound`` bits or fewer.

    ``prints`` holds one row per document; equal fingerprints are one node. With two lanes, a link
    also needs ``bound_all`` differing bits or fewer over both. ``group`` is the smallest fingerprint
    (as text) of the component; fingerprints without a link are left out.

    Candidates share a key in one of the planned partitions and are verified within their bucket.
    With one lane and a bound of 2, nodes in buckets of over LARGE entries are joined under a plan of
    a single partition of all 64 bits instead: within two flips of each other, one flip each meets
    at a common key, which at most 65 fingerprints share, so no bucket is ever large there.
    """
    names = [f"f{k}" for k in range(lanes)]
    bound_all = 2 * bound + 1 if bound_all is None else bound_all
    nodes = materialize(prints.select(*names).distinct(), "nodes")
    plan = plan_parts(nodes, bound)
    code = lambda end: F.concat(*(F.lpad(F.hex(f"{end}{k}"), 16, "0") for k in range(lanes)))
    if not plan.parts:
        return nodes.withColumn("group", code("f")).limit(0)
    signatures = _signatures(nodes, plan, names)
    if bound <= 2 and lanes == 1:
        signatures = materialize(signatures, "signatures")
        large = signatures.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > LARGE).select("bucket")
        dense = signatures.join(large, "bucket").select("f0").distinct()
        single = _signatures(dense, Plan([Part(tuple(range(BITS)), 1, bound - 1)] if bound else []), names)
        edges = _edges(signatures.join(large, "bucket", "left_anti"), lanes, bound, bound_all).unionByName(_edges(single, lanes, bound, bound_all))
    else:
        edges = _edges(signatures, lanes, bound, bound_all)
    groups = connected_components(edges.select(code("a").alias("a"), code("b").alias("b")))
    return nodes.withColumn("node", code("f")).join(groups, "node").select(*names, F.col("component").alias("group"))


def near_duplicates(docs: DataFrame, *, shingle: int = 3, bound: int = 2, id_col: str = "doc_id") -> DataFrame:
    """``<id>, fingerprint, component_id`` for every row of ``docs``.

    Texts (A-Z lower-cased) are cut into runs of ``shingle`` words; fingerprints at ``bound`` differing
    bits or fewer are linked; ``component_id`` is the smallest id reachable. Null, empty and blank
    texts have fingerprint zero and are linked like any other. Rows with equal texts or ids are rows
    like any other; null ids are no candidates for the smallest (null if there is no other). An empty
    table gives an empty table.
    """
    prints = materialize(fingerprints(docs, shingle=shingle, id_col=id_col), "prints")
    groups = near_groups(prints, bound=bound)
    least = prints.groupBy("f0").agg(F.min(id_col).alias("least")).join(groups, "f0", "left")
    own = F.lpad(F.hex("f0"), 16, "0")
    keyed = materialize(least.select("f0", "least", F.coalesce("group", own).alias("group")), "groups")
    smallest = materialize(keyed.groupBy("group").agg(F.min("least").alias("component_id")), "smallest")
    labels = keyed.join(smallest, "group").select("f0", "component_id")
    return prints.join(labels, "f0").select(id_col, F.lower(own).alias("fingerprint"), "component_id")


def _measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets have a Jaccard similarity of ``percent`` hundredths or more."""
    one, two = (sets.select(F.col("f2").alias(end), F.col("hashes").alias(f"of_{end}")) for end in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    enough = both * (100 + percent) >= percent * (F.size("of_a") + F.size("of_b"))
    return pairs.join(one, "a").join(two, "b").filter(enough).select("a", "b")


def crowd_links(members: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, bound: int, bound_all: int) -> DataFrame:
    """``a, b``: links by measured similarity that join what the pairs within the bounds join in each crowd.

    ``members`` are rows ``a, b, crowd, blocks`` of ``_edges``, ``labels`` have ``f0, f1, f2, f3``. The blocks of
    a crowd meet two by two, so a task holds two blocks of sets at most. Pairs are measured inside the task and are
    no rows; those of one label, given or found, are left out, so links are fewer than sets.
    """

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        f2, label, block, *f = (rows.column(c).to_numpy() for c in ("f2", "f3", "b", "f0", "f1"))
        f = np.stack(f).view(np.uint64)
        label = np.unique(label, return_inverse=True)[1]
        sets = rows.column("hashes").combine_chunks()
        ends = sets.offsets.to_numpy() - sets.offsets[0].as_py()
        code, sizes = np.unique(sets.flatten().to_numpy(), return_inverse=True)[1], np.diff(ends)
        own = np.split(code, ends[1:-1])
        held, out_a, out_b = np.zeros(code.max(initial=0) + 1, bool), [], []
        inside = key[1].as_py() == key[2].as_py()
        for at in range(len(f2)) if inside else np.flatnonzero(block == key[1].as_py()):
            other = np.arange(at + 1, len(f2)) if inside else np.flatnonzero(block == key[2].as_py())
            least, most = np.minimum(sizes[other], sizes[at]), np.maximum(sizes[other], sizes[at])
            other = other[(label[other] != label[at]) & (100 * least >= percent * most)]
            each = np.bitwise_count(f[:, other] ^ f[:, at, None])
            other = other[(each.min(0) <= bound) & (each.sum(0, dtype=np.int64) <= bound_all)]
            if not len(other):
                continue
            held[own[at]] = True
            both = np.append(0, np.cumsum(held[np.concatenate([own[k] for k in other])]))[np.append(0, np.cumsum(sizes[other]))]
            held[own[at]] = False
            other = other[np.diff(both) * (100 + percent) >= percent * (sizes[other] + sizes[at])]
            joined, first = np.unique(label[other], return_index=True)
            out_a.append(np.full(len(first), f2[at]))
            out_b.append(f2[other[first]])
            if len(joined):
                label[np.isin(label, joined)] = label[at]
        return pa.table({n: np.concatenate(x or [np.empty(0, np.int64)]) for n, x in (("a", out_a), ("b", out_b))})

    y = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    tasks = members.withColumn("y", y).select(F.col("a").alias("f2"), "b", "crowd", F.least("b", "y").alias("x"), F.greatest("b", "y").alias("y"))
    rows = tasks.join(labels.select("f0", "f1", "f2", "f3"), "f2").join(sets, "f2")
    found = rows.groupBy("crowd", "x", "y").applyInArrow(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_groups(docs: DataFrame, prints: DataFrame, *, shingle: int, percent: int, bound: int, bound_all: int, id_col: str) -> DataFrame:
    """``f2, group``: the connected components of shingle sets linked by a measured similarity.

    SimHash only proposes pairs, by an index of its own for each of two lanes of 64 bits: at most
    ``bound`` bits of one lane and ``bound_all`` of both differ. First it gives edges that span each bucket's close sets;
    they are measured and joined to components. Then all pairs of the
    sets met so far that are within the bounds but in different components are measured as well, if
    a sketch of 896 further bits does not tell them apart. So a group of n near copies costs about n
    pairs, and no proposed pair goes unmeasured that could join two components. Where a bucket has more such pairs than sets
    (a dense group that the similarity splits), the sets go to tasks instead of the pairs (``crowd_links``).
    Sets without a link may be left out.
    """
    nodes = materialize(prints.select("f0", "f1", "f2", "size").distinct(), "nodes")
    lanes = [(a, b, plan_parts(nodes, bound, lane=a, size="size")) for a, b in (("f0", "f1"), ("f1", "f0"))]
    if not lanes[0][2].parts:
        return nodes.select("f2", F.col("f2").alias("group")).limit(0)
    ends = lambda edges, k: edges.select(F.least(f"a{k}", f"b{k}").alias("a"), F.greatest(f"a{k}", f"b{k}").alias("b")).filter("a <> b")
    found = [ends(_edges(_signatures(nodes, plan, [a, b, "f2"]), 3, bound, bound_all), 2) for a, b, plan in lanes]
    first = materialize(found[0].union(found[1]).distinct(), "candidates")
    met = materialize(first.select(F.col("a").alias("f2")).union(first.select("b")).distinct(), "met")
    ids = materialize(prints.join(met, "f2", "left_semi").groupBy("f2").agg(F.min(id_col).alias("__id")).select("__id").distinct(), "ids")
    texts = docs.join(ids, docs[id_col].eqNullSafe(ids["__id"]), "left_semi")
    sets = materialize(shingle_sets(texts, shingle=shingle).join(met, "f2", "left_semi").dropDuplicates(["f2"]), "sets")
    linked = materialize(_measured(first, sets, percent), "linked")
    for done in (met, ids):
        discard(done)
    groups = connected_components(linked)
    labels = groups.select(F.col("node").alias("f2"), F.col("component").alias("f3"))
    more_bits = [f"s{k}" for k in range(SKETCH)]
    marked = nodes.join(sketches(sets), "f2").join(labels, "f2", "left").select("f0", "f1", *more_bits, "f2", F.coalesce("f3", "f2").alias("f3"), "size")
    marked = materialize(marked, "marked")
    discard(nodes)
    found = [_edges(_signatures(marked, plan, [a, b, *more_bits, "f2", "f3"]), SKETCH + 4, bound, bound_all, labelled=plan, others=a == "f1") for a, b, plan in lanes]
    second = materialize(found[0].union(found[1]).distinct(), "candidates")
    pairs = second.filter("crowd IS NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    pairs = pairs.join(first, ["a", "b"], "left_anti")
    crowds = crowd_links(second.filter("crowd IS NOT NULL"), sets, marked, percent, bound, bound_all)
    more = materialize(_measured(pairs, sets, percent).union(crowds), "linked")
    for done in (first, marked, second, sets):
        discard(done)
    if not more.isEmpty():
        discard(groups)
        groups = connected_components(linked.unionByName(more))
    for done in (linked, more):
        discard(done)
    return groups.select(F.col("node").alias("f2"), F.col("component").alias("group"))


def keep_one(docs: DataFrame, *, shingle: int = 5, percent: int = 80, bound: int = 12, bound_all: int = 32, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest id.

    Two texts are linked if their sets of ``shingle``-word runs (A-Z lower-cased) have a Jaccard
    similarity of ``percent`` hundredths or more. The similarity is measured for pairs that SimHash
    proposes: at most ``bound`` bits of either of two lanes of 64 and ``bound_all`` of all 128 differ,
    which at a similarity of 0.8 holds for about 97 in 100 pairs (9.7 of 64 bits differ on average) and
    for more above.
    Rows with one id are one document, of which one row stays; rows with a null id all stay. Texts
    without words are copies of each other. All columns are kept.
    """
    prints = materialize(set_prints(docs, shingle=shingle, id_col=id_col), "prints")
    groups = similar_groups(docs, prints, shingle=shingle, percent=percent, bound=bound, bound_all=bound_all, id_col=id_col)
    least = prints.groupBy("f2").agg(F.min(id_col).alias("least")).join(groups, "f2", "left")
    keyed = materialize(least.select("f2", "least", F.coalesce("group", "f2").alias("group")), "groups")
    discard(groups)
    smallest = materialize(keyed.groupBy("group").agg(F.min("least").alias("stays")), "smallest")
    labels = keyed.join(smallest, "group").select("f2", "stays")
    gone = prints.join(labels, "f2").filter(F.col(id_col) != F.col("stays")).select(id_col).distinct()
    stays = prints.join(labels, "f2").filter(F.col(id_col) == F.col("stays")).select(id_col).distinct()
    gone = gone.join(stays, id_col, "left_anti")
    kept = docs.join(gone, id_col, "left_anti")
    twice = prints.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1").select(id_col)
    if twice.isEmpty():
        return kept
    once = kept.join(twice, id_col, "left_anti")
    return once.unionByName(kept.join(twice, id_col, "left_semi").dropDuplicates([id_col])).select(*docs.columns)
