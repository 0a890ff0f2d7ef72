"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, then banded alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, text_bytes

_WORDS = re.compile(r"[^\W_]+").findall
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_TABLE_BITS = 22
#: Postings that are expanded at once, cells that are aligned at once, and items from which on a q-gram is shared by many.
POSTINGS, CELLS, SHARED = 1 << 20, 1 << 20, 32


def normal_form(text: str) -> str:
    """Letters and digits in lower case, everything between them as one space."""
    return " ".join(_WORDS(text.lower()))


def qgram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each run of ``q`` code points, by doubling."""
    if len(codes) < q:
        return np.empty(0, np.uint64)
    single = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
    single ^= single >> np.uint64(31)
    whole, length, run, width = None, 0, single, 1
    rest = q
    while rest:
        if rest & 1:
            if whole is None:
                whole, length = run, width
            else:
                n = len(codes) - length - width + 1
                whole = whole[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + run[length : length + n]
                length += width
        rest >>= 1
        if rest:
            run = run[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + run[width:]
            width *= 2
    return (whole ^ (whole >> np.uint64(29))) * _MIX


def align(
    items: list[np.ndarray], codes: np.ndarray, which: np.ndarray, begin: np.ndarray, size: np.ndarray, low: np.ndarray, budget: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Banded alignment of many candidates at once: least edits (-1: over budget), and where the piece ends.

    Candidate c holds ``items[which[c]]`` against the ``size[c]`` characters of ``codes`` from ``begin[c]``
    on. Only cells whose diagonal (text position less item position) lies in ``low[c]`` to
    ``low[c] + 2 (budget[c] + 1)`` count. Candidates go together in blocks of a bounded number of cells,
    one row of all tables at a time; those over budget drop out on the way.
    """
    edits, ends = np.full(len(which), -1), np.zeros(len(which), np.int64)
    length = np.array([len(items[m]) for m in which], np.int64)
    order = np.argsort(length, kind="stable")
    at = 0
    while at < len(order):
        block = order[at : at + 1]
        per = int(length[block[0]]) + 2 * int(budget[order[at:]].max()) + 3
        block = order[at : at + max(1, CELLS // per)]
        while len(block) > 1 and len(block) * (int(length[block[-1]]) + per) > 2 * CELLS:
            block = block[: len(block) // 2]
        at += len(block)
        _align_block(items, codes, which, begin, size, low, budget, length, block, edits, ends)
    return edits, ends


def _align_block(items, codes, which, begin, size, low, budget, length, block, edits, ends) -> None:
    far, n = np.int32(1 << 20), int(length[block].max())
    width = 2 * (int(budget[block].max()) + 1) + 1
    lanes = np.arange(width)
    item = np.full((len(block), n), -1, np.int64)
    for row, c in enumerate(block.tolist()):
        item[row, : length[c]] = items[which[c]]
    start, total = low[block][:, None], size[block][:, None]
    place = start + np.arange(n + width)
    text = codes[np.clip(begin[block][:, None] + place, 0, len(codes) - 1)].astype(np.int64)
    text[(place < 0) | (place >= total)] = -2
    inside = lanes <= 2 * (budget[block][:, None] + 1)
    row = np.where(inside & (start + lanes >= 0) & (start + lanes <= total), np.int32(0), far)
    live = np.arange(len(block))
    for i in range(n):
        step = row + (text[live, i : i + width] != item[live, i][:, None])
        np.minimum(step[:, :-1], row[:, 1:] + 1, out=step[:, :-1])
        reach = start[live] + lanes + i + 1
        step[(reach < 0) | (reach > total[live]) | ~inside[live]] = far
        row = np.minimum.accumulate(step - lanes, axis=1) + lanes
        row[~inside[live]] = far
        least = row.min(axis=1)
        of = block[live]
        done = length[of] == i + 1
        good = done & (least <= budget[of])
        if good.any():
            edits[of[good]] = least[good]
            ends[of[good]] = low[of[good]] + row[good].argmin(axis=1) + i + 1
        keep = ~done & (least <= budget[of])
        if not keep.all():
            row, live = row[keep], live[keep]
            if not len(live):
                return


@dataclass
class Index:
    """Q-grams of a block of benchmark items, sorted by hash; small enough for every task."""

    q: int
    ids: list
    items: list[np.ndarray]
    texts: list[str]
    budgets: np.ndarray
    least: np.ndarray
    keys: np.ndarray
    starts: np.ndarray
    item_of: np.ndarray
    position: np.ndarray
    table: np.ndarray
    short: dict[str, list[int]]

    @classmethod
    def build(cls, rows: list[tuple], q: int, rate: float) -> Index:
        """An item of n characters may need ``rate * n`` edits, and fewer where q-grams leave no bound.

        A q-gram of many items says little about each. Where an item still needs hits beside all its
        shared q-grams, they are left out and its least count is lower by their number: the bound holds.
        """
        forms = [(i, t) for i, t in ((i, normal_form(t or "")) for i, t in rows) if t]
        kept = sorted(forms, key=lambda r: len(r[1]) < q)
        short: dict[str, list[int]] = {}
        for m, (_, t) in enumerate(kept):
            if len(t) < q:
                short.setdefault(t, []).append(m)
        items = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for _, t in kept]
        n = np.array([len(x) for x in items], np.int64)
        budgets = np.maximum(np.minimum((n * rate).astype(np.int64), (n - q) // q), 0)
        hashes = [qgram_hashes(x, q) for x in items]
        sizes = [len(h) for h in hashes]
        every = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(items)), sizes)
        position = np.concatenate([np.arange(s) for s in sizes] or [np.empty(0, np.int64)])
        least = n - q + 1 - q * budgets
        if len(every):
            _, where, many = np.unique(every, return_inverse=True, return_counts=True)
            common = many[where] > SHARED
            lower = least - np.bincount(owner[common], minlength=len(items))
            spare = common & (lower >= 1)[owner]
            least = np.where(lower >= 1, lower, least)
            every, owner, position = every[~spare], owner[~spare], position[~spare]
        order = np.argsort(every, kind="stable")
        keys, first = np.unique(every[order], return_index=True)
        table = np.zeros(1 << _TABLE_BITS, bool)
        table[(keys >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        return cls(q, [i for i, _ in kept], items, [t for _, t in kept], budgets, least, keys, np.append(first, len(every)), owner[order], position[order], table, short)

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item number, edits, start, end) for each item found, in normal form."""
        if not self.items:
            return []
        forms = [normal_form(t) for t in texts]
        out = [(t, m, 0, k, k + len(self.texts[m])) for t, form in enumerate(forms) for m, k in self._short_hits(form)] if self.short else []
        codes = np.frombuffer("\0".join(forms).encode("utf-32-le"), np.uint32)
        begins = np.cumsum([0] + [len(t) + 1 for t in forms])[:-1]
        hashes = qgram_hashes(codes, self.q)
        at = np.flatnonzero(self.table[hashes >> np.uint64(64 - _TABLE_BITS)]) if len(self.keys) else np.empty(0, np.int64)
        found = np.searchsorted(self.keys, hashes[at])
        same = self.keys[np.minimum(found, len(self.keys) - 1)] == hashes[at] if len(at) else np.zeros(0, bool)
        at, found = at[same], found[same]
        if not len(at):
            return out
        key, count = self._bands(at, found, begins)
        pair = key >> 26
        enough = count >= self.least[pair % len(self.items)]
        key, count, pair = key[enough], count[enough], pair[enough]
        order = np.lexsort((key, -count, pair))
        key, pair = key[order], pair[order]
        # Of each pair of text and item the best band is aligned first, then one, two, four more, until one fits.
        place = np.arange(len(pair)) - np.searchsorted(pair, pair)
        wave = np.frexp(place + 1)[1]
        done: set[int] = set()
        for w in range(1, int(wave.max(initial=0)) + 1):
            now = np.flatnonzero(wave == w)
            now = now[[p not in done for p in pair[now].tolist()]] if done else now
            for t, m, edits, start, end in self._verify(key[now], pair[now], forms, codes, begins):
                if (p := t * len(self.items) + m) not in done:
                    done.add(p)
                    out.append((t, m, edits, start, end))
        return out

    def _short_hits(self, form: str) -> Iterator[tuple[int, int]]:
        """Items shorter than a q-gram, where they first stand as whole words: ``(item, start)``."""
        words = form.split(" ")
        starts = np.cumsum([0] + [len(w) + 1 for w in words]).tolist()
        seen: set[str] = set()
        for k in range(len(words)):
            for n in range(1, self.q // 2 + 1):
                if k + n > len(words) or starts[k + n] - 1 - starts[k] >= self.q:
                    break
                run = form[starts[k] : starts[k + n] - 1]
                if run in self.short and run not in seen:
                    seen.add(run)
                    for m in self.short[run]:
                        yield m, starts[k]

    def _bands(self, at: np.ndarray, found: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hits per (text, item, band), the postings expanded a bounded number at a time."""
        many = self.starts[found + 1] - self.starts[found]
        ends = np.cumsum(many)
        keys, counts, first = [], [], 0
        while first < len(at):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + POSTINGS, "right")))
            h, g, n = at[first:last], found[first:last], many[first:last]
            post = np.repeat(self.starts[g] - np.cumsum(n) + n, n) + np.arange(n.sum())
            item, text = self.item_of[post], np.repeat(np.searchsorted(begins, h, "right") - 1, n)
            band = (np.repeat(h, n) - begins[text] - self.position[post]) // (self.budgets[item] + 1)
            lead = ((text * len(self.items) + item) << 26) + (1 << 25)
            k, c = np.unique(np.concatenate([lead + band, lead + band + 1]), return_counts=True)
            keys.append(k)
            counts.append(c)
            first = last
        if len(keys) == 1:
            return keys[0], counts[0]
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(where, np.concatenate(counts), len(key)).astype(np.int64)

    def _verify(self, key: np.ndarray, pair: np.ndarray, forms: list[str], codes: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """The bands that hold their item, in the order given: an exact piece if there is one, else by alignment."""
        text, item = pair // len(self.items), pair % len(self.items)
        step = self.budgets[item] + 1
        low = ((key & ((1 << 26) - 1)) - (1 << 25) - 1) * step  # the band's diagonals are low to low + 2 step, both included
        start = np.maximum(low, 0)
        exact = np.full(len(key), -1)
        for c, (t, m, a, b) in enumerate(zip(text.tolist(), item.tolist(), start.tolist(), (low + 2 * step).tolist(), strict=True)):
            exact[c] = forms[t].find(self.texts[m], a, b + len(self.texts[m]) + 1)
        open_ = np.flatnonzero(exact < 0)
        n = np.array([len(f) for f in forms], np.int64)[text[open_]]
        length = np.array([len(self.items[m]) for m in item[open_]], np.int64)
        stop = np.minimum(n, low[open_] + 2 * step[open_] + length + 1)
        edits, ends = align(self.items, codes, item[open_], begins[text[open_]] + start[open_], np.maximum(stop - start[open_], 0), low[open_] - start[open_], self.budgets[item[open_]])
        result = {int(c): (int(e), int(x)) for c, e, x in zip(open_, edits, ends, strict=True) if e >= 0}
        for c, (t, m) in enumerate(zip(text.tolist(), item.tolist(), strict=True)):
            if exact[c] >= 0:
                yield t, m, 0, int(exact[c]), int(exact[c]) + len(self.texts[m])
            elif c in result:
                yield t, m, result[c][0], int(start[c]), int(start[c]) + result[c][1]


def _blocks(benchmark: DataFrame, id_col: str, q: int, rate: float, block_chars: int) -> Iterator[Index]:
    """The benchmark as indexes of about ``block_chars`` characters, one after the other."""
    items = benchmark.select(id_col, "text").filter(F.length("text") > 0).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars)
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64(id_col, "text"), F.lit(blocks)) == k) if blocks > 1 else items
        yield Index.build(sorted(map(tuple, part.collect()), key=str), q, rate)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, q: int = 10, rate: float = 0.08, id_col: str = "doc_id", item_col: str = "item_id", block_chars: int = 4_000_000
) -> DataFrame:
    """``<id>, <item>, edits, start, end`` for each benchmark item that a document holds.

    Texts and items are compared as lower-case letters and digits with single spaces. An item may
    differ in ``rate`` of its characters (insertions, deletions, changes). If it does so in k places,
    document and item still share ``n - q + 1 - q k`` q-grams, all within k neighbouring diagonals: so
    q-gram hits are counted in diagonal bands that overlap by half, bands with too few are dropped,
    and the others aligned within the band. ``start`` and ``end`` count characters of the normal
    form (``start`` of an edited copy may lie up to a band before it).

    Each task searches its own documents whole; nothing is shuffled. Of the benchmark, one index of
    about ``block_chars`` characters at a time is sent to the tasks; a larger benchmark takes more
    passes. Null and empty texts and items match nothing. Items shorter than ``q`` in normal form match
    where they stand as whole words, without edits. An item that
    occurs more than once in a document is listed once. Repeated rows are each listed.
    """
    spark = docs.sparkSession
    kinds = {**dict(docs.dtypes), "__item": dict(benchmark.dtypes)[item_col]}
    schema = f"`{id_col}` {kinds[id_col]}, `{item_col}` {kinds['__item']}, edits int, start int, end int"
    result = spark.createDataFrame([], schema)
    for k, index in enumerate(_blocks(benchmark, item_col, q, rate, block_chars)):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, kind = shared.value, None
            for batch in rows_of(batches, 2 << 20):
                hits = index.search([b.decode("utf-8", "replace") for b in batch.column(1).to_pylist()])
                if hits:
                    rows, items, *rest = zip(*hits, strict=True)
                    kind = kind or pa.infer_type(index.ids)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows)), pa.array([index.ids[m] for m in items], kind), *(pa.array(x, pa.int32()) for x in rest)],
                        [id_col, item_col, "edits", "start", "end"],
                    )

        found = docs.select(id_col, text_bytes().alias("text")).mapInArrow(run, schema)
        result = found if k == 0 else result.unionByName(found)
    return result


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, q: int = 10, rate: float = 0.08, item_col: str = "item_id", block_chars: int = 4_000_000) -> DataFrame:
    """The rows of ``docs`` that hold none of the benchmark items that ``find_leaks`` reports, with all their columns.

    So a document goes if one item is found in it, a short one ("42") as a whole word, too. Null and empty
    texts hold none; each of several equal rows is judged alike; an empty table, or an empty benchmark,
    drops nothing; columns pass through under any name.
    """
    spark = docs.sparkSession
    text_at = docs.columns.index("text")
    for index in _blocks(benchmark, item_col, q, rate, block_chars):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in rows_of(batches, 2 << 20):
                keep = np.ones(batch.num_rows, bool)
                keep[[t for t, *_ in shared.value.search([t or "" for t in batch.column(text_at).to_pylist()])]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
