"""Dense groups of near copies that the similarity splits: all links, and rows in proportion to the group."""

import numpy as np
import pytest

from waymark.llm import simhash


def near_copies(n):
    """Copies of one text, five words of 300 replaced: most pairs have a similarity of 0.7; each tenth is a copy of the one before."""
    rng = np.random.default_rng(5)
    own = base = np.array([f"w{k}" for k in range(300)], object)
    out = []
    for k in range(n):
        own = (own if k % 10 == 9 else base).copy()
        at = rng.choice(300, 1 if k % 10 == 9 else 5, False)
        own[at] = [f"n{k}x{a}" for a in at]
        out.append(" ".join(own))
    return out


def kept_by_all_pairs(texts):
    """What stays if all pairs within the bounds of the fingerprints are measured."""
    sets = [np.unique(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    prints = np.array([(simhash.majority_bits(s), simhash.majority_bits(simhash._second_lane(s))) for s in sets], np.uint64)
    up = list(range(len(texts)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            far = np.bitwise_count(prints[a] ^ prints[b]).astype(int)
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if far.min() <= 12 and far.sum() <= 32 and 180 * both >= 80 * (len(sets[a]) + len(sets[b])):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {k for k in range(len(texts)) if top(k) == k}


@pytest.mark.parametrize("block", [512, 16])
def test_rows_follow_the_size_of_a_dense_group(spark, monkeypatch, block):
    made, write = [], simhash.materialize

    def counted(df, label):
        out = write(df, label)
        made.append((label, out.count()))
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    rows = []
    for n in (150, 300):
        made.clear()
        frame = spark.createDataFrame(list(enumerate(near_copies(n))), "doc_id long, text string")
        kept = {r.doc_id for r in simhash.keep_one(frame).collect()}
        rows.append([count for label, count in made if label == "candidates"])
        assert kept == kept_by_all_pairs(near_copies(n)) and 1 < len(kept) < n
    print(rows)
    assert all(large <= 3 * small for small, large in zip(*rows, strict=True)), rows


def test_spanning_forest():
    rng = np.random.default_rng(1)
    for n, m in ((2, 1), (30, 20), (200, 900)):
        i, j = rng.integers(0, n, (2, m))
        i, j = i[i != j], j[i != j]
        a, b = simhash.spanning(i, j, rng.integers(0, 5, len(i)), n)

        def groups(one, two):
            up = list(range(n))
            for _ in range(n):
                for x, y in zip(one.tolist(), two.tolist(), strict=True):
                    up[x] = up[y] = min(up[x], up[y])
            return up

        assert groups(a, b) == groups(i, j) and len(a) == n - len(set(groups(i, j)))
