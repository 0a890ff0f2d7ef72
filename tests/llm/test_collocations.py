"""Collocations against plain Python; the summaries' guarantee on random streams."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from waymark.llm import collocations
from waymark.llm.collocations import Summary, mine_collocations, phrase_counts

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, threshold, longest=5, inside=100, top=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= threshold}
        scored = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p), f[p[:k]], f[p[k:]]))
        scored.sort(key=lambda r: (r[0], r[1], r[2].encode()))
        out += [(lang, i, p, -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(scored[:top], 1)]
    return sorted(out)


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "times", "a", "b", "é", "Éa", "x y", "\U0001f600", "-"]
    phrases = ["new york times", "a a a a a a", "the of", "b of a b of a", "x y é"]
    rows = []
    for i in range(n):
        parts = [rng.choice(words) if rng.random() < 0.7 else rng.choice(phrases) for _ in range(rng.randint(0, 60))]
        text = "".join(p + rng.choice([" ", " ", "  ", "\t", ". ", "!", "\n", "\x0b"]) for p in parts)
        rows.append((rng.choice(["en", "en", "en", "fr", None, "und", ""]), text))
    return rows + [("en", None), ("en", ""), (None, "...\n")] + rows[:40] * 2


def frame(spark, rows):
    return spark.createDataFrame([(i, lang, text, "w", 3) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, word string, n long").repartition(6)


@pytest.mark.parametrize("threshold, inside, top, slots", [(20, 100, 2000, 1 << 22), (5, 80, 30, 1 << 22), (12, 100, 7, 1)])
def test_collocations_equal_brute_force(spark, threshold, inside, top, slots):
    rows = corpus()
    got = mine_collocations(frame(spark, rows), threshold=threshold, inside=inside, top=top, slots=slots)
    assert got.columns == COLUMNS and sorted(map(tuple, got.collect())) == brute(rows, threshold, inside=inside, top=top)


def test_small_memory_changes_nothing(spark, monkeypatch):
    rows = corpus(120, 3)
    docs = frame(spark, rows)
    texts = docs.selectExpr("coalesce(lang, 'und') AS lang", "cast(coalesce(text, '') AS binary) AS text")
    words = collocations.count_words(texts).filter("n >= 6 AND word IS NOT NULL")
    want = sorted(map(tuple, phrase_counts(texts, words, 6, 5).collect()))
    assert want and {size for _, _, size, _ in want} == {2, 3, 4, 5}
    monkeypatch.setattr(collocations, "COUNTERS", 150)
    monkeypatch.setattr(collocations, "CHUNK", 50)
    monkeypatch.setattr(collocations, "REMEMBER", 5)
    assert sorted(map(tuple, phrase_counts(texts, words, 6, 5).collect())) == want


def test_pairs_only(spark):
    rows = corpus(60, 5)
    assert sorted(map(tuple, mine_collocations(frame(spark, rows), threshold=5, longest=2).collect())) == brute(rows, 5, longest=2)


def test_long_text_and_empty_tables(spark):
    text = "alpha beta " * 60_000
    rows = [("en", text)]
    assert sorted(map(tuple, mine_collocations(frame(spark, rows), threshold=100).collect())) == brute(rows, 100)
    assert mine_collocations(frame(spark, rows).limit(0)).collect() == []
    assert mine_collocations(frame(spark, [("en", None), ("en", "one two")])).collect() == []


def test_scores_beyond_64_bits(spark):
    rows = [("en", "p q " * 4000 + "z " * 4000)]
    got = mine_collocations(frame(spark, rows), threshold=100, scale=10**18).collect()
    by = {r.phrase: r for r in got}
    assert by["z z z z z"].score == min(10**18 * 3996 * 12000 // (x * y) for x, y in ((4000, 3997), (3999, 3998)))


@pytest.mark.parametrize("seed", range(6))
def test_summary_keeps_all_that_reach_the_threshold(seed):
    rng = np.random.default_rng(seed)
    threshold = int(rng.integers(5, 60))
    keys = np.concatenate([rng.zipf(1.3, 30_000) % 5000, rng.integers(10_000, 10**9, 60_000)]).astype(np.int64)
    rng.shuffle(keys)
    summary, exact = Summary(threshold, capacity=16), Counter(keys.tolist())
    for part in np.array_split(keys, 40):
        summary.merge(*np.unique(part, return_counts=True))
    kept = set(summary.survivors().tolist())
    assert {k for k, c in exact.items() if c >= threshold} <= kept
    assert 0 <= summary.lost < threshold and summary.capacity > len(keys) // threshold
    held = dict(zip(summary.keys.tolist(), summary.counts.tolist(), strict=True))
    assert all(held.get(k, 0) <= c <= held.get(k, 0) + summary.lost for k, c in exact.items())


def test_summary_grows_where_all_keys_are_frequent():
    summary = Summary(10, capacity=4)
    summary.merge(np.arange(1000), np.full(1000, 50))
    assert len(summary.survivors()) == 1000 and summary.lost == 0
