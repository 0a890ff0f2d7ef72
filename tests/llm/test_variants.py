"""Spelling variants against plain Python, in one round and in many, and on odd tables."""

from collections import Counter
from zlib import crc32

import pytest

from waymark.llm.variants import group_variants, runs_of

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def brute(rows, spoil, least_length=7, least=2, ratio=10):
    letters = set(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]))
    counts = Counter()
    for key, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c in letters:
                run += c.lower() if c < "\x80" else c
            elif run:
                h = crc32(f"{'' if key is None else key}:{run}".encode())
                counts[run if h % spoil else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
                run = ""
    n = {w: c for w, c in counts.items() if len(w) >= least_length and c >= least}
    near = {w: {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + d :] for d in (0, 1) for i in range(len(w) + 1 - d) for c in letters} - {w} for w in n}
    near = {w: {x for x in close if x in n} for w, close in near.items()}
    best = {w: min(close, key=lambda x: (-n[x], x)) for w, close in near.items() if close}
    form = {w: b for w, b in best.items() if n[b] >= ratio * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def rows_of(frame):
    assert frame.columns == COLUMNS
    return sorted(tuple(r) for r in frame.collect())


CHAIN = "Wonderful " * 2300 + "wonderfull " * 200 + "wonderfulll " * 20 + "wonderfulla " * 3 + "WONDERFÜL wonderfÜl wonderfÜl "
ROWS = [
    (1, CHAIN), (2, None), (3, ""), (4, CHAIN), (4, CHAIN), (None, "aaaaaaaa aaaaaaaaa aaaaaaaaa aaaaaaaa"), (5, "l'été×÷ÿÀabcdefg x–abcdefgh’abcdefghĀabcdefg\U0001f600abcdefg"),
    (6, ("a" * 40_000 + " ") * 2 + ("a" * 40_001 + " ") * 25 + "b" * 300 + " " + "b" * 300), (7, "abcdefg " * 40 + "abcdefX abcdefX bbcdefg bbcdefg"),
]


@pytest.mark.parametrize("slots", [1 << 22, 40])
def test_variants_equal_brute_force(spark, slots):
    rows = [r for r in ROWS if r[0] != 6]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n long")
    assert rows_of(group_variants(docs, spoil=5, slots=slots)) == brute(rows, 5)


def test_very_long_runs(spark):
    docs = spark.createDataFrame(ROWS[7:8], "doc_id long, text string")
    got = {len(r.word): r for r in group_variants(docs).collect()}
    assert got[40_000].form == "a" * 40_001 and got[40_000].n_near == 1 and got[40_001].form is None and got[300].n_near == 0


def test_empty_table_and_no_words(spark):
    for docs in (spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")):
        assert rows_of(group_variants(docs, spoil=31)) == []


def test_weak_ratio_is_refused(spark):
    with pytest.raises(ValueError):
        group_variants(spark.createDataFrame([], "doc_id long, text string"), ratio=1)


def test_runs():
    assert runs_of("ABCÄbc d×e–fÿĀg¿h".encode()) == [w.encode() for w in ("abcÄbc", "d×e", "fÿ", "g", "h")]
