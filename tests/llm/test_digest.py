"""Document fingerprints against plain Python, and their edge cases."""

from hashlib import sha256

import pytest

from waymark.llm.digest import BUCKETS, LIMIT, TRIPLETS, bucket_counts, compare_edits, digest, fingerprint_documents, length_code, likeness, with_likeness

PROSE = "It was the best of times, it was the wörst of times; "


def plain_digest(data):
    counts = [0] * BUCKETS
    for kind, (near, far) in enumerate(TRIPLETS, 1):
        for i in range(len(data) - far):
            x = data[i] | data[i + near] << 8 | data[i + far] << 16 | kind << 24
            x = x * 0x9E3779B1 % 2**32
            x = (x ^ x >> 15) * 0x85EBCA77 % 2**32
            counts[x >> 24] += 1
    q1, q2, q3 = (sorted(counts)[BUCKETS * k // 4 - 1] for k in (1, 2, 3))
    codes = [(c > q1) + (c > q2) + (c > q3) for c in counts]
    ratio = "".join(f"{min(15, 16 * q // max(q3, 1)):x}" for q in (q1, q2))
    return f"{length_code(len(data)):02x}{ratio}" + "".join(f"{4 * a + b:x}" for a, b in zip(codes[::2], codes[1::2], strict=True))


def brute(rows):
    rows = sorted(((key, text or "") for key, text in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (key, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(text) // 3
        edited = (text[: len(text) - k] + following[:k]).encode()
        mine, other = plain_digest(text.encode()), plain_digest(edited)
        out.append((key, len(text), sha256(edited).hexdigest(), mine, other, likeness(mine, other), likeness(mine, plain_digest(following.encode()))))
    return sorted(out, key=repr)


ROWS = [(5, None), (9, PROSE * 40), (8, PROSE * 40), (7, ""), (3, "a"), (2, "é\U0001f600x" * 9), (1, PROSE[:11]), (None, PROSE[::-1] * 30), (-4, "".join(chr(97 + i * i % 26) for i in range(70_000)))]


def test_edits_equal_brute_force(spark):
    docs = spark.createDataFrame([(*r, "x", "y") for r in ROWS], "doc_id long, text string, fingerprint string, role string").repartition(5)
    assert sorted(map(tuple, compare_edits(docs).collect()), key=repr) == brute(ROWS)


def test_single_and_empty_tables(spark):
    one = spark.createDataFrame(ROWS[1:2], "doc_id long, text string")
    assert [(r.near_next, r.n_chars) for r in compare_edits(one).collect()] == [(1.0, len(PROSE) * 40)]
    assert compare_edits(one.limit(0)).collect() == []


def test_rows_with_one_id(spark):
    rows = [(1, PROSE * 3), (1, PROSE * 3), (1, "x" * 50), (0, "y" * 60)]
    got = compare_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and sorted(r.n_chars for r in got) == sorted(len(t) for _, t in rows)
    assert len({r.fingerprint for r in got}) == 3


def test_long_texts_are_counted_in_pieces():
    data = bytes(i * i * 7 % 251 for i in range(200_003))
    assert bucket_counts(data).sum() == sum(len(data) - far for _, far in TRIPLETS) and digest(data) == plain_digest(data)


def test_likeness_is_bounded_and_symmetric():
    some = [digest(t.encode()) for t in ("", "a", PROSE, PROSE * 9, PROSE[::-1] * 9, "0123456789" * 50)]
    for a in some:
        assert likeness(a, a) == 1.0
        for b in some:
            assert 0.0 <= likeness(a, b) == likeness(b, a) <= 1.0
    assert likeness("00" + "00" + "f" * 128, "00" + "00" + "0" * 128) == 0.0 and LIMIT == 416
    near = digest((PROSE * 9 + "One more line of its own.").encode())
    assert likeness(some[3], near) > 0.6 > likeness(some[4], some[5])


@pytest.mark.parametrize("n, code", [(0, 0), (3, 3), (4, 8), (5, 9), (7, 11), (8, 12), (1 << 20, 80)])
def test_length_codes(n, code):
    assert length_code(n) == code


def test_fingerprints_as_column(spark):
    docs = spark.createDataFrame([(1, PROSE, "old"), (2, PROSE, None), (3, None, None)], "doc_id long, text string, fingerprint string")
    rows = fingerprint_documents(docs).collect()
    assert docs.columns == fingerprint_documents(docs).columns and [r.fingerprint for r in rows] == [digest(PROSE.encode())] * 2 + [digest(b"")]
    pairs = with_likeness(spark.createDataFrame([(rows[0].fingerprint, rows[1].fingerprint), (rows[0].fingerprint, None)], "a string, b string"), "a", "b")
    assert [r.likeness for r in pairs.collect()] == [1.0, None]
