"""Operators against brute force on small tables, and their behaviour at the edges."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from waymark.llm import decontam, extract, mixing, pseudolikelihood, quality, queries, repeats, search, simhash, tokencount, urlrules
from waymark.llm.components import connected_components

WORD = re.compile(rb"[^\x20\x09-\x0D]+").findall
DOC_SCHEMA = "doc_id long, text string, source string, k1 long, score double, extra string"


def words(text):
    return WORD((text or "").encode())


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing names."""
    long = " ".join(f"w{k % 997}" for k in range(60_000))
    same = " ".join(f"s{k}" for k in range(50))
    made = [(1, None, None), (2, "", "a"), (3, " \t\n ", "a"), (4, long, "b"), (5, same, "b"), (5, same, "b"), (None, same, None), (6, same + " tail", "\u00e9"), (7, "one", "c"), (None, None, None)]
    return spark.createDataFrame([(i, t, s, 1, 0.5, "x") for i, t, s in made], DOC_SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


# -- mixing ---------------------------------------------------------------------------------------


def filled(sizes, weights, total, most):
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    left = total
    while open_:
        share = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if share * weights[s] >= most * sizes[s]}
        for s in over or open_:
            target[s] = most * sizes[s] if s in over else share * weights[s]
        if not over:
            break
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mix_targets_and_repeats(spark, sf_dir, rows):
    got = queries.op1_mixing(spark, sf_dir).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(words(r.text))
    names = sorted(sizes, key=lambda s: (s is None, s))
    want = filled(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes.values()), 2)
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in rows)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= 2 * largest[s] for s in names)
    assert sorted(got) == sorted(queries.op1_mixing(spark, sf_dir).collect())


def test_mix_edges(odd, none):
    got = mixing.mix_documents(odd).collect()
    assert len(got) == odd.count() and all(r.repeats in (0, 1, 2) for r in got)
    assert {r.size for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.mix_documents(none).count() == 0


def test_all_sources_full_when_budget_exceeds_limits(odd):
    got = mixing.mix_documents(odd, budget=9.0, max_epochs=2.0).filter("size > 0").collect()
    assert {r.repeats for r in got} == {2}


# -- decontamination ------------------------------------------------------------------------------


def semi_global(item, text):
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        for j in range(len(text)):
            new[j + 1] = min(row[j] + (c != text[j]), row[j + 1] + 1, new[j] + 1)
        row = new
    return row.min()


def test_leaks_agree_with_full_alignment(spark):
    rng = np.random.default_rng(1)
    letters = "abcdefgh "
    say = lambda n: " ".join("".join(rng.choice(list(letters), n)).split())
    items = [(k, say(n)) for k, n in enumerate((60, 90, 150, 12, 240))]
    texts = []
    for n in range(40):
        item = items[n % 5][1]
        made = list(item)
        for _ in range(int(rng.integers(0, 2 + len(item) // 7))):
            at = int(rng.integers(0, len(made)))
            made[at : at + int(rng.integers(0, 2))] = [str(rng.choice(list("xyz ")))]
        texts.append(say(int(rng.integers(0, 120))) + " " + "".join(made) + " " + say(int(rng.integers(0, 90))))
    got = decontam.find_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id): r.edits for r in got}
    for d, t in enumerate(texts):
        for i, item in items:
            form, text = decontam.normal_form(item), decontam.normal_form(t)
            budget = min(int(len(form) * 0.08), (len(form) - 10) // 10)
            edits = semi_global(form, text)
            assert ((d, i) in found) == (edits <= budget), (d, i, edits, budget)
            if (d, i) in found:
                assert edits <= found[d, i] <= budget


def test_items_of_one_template_take_no_time_each():
    """Many items that share a prompt, in a text that repeats it: the item that is there is found, and no other."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    prompt = "answer the following question about the passage and explain it why"
    items = [(k, f"{prompt} {word()} {word()} {word()} {word()}") for k in range(400)]
    index = decontam.Index.build(items, 10, 0.08)
    text = " ".join(f"{prompt} {word()} {word()}" for _ in range(100))
    begun = time.perf_counter()
    assert index.search([text, "x", f"{text} {items[7][1]} {text}"]) == [(2, 7, 0, len(text) + 1, len(text) + 1 + len(items[7][1]))]
    assert time.perf_counter() - begun < 60
    part = decontam.Index.build([(k, f"{prompt[:20]} " + " ".join(word() for _ in range(60))) for k in range(100)], 10, 0.08)
    changed = part.texts[5].replace(part.texts[5].split(" ")[30], "zzz")
    assert [(t, m) for t, m, *_ in part.search([text, changed])] == [(1, 5)]


def test_short_items_match_as_whole_words():
    index = decontam.Index.build([(1, "Is it?"), (2, "a long enough item of text"), (3, "is it")], 10, 0.08)
    found = sorted((t, index.ids[m], e, a, b) for t, m, e, a, b in index.search(["This, is it! is it", "isit", "a long enough item of text is", ""]))
    assert found == [(0, 1, 0, 5, 10), (0, 3, 0, 5, 10), (2, 2, 0, 0, 26)]


def test_leaks_edges(spark, odd, none):
    bench = spark.createDataFrame([(1, "s1 s2 s3 s4 s5 s6 s7"), (1, "s1 s2 s3 s4 s5 s6 s7"), (2, None), (3, ""), (4, "one"), (None, "S40, s41; S42 s43 s44")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(odd, bench).collect()}
    assert got == {(d, i) for d in (5, 6, None) for i in (1, None)} | {(7, 4)}
    assert decontam.find_leaks(none, bench).count() == 0 and decontam.find_leaks(odd, bench.limit(0)).count() == 0
    kept = decontam.drop_leaks(odd, bench)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "None"]
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(odd, bench, block_chars=20).collect()} == got


def test_planted_passages_are_found(spark, sf_dir, rows):
    bench = {r.item_id: decontam.normal_form(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = {(r.doc_id, i) for r in rows for i, t in bench.items() if t in decontam.normal_form(r.text)}
    got = {(r.doc_id, r.item_id) for r in queries.op2_decontamination(spark, sf_dir).collect()}
    assert want and want <= got


# -- URL rules ------------------------------------------------------------------------------------


def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), h + p, a) for h, p, a in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, "allow")))


def test_url_rules_agree_with_brute_force(spark):
    rng = np.random.default_rng(2)
    hosts = ["org", "a.org", "b.a.org", "aorg", "x.com", "com", "B.A.Org", "a.org.", ".org", ""]
    paths = ["", "/", "/es", "/es/", "/es/x", "/en/1", "/en/12", "//", "/\u00e9"]
    urls = [None, "", "no scheme", "://", "http://", "http://a.org/x://b"] + [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/es/', '#f'])}" for _ in range(150)]
    rules = [("org", "/", "allow"), ("org", "", "block"), ("a.org", "/es/", "block"), ("b.a.org", "/en/1", "block"), ("org", "/en/12", "allow"), ("com", "/es/", "block"), ("a.org", "/es/", "block")]
    pages = spark.createDataFrame([(k, u, "r") for k, u in enumerate(urls)] + [(0, None, "r")], "page_id long, url string, rule string")
    got = urlrules.filter_urls(pages, rules).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judged(r.url, rules), r


def test_url_edges(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urlrules.filter_urls(empty, queries.URL_RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert urlrules.filter_urls(one, spark.createDataFrame([], "host string, path string, action string"), default="block").first().verdict == "block"


# -- substring dedup ------------------------------------------------------------------------------


def cut_by_brute_force(texts, window):
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[p : p + window]) for w in split for p in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {q for p in range(len(w) - window + 1) if seen[tuple(w[p : p + window])] > 1 for q in range(p, p + window)}
        out.append((len(w), len(gone), b" ".join(x for q, x in enumerate(w) if q not in gone)))
    return out


def test_repeats_agree_with_brute_force(spark, rows, sf_dir):
    want = sorted((r.doc_id, n, g, hashlib.sha256(k).hexdigest()) for r, (n, g, k) in zip(rows, cut_by_brute_force([r.text for r in rows], 35), strict=True))
    assert sorted(map(tuple, queries.op4_substring_dedup(spark, sf_dir).collect())) == want
    assert any(g for _, _, g, _ in want)


def test_repeats_inside_one_document_and_edges(spark, odd, none):
    loop = " ".join(["a b c"] * 40)
    made = odd.select("doc_id", "text").collect() + [(20, loop), (21, "x " * 36), (22, "x " * 35), (23, " ".join(f"q{k}" for k in range(34)))]
    frame = spark.createDataFrame([tuple(r) for r in made], "doc_id long, text string")
    want = sorted((str(r[0]), n, g, hashlib.sha256(k).hexdigest()) for r, (n, g, k) in zip(made, cut_by_brute_force([r[1] for r in made], 35), strict=True))
    got = repeats.remove_repeats(frame).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert all(r.n_removed == sum(s["to"] - s["from"] for s in r.spans) for r in got)
    assert repeats.remove_repeats(none).count() == 0
    left = repeats.cut_documents(odd)
    assert left.columns == odd.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "3", "6", "7", "None"]


# -- quality --------------------------------------------------------------------------------------


def test_sum_of_squares_identity():
    rng = np.random.default_rng(3)
    machine = quality.FactorisationMachine(0.1, rng.normal(size=50), rng.normal(size=(50, 3)))
    ids, x = rng.choice(50, 12, False), rng.normal(size=12) / 4
    pairs = sum(machine.v[a] @ machine.v[b] * x[i] * x[j] for i, a in enumerate(ids) for j, b in enumerate(ids) if i < j)
    assert math.isclose(machine.score(ids, x), 1 / (1 + math.exp(-(0.1 + machine.w[ids] @ x + pairs))))


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    got = queries.op5_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    out = [r for r in got if r.held_out]
    good, bad = ([r.score for r in out if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    assert np.mean([r.predicted == r.quality for r in out]) > 0.97


def test_quality_edges(odd, none, spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    got = quality.judge_quality(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.judge_quality(none, labels).count() == 0
    blank = quality.judge_quality(odd, labels.limit(0)).collect()
    assert all(abs(r.score - 0.5) < 0.05 for r in blank)


def test_quality_scores_agree_with_a_plain_loop(spark, sf_dir, odd):
    """All pairs of features written out, document by document, with and without the documents' n_chars."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    for frame in (docs.limit(25), docs.select("doc_id", "text").limit(10), odd.select("doc_id", "text")):
        model = quality.fit_quality(docs, labels, max_rows=200)
        for r in quality.score_quality(frame, model).collect():
            ids, x = quality.features((r.text or "").encode(), r.n_chars if "n_chars" in frame.columns else None)
            vx = [model.v[i].astype(float) * float(a) for i, a in zip(ids, x, strict=True)][:400]
            z = model.bias + sum(float(model.w[i]) * float(a) for i, a in zip(ids, x, strict=True))
            if len(ids) <= 400:
                z += sum(float(vx[i] @ vx[j]) for i in range(len(vx)) for j in range(i))
                assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-4


# -- token counts ---------------------------------------------------------------------------------


def test_token_counts_equal_whole_text_encoding(spark, rows, sf_dir, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    whole = Tokenizer.from_file(path)
    special = ["a<|endoftext|>b", "\u4e2d\u6587 \U0001f600", "it's  we'll\n\n  x\t\ty ", "''s ''' 1 234 \x1c\x85\u00a0z", "   ", "\u0130\u0661"]
    extra = spark.createDataFrame(list(enumerate(special)), "doc_id long, text string")
    for frame in (spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string"), extra, odd.select("doc_id", "text")):
        want = sorted((str(r.doc_id), len((r.text or "").encode()), len(whole.encode(r.text or "", add_special_tokens=False).ids)) for r in frame.collect())
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in tokencount.count_tokens(frame, path).collect()) == want
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in tokencount.count_tokens(frame, path, hot=40).collect()) == want
    assert tokencount.count_tokens(none, path).count() == 0
    assert {r.over_limit == (r.n_tokens > 1024) for r in queries.op6_token_counts(spark, sf_dir).collect()} == {True}


def test_token_counts_of_many_scripts(spark):
    """Texts mostly outside Latin script, with characters of all planes, equal texts and added tokens between."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    whole, rng = Tokenizer.from_file(path), random.Random(3)
    planes = [(0x20, 0x7F), (0x80, 0x2FF), (0x300, 0x600), (0x600, 0x800), (0x900, 0xE00), (0x1000, 0x1400), (0x2000, 0x2100), (0x3040, 0x3100), (0x4E00, 0x5000), (0xAC00, 0xAD00), (0x1F300, 0x1F700), (0x10000, 0x11000), (0x1D7C0, 0x1D800), (0, 0x30)]
    texts = ["".join(chr(rng.randrange(*rng.choice(planes))) if rng.random() < 0.8 else " " for _ in range(rng.randrange(0, 200))) for _ in range(300)]
    texts += texts[:40] + [t[:50] + "<|endoftext|>" + t[50:] for t in texts[:20]] + ["<|endoftext|><|endoftext|>"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = sorted((k, len(t.encode()), len(whole.encode(t, add_special_tokens=False).ids)) for k, t in enumerate(texts))
    for hot in (25, 1 << 18):
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in tokencount.count_tokens(frame, path, hot=hot).collect()) == want


def test_tokenizers_that_change_the_text_are_refused():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError, match="byte-level"):
        tokencount.cutting_rules(f.read())


# -- search ---------------------------------------------------------------------------------------


def bm25(texts, query, k1=1.2, b=0.75):
    bags = [Counter(w.lower() for w in words(t)) for t in texts]
    mean = sum(sum(x.values()) for x in bags) / len(bags)
    scores = [0.0] * len(bags)
    for w in {w.lower() for w in words(query)}:
        df = sum(w in x for x in bags)
        if df:
            idf = math.log1p((len(bags) - df + 0.5) / (df + 0.5))
            for k, x in enumerate(bags):
                if w in x:
                    scores[k] += idf * x[w] * (k1 + 1) / (x[w] + k1 * (1 - b + b * sum(x.values()) / mean))
    return scores


@pytest.mark.parametrize("shard", [3, 7, 4096])
def test_search_agrees_with_brute_force(spark, rows, docs, shard, monkeypatch):
    asked = docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    got = defaultdict(list)
    monkeypatch.setattr(search, "SHARD", shard)
    for r in search.search_top_k(docs, asked, k=10, block_words=2000).collect():
        got[r.query_id].append((r["rank"], r.doc_id, r.score))
    for q in asked.collect():
        scores = bm25([r.text for r in rows], q.text)
        best = sorted(((-s, r.doc_id) for s, r in zip(scores, rows, strict=True) if s > 0))[:10]
        mine = sorted(got[q.query_id])
        assert np.allclose([s for _, _, s in mine], [-s for s, _ in best])
        assert [k for k, _, _ in mine] == list(range(1, len(best) + 1))
        by_id = {r.doc_id: s for r, s in zip(rows, scores, strict=True)}
        assert all(math.isclose(by_id[d], s) for _, d, s in mine)


def test_search_edges(spark, odd, none):
    ask = spark.createDataFrame([(1, "s1 s2"), (2, None), (3, ""), (None, "s1"), (4, "absent")], "query_id long, text string")
    got = search.search_top_k(odd, ask, k=2).collect()
    assert [(r.query_id, r.doc_id, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 5, 1), (1, 5, 2)]
    assert search.search_top_k(none, ask).count() == 0 and search.search_top_k(odd, ask.limit(0)).count() == 0


# -- HTML extraction ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("plain  words", "plain words"), ("<html><body></body></html>", ""),
        ("<body><nav><a href='/'>Home</a></nav><article><h1>T &amp; U</h1><p>One,\n two.<p>Three<br>four.</article><footer>f</footer></body>", "T & U One, two. Three four."),
        ("<body><div class='cookie-notice'>We use cookies, many.</div><div id='content'><p>A long paragraph, with commas, and more.</p><p>Short.</p></div><div class=sidebar><p>See, also, this.</p></div></body>", "A long paragraph, with commas, and more. Short."),
        ("<script>if (a < b) x('<p>no</p>')</script><main><p>Yes, <b>bold</b><i>er</i>.</p><form>mail: <input></form><section class='comments'><p>First!, wow, nice.</p></section></main>", "Yes, bolder."),
        ("<article><header><h1>Head</h1></header><p>Body text, here.</p><!-- <p>no</p> --><aside>no</aside></article><style>p{}", "Head Body text, here."),
        ("<p>unclosed <b>x<p>y", "unclosed x y"),
    ],
)
def test_extraction(page, text):
    assert extract.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h1>T</h1><p class=lead>Lead, short.</p><div class=body><p>" + "Long, very long. " * 20 + "</p></div></article>", "T Lead, short. " + ("Long, very long. " * 20).strip()),
        ("<article><div class=a><p>" + "One, two. " * 30 + "</p></div><div class=b><p>" + "Three, four. " * 8 + "</p></div></article>", ("One, two. " * 30 + "Three, four. " * 8).strip()),
        ("<body><div class=a><p>" + "One, two. " * 30 + "</p></div><div class=b><p>" + "Three, four. " * 8 + "</p></div></body>", ("One, two. " * 30 + "Three, four. " * 8).strip()),
    ],
)
def test_extraction_keeps_nested_and_split_articles(page, text):
    assert extract.main_text(page) == text


LONG = "A paragraph of some length, with commas, and more than one sentence. It goes on, and on. "
BODY = "".join(f"<p>{LONG}{k}</p>" for k in range(4))
READ = " ".join(f"{LONG}{k}" for k in range(4))
NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body>{NAV}<div class='content has-sidebar'><h1>T</h1>{BODY}</div><footer>f, g, h</footer></body>", f"T {READ}"),
        (f"<body>{NAV}<div class='elementor'><div class='elementor-widget w1'><h1>T</h1></div>" + "".join(f"<div class='elementor-widget w2'><p>{LONG}{k}</p></div>" for k in range(4)) + "</div></body>", f"T {READ}"),
        (f"<body><form action=x>{NAV}<div id=page><h1>T</h1>{BODY}<select><option>one<option>two</select></div></form></body>", f"T {READ}"),
        (f"<body>{NAV}<article class='post share-enabled'><h1>T</h1>{BODY}</article></body>", f"T {READ}"),
        (f"<body>{NAV}<div><h1>T</h1>{BODY}</div><div><p>Also read, today.</p></div></body>", f"T {READ}"),
        (f"<body><article><h1>T</h1>{BODY}</article><section class='ugc'><p>{LONG}</p><p>Nice, really.</p></section></body>", f"T {READ}"),
        (f"<body><main><article><h1>T</h1>{BODY}</article><section class='comments'>" + f"<p>{LONG}</p>" * 40 + "</section></main></body>", f"T {READ}"),
        (f"<body><h1>T</h1>{BODY}<p>© 2020 Somebody, all rights reserved.</p></body>", f"T {READ}"),
        (f"<body>{'<div>' * 600}<div class=menu><a href=/>Home</a></div>{'</div>' * 600}<article><h1>T</h1>{BODY}</article></body>", f"T {READ}"),
        (f"<body><article><h1>T</h1>{BODY}<object data=x>{BODY}</article></body>", f"T {READ}"),
        (f"<body><object data=x><article><h1>T</h1>{BODY}</article></body>", f"T {READ}"),
        (f"<body>{NAV}<article><h1>T</h1><figure><img src=x><figcaption>A caption, short.</figcaption></figure>{BODY}</article></body>", f"T A caption, short. {READ}"),
        (f"<body><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul><h1>T</h1><div class=lead>Short lead.</div><div class=text>{BODY}</div><div>More to read.</div></body>", f"T Short lead. {READ}"),
        (f"{NAV}<footer>f, g, h</footer>", ""),
        (f"<article><p title='unclosed>{BODY}</article>", READ),
        (f"<body><p>{LONG}</p><p title=\"cut off", LONG.strip()),
    ],
)
def test_extraction_weighs_marks(page, text):
    assert extract.main_text(page) == text


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 350_000 + '"', "<a <a \" > " * 80_000, "<div>" * 200_000 + "x", "<b>" * 150_000 + "<div>x</div>" * 20_000, "<p><table>" + "<b>" * 80_000 + "<ul></ul>" * 80_000,
        "<title>" * 140_000, "<ul>" + "<div>" * 80_000 + "<li></li>" * 60_000, "</p>" * 250_000, "<!-- " * 200_000, "<" * 1_000_000, "<textarea><object>" * 50_000,
        "".join(f"<div class='menu c{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}'>text, {k}. " for k in range(25_000)),
    ],
)
def test_hostile_pages_take_linear_time(page):
    begun = time.perf_counter()
    extract.main_text(page)
    assert time.perf_counter() - begun < 30 * max(1, len(page) / 1e6)


def test_extraction_of_all_pages(spark, sf_dir):
    import html

    got = {r.page_id: r for r in queries.op8_html_extraction(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)\b[^>]*>", inner)]
        assert got[r.page_id].text == " ".join(x for x in parts if x) and got[r.page_id].n_chars == len(got[r.page_id].text)
    odd = spark.createDataFrame([(1, None, None, "t"), (2, "u", "", "t"), (2, "u", "", "t")], "page_id long, url string, html string, text string")
    assert [(r.text, r.n_chars) for r in extract.extract_pages(odd).collect()] == [("", 0)] * 3
    assert extract.extract_pages(odd.limit(0)).count() == 0


# -- pseudo-likelihood ----------------------------------------------------------------------------


def test_network_gradient():
    rng = np.random.default_rng(4)
    flat = pseudolikelihood.WindowNetwork.start(1).astype(np.float64)
    context, target = rng.integers(0, 129, (40, 4)), rng.integers(0, 128, 40)
    loss = lambda p: -pseudolikelihood.WindowNetwork(p).log_chances(context, target).mean()
    net = pseudolikelihood.WindowNetwork(flat)
    net.step(context, target, 1.0)
    moved = flat - net.flat()
    step = moved / np.linalg.norm(moved)
    slope = (loss(flat + 1e-2 * step) - loss(flat - 1e-2 * step)) / 2e-2
    assert math.isclose(slope, np.linalg.norm(moved), rel_tol=0.05)


def test_chances_add_up_to_one():
    counts = np.random.default_rng(5).integers(0, 50, pseudolikelihood.WORDS).astype(float)
    known = pseudolikelihood.Vocabulary.build(counts)
    once = (known.counts + pseudolikelihood.FLOOR) / known.weights[known.of]
    assert np.allclose(np.bincount(known.of, once, pseudolikelihood.CLASSES), 1)
    at = np.arange(2000)
    want = np.log((np.maximum(counts[at] - 1, 0) + 0.1) / (known.weights[known.of[at]] - 1))
    assert np.allclose(known.log_share(at), want)


def test_scores_agree_with_a_plain_loop(spark, docs, monkeypatch):
    """Each position by itself: window, hidden layer, softmax and share written out."""
    rows = docs.select("doc_id", "text").limit(30)
    flat = pseudolikelihood.WindowNetwork.start(3)
    monkeypatch.setattr(pseudolikelihood, "train", lambda *a, **k: flat)
    got = {r.doc_id: r for r in pseudolikelihood.score_likelihood(rows).collect()}
    texts = {r.doc_id: words(r.text) for r in rows.collect()}
    number = lambda w: zlib.crc32(w) % 2**22 // 16 * 16 + (w[-1] * 167 + (w[-2] if len(w) > 1 else 0) * 59) // 8 % 16
    count = Counter(number(w) for ws in texts.values() for w in ws)
    known = pseudolikelihood.Vocabulary.build(np.array([count[k] for k in range(2**22)], float))
    net = pseudolikelihood.WindowNetwork(flat)
    weight = Counter()
    for k in range(2**22):
        weight[int(known.of[k])] += count[k] + 0.1
    for i, ws in texts.items():
        classes = [int(known.of[number(w)]) for w in ws]
        total = new = 0.0
        for p, c in enumerate(classes):
            near = [classes[q] if 0 <= q < len(ws) else 128 for q in (p - 2, p - 1, p + 1, p + 2)]
            z = np.tanh(np.concatenate([net.embed[x] for x in near]) @ net.inner + net.shift) @ net.outer + net.base
            n = count[number(ws[p])]
            total += z[c] - math.log(sum(math.exp(x) for x in z)) + math.log((n - 1 + 0.1) / (weight[c] - 1))
            new += n == 1
        assert got[i].n_words == len(ws) and (not ws or math.isclose(got[i].log_likelihood, total, rel_tol=1e-4))
        assert not ws or (math.isclose(got[i].mean_log_likelihood, total / len(ws), rel_tol=1e-4) and math.isclose(got[i].unseen_share, new / len(ws)))


def test_context_helps_and_copies_are_told_apart(spark):
    """On held-out texts of two invented languages the window beats the class frequencies, and what occurs twice has no unseen words."""
    rng = np.random.default_rng(6)
    tongues = [[f"{''.join(rng.choice(list(letters), 4))}{end}" for _ in range(400)] for letters, end in (("abcdefg", "ing"), ("hijklmn", "eux"))]
    say = lambda k: " ".join(rng.choice(tongues[k % 2], 60))
    docs = [(k, f"{say(k)} only{k}a only{k}b") for k in range(400)]
    docs += [(k + 1000, t) for k, t in docs[:20]]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    known = pseudolikelihood.Vocabulary.build(pseudolikelihood.count_words(frame))
    net = pseudolikelihood.WindowNetwork(pseudolikelihood.train(frame, known, rounds=4, stride=1))
    classes = [known.of[pseudolikelihood.word_numbers(say(k).encode())] for k in range(40)]
    base = np.log(np.bincount(known.of, known.counts, 128)[np.concatenate(classes)] / known.counts.sum())
    gain = np.concatenate([net.log_chances(pseudolikelihood.contexts(c), c) for c in classes]) - base
    assert gain.mean() > 0.3
    unseen = {r.doc_id: r.unseen_share for r in pseudolikelihood.score_likelihood(frame).collect()}
    assert max(unseen[k] for k in (*range(20), *range(1000, 1020))) < min(unseen[k] for k in range(20, 400))


def test_training_takes_every_position_once():
    import inspect

    default = inspect.signature(pseudolikelihood.train).parameters
    rounds = default["rounds"].default
    stride = default["stride"].default or rounds
    for n in (*range(1, 40), 997):
        at = np.concatenate([pseudolikelihood.targets(n, turn, rounds, stride) for turn in range(rounds)])
        assert sorted(at.tolist()) == list(range(n))


def test_scores_prefer_text_like_the_corpus(spark, docs, odd, none):
    rare = docs.limit(8).select((F.col("doc_id") + 10_000).alias("doc_id"), F.concat_ws(" ", F.transform(F.split("text", " "), lambda w: F.md5(w))).alias("text"))
    both = pseudolikelihood.score_likelihood(docs.select("doc_id", "text").unionByName(rare)).collect()
    assert len(both) == docs.count() + 8 and all(r.log_likelihood <= 0 for r in both)
    usual = [r.mean_log_likelihood for r in both if r.doc_id < 10_000]
    assert all(r.mean_log_likelihood < np.median(usual) for r in both if r.doc_id >= 10_000)
    rng = np.random.default_rng(8)
    say = lambda p: " ".join(f"w{(k * 3 + p) % 17}" for k in range(80))
    ordered = [(k, say(k)) for k in range(150)]
    mixed = [(k + 1000, " ".join(rng.permutation(t.split()))) for k, t in ordered[:15]]
    frame = spark.createDataFrame(ordered + mixed, "doc_id long, text string")
    mean = {r.doc_id: r.mean_log_likelihood for r in pseudolikelihood.score_likelihood(frame, rounds=6, stride=1).collect()}
    assert min(mean[k] for k, _ in ordered) > max(mean[k] for k, _ in mixed)
    edge = pseudolikelihood.score_likelihood(odd).collect()
    assert [(r.n_words, r.log_likelihood, r.mean_log_likelihood) for r in edge if r.doc_id == 1] == [(0, 0.0, None)]
    assert pseudolikelihood.score_likelihood(none).count() == 0


# -- SimHash --------------------------------------------------------------------------------------


def print_of(text, width=3):
    w = [x.lower() for x in words(text)]
    runs = [b" ".join(w)] if len(w) < width else [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)]
    hashes = [xxh64_intdigest(r, 42) for r in runs] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(prints, bound):
    up = {p: p for p in prints}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= bound:
                up[top(a)] = top(b)
    return {p: top(p) for p in prints}


def near_by_brute_force(rows):
    prints = {k: print_of(t) for k, (_, t) in enumerate(rows)}
    root = components_of(set(prints.values()), 2)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[prints[k]]].append(i)
    return sorted((str(i), f"{prints[k]:016x}", min(least[root[prints[k]]], default=None)) for k, (i, _) in enumerate(rows))


def test_near_duplicates_agree_with_brute_force(spark, rows, sf_dir, odd, none):
    want = near_by_brute_force([(r.doc_id, r.text) for r in rows])
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, sf_dir).collect()) == want
    want = near_by_brute_force([(r.doc_id, r.text) for r in odd.collect()])
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect()) == want
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("bound", "large"), [(2, 2000), (2, 3), (1, 3), (4, 2000), (7, 2000)])
def test_groups_of_planted_fingerprints(spark, bound, large, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = np.random.default_rng(bound)
    prints = []
    for base in rng.integers(0, 2**63, 25):
        p = int(base)
        for _ in range(12):
            prints.append(p)
            for b in rng.choice(20, int(rng.integers(0, bound + 3)), False):
                p ^= 1 << int(b)
    frame = spark.createDataFrame([(np.uint64(p).astype(np.int64).item(),) for p in prints], "f0 long")
    root = components_of(set(prints), bound)
    want = defaultdict(set)
    for p in set(prints):
        want[root[p]].add(p)
    got = defaultdict(set)
    for r in simhash.near_groups(frame, bound=bound).collect():
        got[r.group].add(r.f0 & (2**64 - 1))
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_thresholds_follow_the_general_pigeonhole():
    rng = np.random.default_rng(6)
    for bound in (2, 3, 6):
        for parts in range(2, 5):
            groups = simhash.group_bits(np.corrcoef(rng.normal(size=(64, 200))), parts)
            assert sorted(b for g in groups for b in g) == list(range(64))
            cost, chosen = simhash.allot(groups, list(rng.uniform(1, 1e6, parts)), np.full(64, 0.5), 1000, bound)
            assert sum(chosen) == bound - parts + 1 and cost < math.inf


def test_keep_one_of_each_group(odd, none):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "7", "None", "None"]
    assert simhash.keep_one(none).count() == 0


def test_keep_one_measures_what_the_bits_propose(spark):
    """No link below 0.8 on drifting copies or on a much-repeated run; SimHash may miss a few at the edge."""
    rng = np.random.default_rng(12)
    texts = []
    for g in range(12):
        now = [f"g{g}x{k}" for k in range(120)]
        for k in range(8):
            texts.append(" ".join(now))
            for at in rng.choice(120, 1 + k % 3, False):
                now[at] = f"n{g}k{k}a{at}"
    texts += ["p q r s t " * 40 + "left side of it here", "p q r s t " * 40 + "other words stand at this end"]
    sets = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                up[max(top(a), top(b))] = min(top(a), top(b))
    want = [i for i in range(len(texts)) if top(i) == i]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(frame).collect()}
    assert set(want) <= kept and len(kept) <= len(want) + 3 and 14 < len(want) < len(texts) - 30


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (102, 101), (7, 7), (200, 300), (None, 4)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 102: 100, 200: 200, 300: 200}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0
