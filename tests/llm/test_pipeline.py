"""The pipeline's stages against brute force, each on its own input."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from waymark.llm import decontam, quality, simhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+").findall


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Each stage's output over sf_dir, written and read again as the driver does."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [frame.collect() for frame in out], [frame.columns for frame in out]


def test_columns_stay_until_the_mix(stages):
    columns = stages[1]
    assert all(c == columns[0] for c in columns[:-1]) and columns[-1] == [*columns[0], "copy"]


def test_quality_rejects_what_it_scores_low(spark, sf_dir, stages):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = {r.doc_id for r in stages[0][0] if model.score(*quality.features((r.text or "").encode(), r.n_chars)) >= 0.3}
    assert {r.doc_id for r in stages[0][1]} == want and len(want) < len(stages[0][0])


def test_one_of_each_group_of_near_copies_stays(stages):
    """Against all pairs: sets of five-word runs with a Jaccard similarity of 0.8 or more are linked."""
    before, after = stages[0][1], {r.doc_id for r in stages[0][2]}
    sets = {r.doc_id: frozenset(simhash.shingle_hashes((r.text or "").encode(), 5).tolist()) for r in before}
    ids = sorted(sets)
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            one, two = sets[a], sets[b]
            if one == two or (min(len(one), len(two)) * 5 >= 4 * max(len(one), len(two)) and 9 * len(one & two) >= 4 * (len(one) + len(two))):
                up[max(top(a), top(b))] = min(top(a), top(b))
    assert after == {i for i in ids if top(i) == i} and len(after) < len(ids)


def test_repeated_passages_are_cut(stages):
    before, after = stages[0][2], {r.doc_id: r for r in stages[0][3]}
    split = {r.doc_id: WORD((r.text or "").encode()) for r in before}
    seen = Counter(tuple(w[p : p + 50]) for w in split.values() for p in range(len(w) - 49))
    for r in before:
        w = split[r.doc_id]
        gone = {q for p in range(len(w) - 49) if seen[tuple(w[p : p + 50])] > 1 for q in range(p, p + 50)}
        left = b" ".join(x for q, x in enumerate(w) if q not in gone).decode()
        if not gone:
            assert after[r.doc_id] == r
        elif left:
            assert after[r.doc_id].text == left and after[r.doc_id].n_chars == len(left)
        else:
            assert r.doc_id not in after


def test_no_leak_is_left_and_clean_documents_stay(spark, sf_dir, stages):
    items = [decontam.normal_form(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    held = {r.doc_id for r in stages[0][3] if any(i in decontam.normal_form(r.text) for i in items)}
    after = {r.doc_id for r in stages[0][4]}
    gone = {r.doc_id for r in stages[0][3]} - after
    assert held <= gone and len(gone) <= len(held) + 2


def test_mix_repeats_whole_documents(stages):
    before, after = {r.doc_id: r for r in stages[0][4]}, Counter()
    for r in stages[0][5]:
        assert tuple(r)[:-1] == tuple(before[r.doc_id])
        after[r.doc_id] += 1
    assert max(after.values()) <= 2
    size = {i: len(WORD((r.text or "").encode())) for i, r in before.items()}
    total = sum(size.values())
    assert abs(sum(after[i] * size[i] for i in after) - 1.5 * total) < 20 * np.max(list(size.values()))


def test_run_is_the_stages_in_a_row(spark, sf_dir, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, stages[0][5]))


def test_edges(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "some words here", "en", "a", 15), (4, "w " * 30_000, None, None, None)]
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, sf_dir)
            assert out.columns[: len(schema.names)] == schema.names and out.count() <= 2 * frame.count()


def test_own_columns_with_clashing_names_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    own = docs.selectExpr("*", "'c' AS copy", "doc_id + 1 AS repeats", "'s' AS score", "-1 AS predicted", "7 AS size", "'t' AS target")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, own, sf_dir)
        assert out.columns[: len(own.columns)] == own.columns
        for r in out.collect():
            assert (r.copy, r.repeats, r.score, r.predicted, r.size, r.target) == ("c", r.doc_id + 1, "s", -1, 7, "t")
