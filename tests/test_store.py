"""Publishing by version, comparing by ranges, and suggestions by substrings."""

import random

import pytest

from waymark.jobs import check, store
from waymark.jobs.graph import Refused, committed_stamps
from waymark.operators import diff, resolve
from waymark.sources.config import Settings

FILES = {"AGENTS.md": "```graph\nkind: system\npurpose: all\ninvariants:\n  - claim: adds\n    anchor: m.py#total\n```\n", "m.py": "def total(xs):\n    return sum(xs)\n"}


def frame(spark, changes=None):
    return spark.createDataFrame([(p, bytearray(c.encode())) for p, c in {**FILES, **(changes or {})}.items()], "path string, content binary")


def rows_of(spark, made):
    return spark.createDataFrame([("nodes", k, v) for k, v in made.items()], "part string, key string, value string")


def test_only_ranges_that_differ_are_compared(spark, tmp_path):
    rng, root = random.Random(4), str(tmp_path)
    old = {f"k{i}": str(rng.random()) for i in range(2000)}
    store.publish(rows_of(spark, old), root)
    assert store.changes(rows_of(spark, old), root).collect() == []
    new = {k: v + "x" if k in ("k5", "k77") else v for k, v in old.items() if k not in ("k9", "k1000")} | {"fresh": "1"}
    want = {("k5", "changed"), ("k77", "changed"), ("k9", "lost"), ("k1000", "lost"), ("fresh", "added")}
    assert {(r.key, r.change) for r in store.changes(rows_of(spark, new), root).collect()} == want
    tops, ranges = diff.differing_ranges(diff.range_digests(diff.ranged(rows_of(spark, old))), diff.range_digests(diff.ranged(rows_of(spark, new))))
    assert 1 <= len(tops) <= 5 and ranges.count() <= 5
    plan = store._rows(spark, store.current(spark, root)).filter(f"top IN ({', '.join(map(str, tops))})")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [top" in plan or "PartitionFilters: [isnotnull(top" in plan


def test_a_run_that_fails_leaves_the_old_graph(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    with pytest.raises(Refused, match="no graph"):
        store.read(spark, root)
    store.publish(rows_of(spark, {"a": "1"}), root)

    def die(*_):
        raise RuntimeError("killed between the two writes")

    with monkeypatch.context() as m:
        m.setattr(store, "_mark", die)
        with pytest.raises(RuntimeError):
            store.publish(rows_of(spark, {"a": "2"}), root)
    assert [r.value for r in store.read(spark, root).collect()] == ["1"]
    store.publish(rows_of(spark, {"a": "3"}), root)
    assert [r.value for r in store.read(spark, root).collect()] == ["3"]
    with pytest.raises(Refused, match="meanwhile"):
        store._mark(spark, root, "other", 1)
    monkeypatch.setattr(store, "FORM", 2)
    with pytest.raises(Refused, match="form"):
        store.read(spark, root)


def test_builds_stamp_and_checks_carry_stamps_over(spark, tmp_path):
    root = str(tmp_path)
    store.build(frame(spark), root, "abc1234")
    [stamp] = committed_stamps(store.read(spark, root)).collect()
    assert stamp.verified_sha == "abc1234" and len(stamp.verified_digest) == 64
    graph = store.compile_graph(frame(spark, {"m.py": FILES["m.py"].replace("sum", "max")}))
    assert store.drift(graph, root).collect() == []
    graph = store.compile_graph(frame(spark, {"m.py": "\n" + FILES["m.py"]}))
    assert [tuple(r) for r in store.drift(graph, root).collect()] == [("nodes", "/", "changed")]
    with pytest.raises(Refused, match="AGENTS.md"):
        store.build(frame(spark, {"AGENTS.md": "```graph\nkind: none\n```\n"}), root, "abc1234")
    assert committed_stamps(store.read(spark, root)).count() == 1


def test_substrings_by_the_rarest_gram(spark):
    rng = random.Random(7)
    ids = ["".join(rng.choice("ab/c") for _ in range(rng.randint(1, 9))) for _ in range(200)] + ["é\U0001f600x", "", "aaaa"]
    queries = [i[1:4] for i in ids] + ["zz", "", "a", "é", "\U0001f600x", "aaaa", "aaaaa"]
    got = resolve.containing(spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame([(i,) for i in ids], "id string"))
    assert {tuple(r) for r in got.collect()} == {(q, i) for q in queries if q for i in ids if q in i}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_checks_follow_the_settings(spark):
    files = {
        "AGENTS.md": "```graph\nkind: system\npurpose: all\ncommands:\n  a: mix deps.tree\n  b: cargo login && mix nothere\ninvariants:\n  - claim: adds\n    anchor: m.py#gone\n```\n",
        "mix.exs": "", "lib/a.go": "", "node_modules/x/y.js": "", "skip.me/z.go": "",
    }
    graph = store.compile_graph(spark.createDataFrame([(p, bytearray(c.encode())) for p, c in files.items()], "path string, content binary"))
    said = lambda settings, **more: [(r["class"], r.message) for r in check.check_with(graph, settings, **more).collect()]
    default = said(Settings(), programs=["cargo"])
    assert ("exhaustiveness", "lib (1 file) is covered by no node — unreachable via any router") in default and ("exhaustiveness", "skip.me (1 file) is covered by no node — unreachable via any router") in default
    assert not any("node_modules" in m for _, m in default) and [m for c, m in default if c == "liveness"] == ["command b does not resolve: nothere is no task of mix"]
    some = said(Settings(exclude=("skip.*", "lib", "node_modules"), disable=("referential", "liveness")), programs=["cargo"])
    assert some == [] and said(Settings(disable=check.CLASSES)) == []
    assert ("budget", "always-loaded set for / renders 22 tokens > 3") in said(Settings(root_tokens=3))
    texts = [r.value for r in check.findings_text(check.check_with(graph, Settings(disable=check.CLASSES[1:]))).collect()]
    assert texts == ['referential: anchor m.py#gone unresolved (0 definitions of "gone" in m.py)\n  claim now unanchored: adds']
