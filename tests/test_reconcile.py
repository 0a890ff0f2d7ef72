"""Anchors to symbols, digests and stamps, freshness, budgets, commands, stored graphs and what is read off a graph."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import regions as R
from waymark.jobs import check as C
from waymark.jobs import reads
from waymark.jobs.graph import Refused, committed_stamps, compile_graph, lock_rows, read_lock, stamp_claims, write_lock
from waymark.operators import commands, history, resolve
from waymark.sources import files as S
from waymark.sources.config import Settings, read_settings

NODE = """```graph
kind: container
purpose: pages
budget: 12
invariants:
  - claim: totals add up
    anchor: web/sum.py#total
  - claim: said twice
    anchor: web/sum.py#twice
    enforced_by: web/sum.py
hazards:
  - claim: documented
    anchor: notes.md#c1
  - claim: nowhere
    anchor: web/sum.py#gone
  - claim: outside
    anchor: ../up.py#x
```

## Style notes

a few words more than fit in here
"""
FILES = {
    "AGENTS.md": "```graph\nkind: system\npurpose: all\ncommands:\n  test: A=1 just check && ./tool.sh | sort -u\n  lint: just gone; nothere x\nhazards:\n  - claim: root hazard\n    anchor: ※ top\n```\n",
    "web/AGENTS.md": NODE,
    "web/sum.py": "import os\n# ※ top\n\ndef total(xs):\n    return sum(xs)\n\ndef twice(): pass\ndef twice(): pass\n",
    "notes.md": "# Notes\n\n## C1: one\n\n## C10: ten\n\n```\n## C1 again\n```\n",
    "justfile": "check:\n  true\n", "tool.sh": "", "web/plain.txt": "※ other\n",
}


def frame(spark, changes=None):
    made = {**FILES, **(changes or {})}
    return spark.createDataFrame([(p, bytearray(c.encode())) for p, c in made.items() if c is not None], "path string, content binary")


@pytest.fixture(scope="module")
def graph(spark):
    return compile_graph(frame(spark))


def test_symbols_resolve_once_never_or_several_times(spark, graph):
    got = {r.anchor: (r.resolution, r.resolved) for r in graph.claims.collect()}
    assert got == {
        "web/sum.py#total": ("resolved", "web/sum.py:4"), "web/sum.py#twice": ("ambiguous", None), "notes.md#c1": ("resolved", "notes.md:3"),
        "web/sum.py#gone": ("unresolved", None), "../up.py#x": ("unresolved", None), "※ top": ("resolved", "web/sum.py:2"),
    }
    said = {r.message for r in C.referential(graph, frame(spark), S.Notation()).collect()}
    assert said == {
        'anchor web/sum.py#twice ambiguous (>1 definitions of "twice" in web/sum.py)', 'anchor web/sum.py#gone unresolved (0 definitions of "gone" in web/sum.py)',
        "anchor ../up.py#x unresolved (../up.py is not a repository-relative path)",
    }


def test_stamps_survive_the_stored_graph(spark, graph, tmp_path):
    stamps = stamp_claims(graph, S.readable(frame(spark)), "abc1234").cache()
    assert {(r.slug, r.verified_digest is None) for r in stamps.collect()} == {("total", False), ("top", False), ("c1", True)}
    write_lock(lock_rows(graph, stamps), str(tmp_path / "lock"))
    back = read_lock(spark, str(tmp_path / "lock"))
    key = lambda f: sorted(map(tuple, f.select("node_id", "slug", "verified_sha", "verified_digest").collect()), key=str)
    assert key(committed_stamps(back)) == key(stamps)
    with pytest.raises(Refused):
        read_lock(spark, str(tmp_path / "lock"), version=4)
    assert C.write_baseline(spark.createDataFrame([("a", "vestigial", "b")], "node string, direction string, target string"), str(tmp_path / "base")) is None
    assert [tuple(r) for r in C.read_baseline(spark, str(tmp_path / "base")).collect()] == [("a", "vestigial", "b")]
    spark.createDataFrame([("a", "other", "b")], "node string, direction string, target string").write.json(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="baseline"):
        C.read_baseline(spark, str(tmp_path / "bad"))


def test_freshness_and_blame(spark):
    files = frame(spark, {"web/AGENTS.md": NODE.replace("web/sum.py#twice", "notes.md#c10"), "web/plain.md": "# Plain\n"})
    graph, texts = compile_graph(files), S.readable(files)
    now = {(r.node_id, r.slug): r.verified_digest for r in stamp_claims(graph, texts, "x").collect()}
    stamps = spark.createDataFrame(
        [("web", "total", "s1", "drifted"), ("/", "top", "s1", now["/", "top"]), ("web", "c1", "s1", None), ("web", "c10", "lost", None), ("web", "gone", "s1", None)],
        "node_id string, slug string, verified_sha string, verified_digest string",
    )
    commits = spark.createDataFrame([(k, f"s{k}", f) for k, f in ((1, "notes.md"), (2, "notes.md"), (3, "notes.md"), (3, "web/sum.py"))], "seq long, sha string, file string")
    states = C.claim_states(graph, texts, stamps, commits).cache()
    assert {r.slug: (r.outcome, r.n_later if r.outcome == "churn" else None) for r in states.collect()} == {
        "total": ("stale", None), "top": ("fresh", None), "c1": ("churn", 2), "c10": ("history-unavailable", None), "gone": ("unresolved", None), "x": ("unverified", None),
    }
    said = lambda **k: {r.message for r in C.freshness(states, graph.nodes, **k).collect()}
    assert said() == {"claim web/total — digest of its region total changed"}
    assert said(threshold=1, leash=5) == said() | {"claim web/c1 — anchored file changed in 2 commits, past its leash 1", "claim web/c10 — cannot verify freshness: history unavailable"}
    assert said(threshold=2) == said()
    own = spark.createDataFrame([("web", 1)], "node_id string, threshold long")
    assert "claim web/c1 — anchored file changed in 2 commits, past its leash 1" in said(threshold=9, overrides=own)


def test_budgets_name_the_largest_part(spark, graph):
    got = C.token_budgets(graph, S.readable(frame(spark)), S.Notation(), root_cap=5).collect()
    assert {(r.node, r.profile) for r in got} == {("web", "node"), ("/", "root")}
    assert next(r.detail for r in got if r.node == "web").startswith("largest contributor: authored block (")
    parts = R.segments("# T\n\nx\n```graph\nk: v\n```\n<!-- @graph index -->\nr\n<!-- @end -->\n\n## N\ny\n", "graph")
    assert [p for p, _ in parts] == ['unmanaged prose block "# T"', "authored block", "generated index region", 'unmanaged prose block "## N"']
    assert R.segments("```graph\nopen", "graph")[0][0] == "authored block" and R.segments("\n\n", "graph") == []


def test_commands_resolve_by_text(spark, graph):
    assert list(R.command_words("A=1 B='x y' make \"a b\" && cd x|grep 'q;r' ; C=2 npm\\ run t || true")) == [["make", "a b"], ["cd", "x"], ["grep", "q;r"], ["npm run", "t"], ["true"]]
    assert R.manifest_tasks("justfile", 'build x="1":\n  make\nalias b := build\nv := "x"\n@quiet:\n') == ("just", ["build", "b", "quiet"])
    assert R.manifest_tasks("package.json", '{"scripts": {"a": "x"}}') == ("npm", ["a"]) and R.manifest_tasks("package.json", "[") == ("npm", [])
    assert R.manifest_tasks(".cargo/config.toml", '[alias]\nx = "run"\n') == ("cargo", ["x"]) and R.manifest_tasks("other", "") is None
    got = {(r.node, r.message) for r in C.liveness(graph, S.readable(frame(spark)), frame(spark), programs=["sort"]).collect()}
    assert got == {("/", "command lint does not resolve: gone is no task of just"), ("/", "command lint does not resolve: nothere is no known program or tracked file")}
    assert commands.manifest_tasks(S.readable(frame(spark))).count() == 1


def test_lookups_suggest(spark):
    nodes = spark.createDataFrame([("/",), ("web",), ("web/store",), ("api/store",), ("api/pay-out",)], "id string")
    asked = spark.createDataFrame([("./web/",), ("store",), ("pay-out",), ("pay",), ("zzz",), ("/",)], "query string")
    got = {r.query: (r.outcome, r.id, sorted(r.candidates)) for r in resolve.node_lookup(asked, nodes).collect()}
    assert got == {
        "./web/": ("found", "web", []), "store": ("ambiguous", None, ["api/store", "web/store"]), "pay-out": ("found", "api/pay-out", []),
        "pay": ("unknown", None, ["api/pay-out"]), "zzz": ("unknown", None, ["/", "api/pay-out", "api/store", "web", "web/store"]), "/": ("found", "/", []),
    }


def test_reads(spark, graph):
    assert [(r.slug, r.node_id) for r in reads.hazards(graph).orderBy("slug", "node_id").collect()] == [("c1", "web"), ("gone", "web"), ("top", "/"), ("x", "web")]
    assert [(r.node_id, r.slug, r.place) for r in reads.anchors(graph).filter("slug = 'top'").collect()] == [("web", "top", "sum.py:2")]
    assert [(r.node_id, r.id) for r in reads.router(graph).collect()] == [("/", "web")]
    assert {r.section for r in reads.root(graph).collect()} == {1, 2, 3, 4}
    body = {r.node_id: r.body for r in reads.regions(graph).collect()}
    assert body["web"].startswith("## Anchors in this territory\n\n- ※ other → plain.txt:1\n- ※ top → sum.py:2\n")
    text = lambda rows: spark.createDataFrame(rows, "path string, text string")
    assert {tuple(r) for r in reads.differences(text([("a", "1"), ("b", "2"), ("c", "3")]), text([("b", "2"), ("c", "4"), ("d", "5")])).collect()} == {("a", "missing"), ("c", "changed"), ("d", "stale")}
    assert [tuple(r) for r in reads.proposable(text([("a/x", ""), ("b/y", ""), ("b/z/q", ""), (".git/h", ""), ("r", "")]), spark.createDataFrame([("a/sub",)], "dir string")).collect()] == [("b", 2)]
    assert reads.with_overlay(text([("a", "1"), ("b", "2")]), text([("b", "3")])).orderBy("path").collect()[1].text == "3"
    assert [r.path for r in reads.untracked_nodes(text([("x/AGENTS.md", ""), ("AGENTS.md", ""), ("y", "")]), text([("AGENTS.md", "")]), "AGENTS.md").collect()] == ["x/AGENTS.md"]
    found = C.check(graph, frame(spark), S.readable(frame(spark)), only=("referential",))
    assert {(r["class"], r.n) for r in C.summary(found).collect()} == {("referential", 3), ("all", 3), *((c, 0) for c in C.CLASSES if c != "referential")}
    assert C.findings_json(found).count() == 3 and C.allow_report(graph).count() == 0


def test_settings_are_strict():
    made = read_settings('[budget]\nroot = 9\n[freshness]\nchurn_threshold = 3\n[freshness.node]\n"./web/" = 2\n[check]\ndisable = ["budget"]\n', C.CLASSES)
    assert made == Settings(root_tokens=9, churn_threshold=3, node_thresholds={"web": 2}, disable=("budget",)) and read_settings("", C.CLASSES) == Settings()
    for bad in ("x = 1", "[budget]\nother = 1", "[check]\ndisable = ['nope']", '[freshness.node]\n"a" = 1\n"a/" = 2', "[exhaustiveness]\ndepth = true", "[", "[exhaustiveness]\nexclude = [1]"):
        with pytest.raises(ValueError):
            read_settings(bad, C.CLASSES)


def test_history_lookups_agree_with_loops(spark):
    rng = random.Random(5)
    versions = [(f, k, rng.choice(["a", "b", None])) for f in "fgh" for k in sorted(rng.sample(range(60), 25))]
    claims = [(rng.choice("fghi"), rng.randrange(-1, 62), rng.choice(["a", "b"])) for _ in range(120)] + [("f", None, "a")]
    frame = spark.createDataFrame(versions, "file string, seq long, digest string")
    marked = spark.createDataFrame(claims, "file string, mark long, digest string")
    want = sorted((c, min((s for f, s, d in versions if c[1] is not None and f == c[0] and s > c[1] and d != c[2]), default=None)) for c in claims if c[1] is not None)
    got = sorted(((r.file, r.mark, r.digest), r.staled_by) for r in history.staling_commit(marked.filter("mark IS NOT NULL"), frame).collect())
    assert got == want
    later = {c[:2]: sum(f == c[0] and s > c[1] for f, s, _ in versions) for c in claims if c[1] is not None}
    counted = history.churn(marked.withColumn("threshold", F.lit(4).cast("long")), frame.select("file", "seq")).collect()
    assert all(r.n_later == later.get((r.file, r.mark), 0) and r.state == ("history-unavailable" if r.mark is None else "stale" if r.n_later > 4 else "fresh") for r in counted)
