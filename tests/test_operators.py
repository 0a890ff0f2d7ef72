"""Operators on small graphs: the clean example and its mutations, order rules and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import budget, edges, history, ignore, prefix, resolve, tokens

NODES = [("/", ""), ("sites/web", "sites/web"), ("sales", "sites/web/lib/sales"), ("stock", "sites/web/lib/stock"), ("jobs", "sites/jobs"), ("kit", "libs/kit")]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(NODES, "id string, dir string").cache()


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_owner_is_the_deepest_directory(spark, nodes):
    files = spark.createDataFrame([(p,) for p in ("sites/web/lib/sales/sell.ex", "sites/web/libx/y.ex", "root.exs", "sites/webx/a", "sites/web/lib/sales/deep/er/z", "sites/web/lib/sales/sell.ex")], "path string")
    got = rows(prefix.territory_owner(files, nodes))
    assert got == sorted([("sites/web/lib/sales/sell.ex", "sales")] * 2 + [("sites/web/libx/y.ex", "sites/web"), ("root.exs", "/"), ("sites/webx/a", "/"), ("sites/web/lib/sales/deep/er/z", "sales")], key=str)
    bare = nodes.filter("dir <> ''")
    assert rows(prefix.territory_owner(files.limit(3), bare, fallback="/"))[0] == ("root.exs", "/")
    assert rows(prefix.territory_owner(files.filter("path = 'root.exs'"), bare)) == [("root.exs", None)]


def test_containment_goes_by_directory_not_id(spark, nodes):
    assert rows(prefix.contains_edges(nodes)) == sorted([("/", "sites/web"), ("/", "jobs"), ("/", "kit"), ("sites/web", "sales"), ("sites/web", "stock")], key=str)
    short = spark.createDataFrame([("/", ""), ("A", "A"), ("A/b", "A/b")], "id string, dir string")
    assert rows(prefix.contains_edges(short)) == [("/", "A"), ("A", "A/b")]


def test_exposure_is_inherited_upward(spark, nodes):
    claims = spark.createDataFrame([("/", "cents"), ("sales", "cap"), ("sales", "once"), ("jobs", "other")], "node_id string, slug string")
    asked = spark.createDataFrame([("sites/web/lib/sales/x",), ("sites/web/lib/stock/y",)], "path string")
    got = rows(prefix.inherited(asked, nodes, claims))
    assert [g[2] for g in got if "sales" in g[0]] == ["cents", "cap", "once"]
    assert [g[2] for g in got if "stock" in g[0]] == ["cents"]


def walk(files, covering, depth):
    """The descent, as a model: covered stops, passing through goes on, the rest is reported."""
    dirs = {}
    for f in files:
        parts = f.split("/")[:-1]
        for n in range(1, len(parts) + 1):
            dirs.setdefault("/".join(parts[:n]), 0)
            dirs["/".join(parts[:n])] += 1
    out = []

    def step(d, level, forced):
        if any(d == c or d.startswith(c + "/") for c in covering):
            return
        if any(c.startswith(d + "/") for c in covering):
            for child in [x for x in dirs if x.startswith(d + "/") and "/" not in x[len(d) + 1 :]]:
                step(child, level + 1, True)
        elif forced or level <= depth:
            out.append((d, dirs[d]))

    for top in [d for d in dirs if "/" not in d]:
        step(top, 1, False)
    return sorted(out)


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_uncovered_dirs_agree_with_the_descent(spark, depth):
    rng = random.Random(depth)
    for _ in range(4):
        files = ["/".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) + "/f" for _ in range(25)] + ["root"]
        covering = ["/".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(3)]
        got = prefix.uncovered_dirs(spark.createDataFrame([(f,) for f in files], "path string"), spark.createDataFrame([(c,) for c in [*covering, ""]], "dir string"), depth=depth)
        assert rows(got) == walk(files, covering, depth)


def test_structure_mutations(spark):
    table = lambda *e: spark.createDataFrame(list(e), "from_id string, to_id string")
    declared = table(("sales", "stock"), ("sales", "kit"), ("stock", "kit"))
    clean = table(("sales", "stock"), ("sales", "kit"), ("stock", "kit"), ("stock", "kit"))
    assert rows(edges.structural_violations(clean, declared)) == []
    more = clean.union(table(("stock", "sales")))
    assert rows(edges.structural_violations(more, declared)) == [("stock", "undeclared", "sales")]
    assert rows(edges.structural_violations(more, declared, table(("stock", "sales")))) == []
    less = clean.filter("NOT (from_id = 'sales' AND to_id = 'stock')")
    found = edges.structural_violations(less, declared)
    assert rows(found) == [("sales", "vestigial", "stock")]
    assert rows(edges.structural_violations(less, declared, table(("sales", "stock")))) == []
    assert rows(edges.subtract_frozen(found, found)) == []


def test_references_within_a_node_are_no_edges(spark, nodes):
    refs = spark.createDataFrame([("sites/web/lib/sales/a.ex", "sites/web/lib/stock/b.ex", 3), ("sites/web/lib/sales/a.ex", "sites/web/lib/sales/c.ex", 4), ("sites/web/lib/sales/a.ex", "sites/web/lib/stock/b.ex", 2)], "from_file string, to_file string, line int")
    assert rows(edges.edge_summary(edges.attribute_refs(refs, nodes), "from_file", "line")) == [("sales", "stock", 2, "sites/web/lib/sales/a.ex", 2)]


def test_hops_stop_on_an_empty_frontier(spark):
    graph = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "gone"), ("x", "y")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "id string")
    assert rows(edges.hops_from(graph, start, depth=4_294_967_295)) == [("a", 0), ("b", 1), ("c", 1), ("gone", 2)]
    assert rows(edges.hops_from(graph, start, depth=1)) == [("a", 0), ("b", 1), ("c", 1)]
    assert rows(edges.hops_from(graph, start, depth=0)) == [("a", 0)]


def test_tokens(spark):
    text = "~ one ~ two\n~  three\r\n~four ~ Five ~ six-7 x\n~ ~ seven"
    found = tokens.scan_tokens(spark.createDataFrame([("f", text), ("g", None), ("g", "~ one")], "file string, text string"), "text", "~ ", "file")
    assert rows(found) == sorted([("f", 1, "one"), ("f", 1, "two"), ("f", 3, "six-7"), ("f", 4, "seven"), ("g", 1, "one")], key=str)
    assert rows(tokens.landmark_winners(found, "file", "line").filter("n > 1")) == [("one", 2, "f", 1)]
    used = spark.createDataFrame([("one",), ("two",), ("absent",)], "slug string")
    assert rows(tokens.slug_cardinality(found, used)) == [("one", 2)]


def test_comments_and_headings(spark):
    pages = spark.createDataFrame([(1, "a<!-- x\n -->\n<!--y--><!-- z"), (2, None), (3, "<!-- a <!-- b -->")], "id int, t string")
    assert rows(tokens.html_comments(pages, "t", "id")) == [(1, 0, 1, " x\n "), (1, 1, 3, "y"), (3, 0, 1, " a <!-- b ")]
    heads = spark.createDataFrame([("r.md", "c1-money", 3), ("r.md", "c10-other", 9), ("r.md", "dup", 1), ("r.md", "dup-2", 5)], "path string, slug string, line int")
    wanted = spark.createDataFrame([("r.md", "c1"), ("r.md", "dup"), ("r.md", "none"), ("x.md", "c1")], "path string, symbol string")
    assert rows(tokens.resolve_headings(heads, wanted)) == [("r.md", "c1", 1, 3), ("r.md", "dup", 2, 1), ("r.md", "none", 0, None), ("x.md", "c1", 0, None)]


def test_module_probe_order(spark):
    files = spark.createDataFrame([(p,) for p in ("a/x.ts", "a/x.js", "a/y/index.tsx", "a/y.d.ts", "b/z.mts", "exact", "a/w.jsx", "a/v.tsx")], "path string")
    targets = spark.createDataFrame([(t,) for t in ("a/x", "a/x.js", "a/y", "b/z.mjs", "exact", "none", "a/v.js")], "target string")
    got = dict(rows(resolve.probe(targets, files, resolve.module_candidates(F.col("target")))))
    assert got == {"a/x": "a/x.ts", "a/x.js": "a/x.js", "a/y": "a/y/index.tsx", "b/z.mjs": "b/z.mts", "exact": "exact", "none": None, "a/v.js": "a/v.tsx"}
    packages = spark.createDataFrame([("@shop/kit", "libs/kit", "libs/kit/src/coin.ts", 0), ("lib", "l1", None, 1), ("lib", "l2", None, 2)], "name string, dir string, main string, ord int")
    asked = spark.createDataFrame([(s,) for s in ("@shop/kit", "@shop/kit/src/../x", "lib", "lib/q", "libx", "react")], "source string")
    assert dict(rows(resolve.bare_specifiers(asked, packages))) == {"@shop/kit": "libs/kit/src/coin.ts", "@shop/kit/src/../x": "libs/kit/x", "lib": "l1/index", "lib/q": "l1/q"}


def test_first_declarer_orders_by_segment(spark):
    declared = spark.createDataFrame([("M", "a-b/x"), ("M", "a/b/x"), (None, "z")], "module string, path string")
    assert rows(resolve.first_declarer(declared, "module", "path")) == [("M", "a/b/x")]


def test_claim_addresses(spark):
    claims = spark.createDataFrame([("/", "money"), ("a/web", "cap"), ("b/web", "cap"), ("a/web/billing", "x"), ("bare", None), ("web2", "cap")], "node_id string, slug string")
    asked = spark.createDataFrame([(a,) for a in ("//money", "a/web/cap", "web/cap", "billing/x", "billing/y", "none/x", "plain", "bare/x", "web2/cap")], "address string")
    got = {r.address: (r.outcome, r.node_id) for r in resolve.claim_lookup(asked, claims).collect()}
    no = ("not-found", None)
    assert got == {"//money": ("found", "/"), "a/web/cap": ("found", "a/web"), "web/cap": ("ambiguous", None), "billing/x": ("found", "a/web/billing"), "billing/y": no, "none/x": no, "plain": no, "bare/x": no, "web2/cap": ("found", "web2")}


def test_decisions(spark):
    files = spark.createDataFrame([(p,) for p in ("doc/adr/0007-a.md", "docs/adr/0008-b.md", "doc/adr/0007.md", "doc/adr/0007x-a.md", "doc/adr/sub/0009-c.md", "doc/adr/12-c.md")], "path string")
    assert rows(resolve.decision_records(files)) == [("doc/adr/0007", "0007", "doc/adr/0007-a.md"), ("doc/adr/12", "12", "doc/adr/12-c.md")]
    texts = {"---\nstatus: 'Accepted'\n---\nStatus: Rejected": "accepted", "x · Status: **Superseded** by": "superseded", "# T\n## Status\n\n  Draft now": "draft", "nothing": "unknown", "---\nx: y\n---\n### STATUS\nold": "old", "Status: 12\n": "unknown"}
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.s for r in frame.select("t", resolve.record_status(F.col("t")).alias("s")).collect()} == texts
    tokens_ = spark.createDataFrame([("§ 0007",), ("§ 7",), ("§ 12",), ("§ 12",), ("§ 3",)], "token string")
    records = spark.createDataFrame([("0007", "accepted", "p"), ("12", "superseded", "q"), ("3", "accepted", "r"), ("3", "accepted", "s")], "number string, status string, path string")
    assert rows(resolve.decision_references(tokens_, records, "§ ")) == [("§ 0007", 1, "ok"), ("§ 12", 2, "superseded"), ("§ 3", 1, "duplicated"), ("§ 7", 1, "missing")]


def test_freshness(spark):
    commits = spark.createDataFrame([("f", n) for n in range(1, 8)] + [("g", 3)], "file string, seq int")
    claims = spark.createDataFrame([("f", 2, 5), ("f", 2, 4), ("f", None, 1), ("g", 3, 0), ("g", 1, None), ("h", 1, 0)], "file string, mark int, threshold int")
    got = rows(history.churn(claims, commits).select("file", "mark", "threshold", "n_later", "state"))
    assert got == sorted([("f", 2, 5, 5, "fresh"), ("f", 2, 4, 5, "stale"), ("f", None, 1, 0, "history-unavailable"), ("g", 3, 0, 0, "fresh"), ("g", 1, None, 1, "off"), ("h", 1, 0, 0, "fresh")], key=str)
    versions = spark.createDataFrame([("f", 1, "a"), ("f", 2, "a"), ("f", 3, None), ("f", 4, "b"), ("g", 5, "a")], "file string, seq int, digest string")
    marked = spark.createDataFrame([("f", 1, "a"), ("g", 1, "a")], "file string, mark int, digest string")
    assert rows(history.staling_commit(marked, versions).select("file", "staled_by")) == [("f", 3), ("g", None)]


def test_budgets(spark):
    chains = spark.createDataFrame([("a", 10, 1), ("b", 40, 2), ("c", 40, 3)], "id string, chain_bytes long, ord int")
    assert rows(budget.worst_chain(chains, 20)) == [("b", 40)] and rows(budget.worst_chain(chains, 40)) == []
    parts = spark.createDataFrame([("n", 1, 5, "x"), ("n", 2, 9, "y"), ("n", 3, 9, "z")], "node string, ord int, size int, name string")
    assert rows(budget.largest_part(parts, "node", "size", "ord", "name")) == [("n", 23, 3, 9, "z")]


@pytest.mark.parametrize(
    ("text", "ignored", "kept"),
    [
        ("build/", ["build/x", "a/build/x"], ["build", "a/build"]), ("/build", ["build", "build/x"], ["a/build"]), ("*.log\n!keep.log", ["a.log", "x/a.log"], ["keep.log", "a.txt"]),
        ("dir/\n!dir/keep", ["dir/keep", "dir/x"], []), ("dir/**", ["dir/x", "dir/a/b"], ["dir"]), ("**/gen/*.ts", ["gen/a.ts", "x/y/gen/a.ts"], ["gen/x/a.ts"]),
        ("a/**/b", ["a/b", "a/x/b", "a/x/y/b/c"], ["a/xb", "ab"]), ("﻿# c\n\n!\n/\nx?z\r\n", ["xyz", "q/xyz/a"], ["xz", "x/z", "xyyz"]), ("a*", ["ab/c", "q/a"], ["ba"]), ("", [], ["a"]),
    ],
)
def test_ignore_rules(spark, text, ignored, kept):
    rules = ignore.parse_rules(text)
    files = spark.createDataFrame([(p,) for p in ignored + kept], "path string")
    assert {r.path for r in files.filter(ignore.is_ignored(F.col("path"), rules)).collect()} == set(ignored)
    assert {r.path for r in ignore.drop_ignored(files, rules).collect()} == set(kept)
