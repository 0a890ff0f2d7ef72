"""A small repository in three languages: compiled, checked clean, and mutated rule by rule."""

import json
import subprocess

import pytest

from waymark.functions import lexing
from waymark.jobs import check as C
from waymark.jobs.graph import Refused, compile_graph, lock_rows, read_block
from waymark.sources import files as S

ROOT = """# shop

```graph
kind: system
purpose: A shop
commands:
  test: make test
invariants:
  - claim: money is whole cents
    anchor: ※ cents
    enforced_by: shared/test/money.test.ts
edges:
  decided_by: [§ 0007]
```
"""
WEB = """```graph
kind: container
purpose: pages
hazards:
  - claim: hooks must not write
    anchor: ※ hook
edges:
  depends: [web/store, shared]
```
<!-- ※ seen-in-comment --> ※ prose
"""
FILES = {
    "AGENTS.md": ROOT,
    "web/AGENTS.md": WEB,
    "web/store/AGENTS.md": "```graph\nkind: component\npurpose: rows\nedges:\n  depends: [py]\n```\n",
    "shared/AGENTS.md": "```graph\nkind: container\npurpose: types\n```\n",
    "py/AGENTS.md": "```graph\nkind: container\n```\n",
    "web/pay.ex": '# ※ hook\ndefmodule Shop.Pay do\n  alias Shop.Store.{Row, Other}\n  @doc "※ not-here"\n  def go, do: Row.new()\nend\n# ⊨ web/hook\n',
    "web/store/row.ex": "defmodule Shop do\n  defmodule Store.Row do\n  end\nend\n",
    "web/ui.ts": "import { Money } from '@shop/shared'; // import x from './gone'\n",
    "web/store/load.py": "import os\nfrom py.lib import thing\n",
    "shared/package.json": '{"name": "@shop/shared", "main": "src/money.js"}',
    "shared/src/money.ts": "/* ※ cents */\nexport type Money = number;\n",
    "shared/test/money.test.ts": "import { Money } from '../src/money.js';\n",
    "py/lib.py": "thing = 1\n",
    "adr/0007-cents.md": "# 7\n\nStatus: Accepted\n",
    "logo.png": b"\x89PNG\x00\xff",
}


def frame(spark, changes=None):
    made = {**FILES, **(changes or {})}
    return spark.createDataFrame([(p, bytearray(c if isinstance(c, bytes) else c.encode())) for p, c in made.items() if c is not None], "path string, content binary")


def findings(spark, changes=None, **more):
    files = frame(spark, changes)
    graph = compile_graph(files)
    return [(r["class"], r.node, r.message) for r in C.check(graph, files, S.readable(files), **more).collect()]


def test_clean_tables(spark):
    graph = compile_graph(frame(spark))
    assert graph.errors.collect() == []
    assert sorted(map(tuple, graph.contains.collect())) == [("/", "py"), ("/", "shared"), ("/", "web"), ("web", "web/store")]
    assert sorted((r.slug, r.file, r.line, r.node) for r in graph.landmarks.collect()) == [("cents", "shared/src/money.ts", 1, "shared"), ("hook", "web/pay.ex", 1, "web"), ("seen-in-comment", "web/AGENTS.md", 10, "web")]
    assert {(r.from_id, r.to_id) for r in graph.imports.collect()} == {("web", "web/store"), ("web", "shared"), ("web/store", "py")}
    parsed = {(r.part, r.key): json.loads(r.value) for r in lock_rows(graph).collect()}
    web = parsed["nodes", "web"]
    assert web["declared"]["depends"] == ["web/store", "shared"] and web["extracted"]["imports"] == ["shared", "web/store"]
    assert parsed["nodes", "/"]["claims"][0]["resolved"] == "shared/src/money.ts:1" and parsed["records", "adr/0007"]["status"] == "accepted"


def test_clean_repository_has_no_findings(spark):
    assert findings(spark) == []


@pytest.mark.parametrize(
    ("changes", "expected"),
    [
        (
            {
                "web/store/row.ex": "defmodule Shop.Store.Row do\n alias Shop.Pay\nend\n", "web/ui.ts": "x", "shared/src/money.ts": "/* ※ cent */\n", "py/lib.py": "thing = 1 # ※ hook\n# ⊨ web/gone\n",
                "adr/0007-cents.md": "Status: Superseded by 8", "shared/test/money.test.ts": None,
            },
            [
                ("referential", None, "landmark ※ hook has slug-match cardinality 2"), ("referential", None, "⊨ web/gone resolves to no declared claim"),
                ("referential", "/", 'anchor ※ cents unresolved (0 occurrences of "※ cents")'), ("referential", "/", "decided_by target § 0007 names a superseded decision record"),
                ("referential", "/", "enforced_by shared/test/money.test.ts is not a tracked file"), ("structural", "web", "web declares depends on shared — no import found"),
                ("structural", "web/store", "web/store imports web — edge not declared"),
            ],
        ),
        (
            {"adr/0007-again.md": "x", "api/a.go": "", "api/b/c.go": "", "tools/t": "", "web/AGENTS.md": WEB + "x" * 40_000},
            [
                ("referential", None, "decision record adr/0007 is declared by 2 files: adr/0007-again.md, adr/0007-cents.md"),
                ("exhaustiveness", None, "api (2 files) is covered by no node — unreachable via any router"), ("exhaustiveness", None, "tools (1 file) is covered by no node — unreachable via any router"),
                ("budget", "web/store", None),
            ],
        ),
        ({"adr/0007-cents.md": None}, [("referential", "/", "decided_by target § 0007 resolves to no decision record"), ]),
    ],
)
def test_mutations(spark, changes, expected):
    got = findings(spark, changes)
    assert [(c, n) for c, n, _ in got] == [(c, n) for c, n, _ in expected]
    assert all(m is None or m == g for (_, _, m), (_, _, g) in zip(expected, got, strict=True))


def test_frozen_violations_are_silent(spark):
    change = {"web/ui.ts": "x"}
    graph = compile_graph(frame(spark, change))
    baseline = C.freeze(graph)
    assert [tuple(r) for r in baseline.collect()] == [("web", "vestigial", "shared")]
    assert C.structural(graph, baseline).collect() == []


def test_refused_blocks(spark):
    bad = {"py/AGENTS.md": "```graph\nkind: container\n```\n```graph\nkind: system\n```\n", "shared/AGENTS.md": "```sh\nx\n```\n```graph\nkind: system\n```\n", "web/AGENTS.md": "<!--\n```graph\nkind: system\n```\n-->\n"}
    graph = compile_graph(frame(spark, bad))
    assert sorted(r.path for r in graph.errors.collect()) == ["py/AGENTS.md", "shared/AGENTS.md"]
    assert sorted(r.id for r in graph.nodes.collect()) == ["/", "web/store"]


@pytest.mark.parametrize("body", ["kind: other", "purpose: x", "kind: system\nx: 1", "kind: system\nkind: system", "kind: system\ncommands:\n  a: b\n  a: c", "kind: system\nbudget: -1", "- a", "kind: &a system\nid: *a", "kind: [", f"kind: system\npurpose: {'x' * 201}", "kind: system\ninvariants:\n  - claim: x", "kind: system\nedges:\n  allow: [{edge: a}]", "kind: " + "[" * 70])
def test_block_gate(body):
    with pytest.raises(Refused):
        read_block(body)


def test_lexers():
    assert lexing.comments("a = '# no' # yes\n\"\"\"\n# no\n\"\"\"\n# two", "python") == [(1, "# yes"), (5, "# two")]
    assert lexing.comments("/* a /* b */\n c */ x // d\n\"// no\"", "rust") == [(1, "/* a /* b */"), (2, " c */"), (2, "// d")]
    assert lexing.comments("`// no` // yes", "script") == [(1, "// yes")]
    assert [n for n, *_ in lexing.imported("use a::b;\nuse {c::d, e};\nuse crate::x;\nextern crate f as g;\n// use h;\nlet s = \"use i;\";", "rust")] == ["a", "c", "e", "f"]
    assert [n for n, *_ in lexing.imported("import a.b as c, d\nfrom . import x\nfrom e.f import (g,\n h)\ns = 'import z'", "python")] == ["a.b", "d", "e.f"]
    assert [n for n, *_ in lexing.imported("import 'a';\nexport * from \"b\";\nconst c = require('c');\nawait import('d');\nx.require('e'); // require('f')\nexport const y = 'g';\nimport z = require('h')", "script")] == ["a", "b", "c", "d", "h"]
    assert [n for n, *_ in lexing.imported("alias A.B.{C, D}\nuse E\n# F\n\"G\"\n:H", "elixir")] == ["A.B.C", "A.B.D", "E"]
    deep = "".join(f"defmodule M{k} do\n" for k in range(400)) + "end\n" * 400
    assert len(lexing.declared_modules(deep)[-1].split(".")) == 400
    assert lexing.declared_modules("defmodule A do\n def f, do: 1\n quote do\n  defmodule Q do\n  end\n end\n defmodule B do\n end\nend\ndefmodule C do\nend") == ["A", "A.B", "C"]
    assert lexing.markdown_comments("`<!-- no -->` <!-- a\nb --> c\n```\n<!-- no -->\n```\n\\` <!-- d -->") == [(1, " a"), (2, "b "), (6, " d ")]
    assert lexing.comments("(" * 20_000 + "# c", "python") == [(1, "# c")]


def test_repository_source(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    for name in ("a/x.py", "a-b/x.py", ".hidden/y", "skip/z.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / ".ignore").write_text("skip/\n")
    run("add", ".")
    run("commit", "-qm", "first one")
    (tmp_path / "a/x.py").write_text("y")
    run("commit", "-qam", "second")
    (tmp_path / "a-b/x.py").unlink()
    assert S.list_tracked(str(tmp_path)) == [".hidden/y", ".ignore", "a/x.py", "a-b/x.py", "skip/z.py"]
    got = S.from_repository(spark, str(tmp_path), ignore_file=".ignore")
    assert sorted((r.path, bytes(r.content)) for r in got.collect()) == [(".hidden/y", b"x"), (".ignore", b"skip/\n"), ("a/x.py", b"y")]
    assert [(r.seq, r.subject) for r in S.history(spark, str(tmp_path)).filter("file = 'a/x.py'").orderBy("seq").collect()] == [(1, "first one"), (2, "second")]


def test_churn_stream(spark, tmp_path):
    from waymark.streaming.churn import churn_stream

    rows = [(k, k % 3, f"2024-01-0{1 + k % 4} 0{k % 10}:00:00") for k in range(20)] + [(0, 0, "2024-01-01 00:00:00")]
    changes = spark.createDataFrame(rows, "event_id int, user_id int, t string").selectExpr("event_id", "user_id", "cast(t as timestamp) as ts")
    changes.write.parquet(str(tmp_path / "in"))
    marks = spark.sql("SELECT 0 AS user_id, timestamp'2024-01-02 05:00:00' AS mark UNION ALL SELECT 1, timestamp'2024-01-01 00:00:00'")
    stream = spark.readStream.schema(changes.schema).parquet(str(tmp_path / "in"))
    out = churn_stream(stream, marks, key="user_id", time="ts").writeStream.outputMode("update").format("memory").queryName("churn").start()
    out.processAllAvailable()
    out.stop()
    got = {(str(r.window.start)[:10], r.user_id): r.n_later for r in spark.table("churn").collect()}
    want = {}
    for r in changes.dropDuplicates(["event_id"]).join(marks, "user_id").filter("ts > mark").collect():
        want[str(r.ts)[:10], r.user_id] = want.get((str(r.ts)[:10], r.user_id), 0) + 1
    assert got == want and got
