"""Digests follow structure and tokens, not comments and layout; each content is parsed once."""

import pytest
from pyspark.sql import functions as F

from waymark.functions import regions as R
from waymark.functions.structure import file_digests, tree_digests
from waymark.jobs import graph as G
from waymark.sources.files import Notation

MARK = "※ "
PY = "# ※ cap\n@cached\ndef f(x):\n    if x:\n        stop()\n        go()\n    return x + 1\n\n\ndef g():\n    return 2\n"
EX = 'defmodule M do\n  @castable [:a, :b]\n\n  # ※ cap\n  @doc "the cap"\n  def changeset(attrs) do\n    attrs |> cast(@castable)\n  end\n\n  def other(y) do\n    y + 1\n  end\nend\n'
TS = "// ※ cap\nexport function f(a: string): number {\n  if (a) { go(); }\n  return 1;\n}\nfunction other() { return 2; }\n"
RS = "/*\n * ※ cap\n */\nfn guard() -> u32 {\n    1\n}\n\nfn other() -> u32 {\n    2\n}\n"


def bound(text, path, slug="cap"):
    return next(((region, digest) for kind, name, _, region, digest in file_digests(text, path, MARK) if (kind, name) == ("mark", slug)), None)


@pytest.mark.parametrize(
    ("path", "text", "old", "new"),
    [
        ("m.py", PY, "x + 1", "x+1  # why"), ("m.py", PY, "return 2", "return 3"), ("m.py", PY, "    if x:\n        stop()", "    # note\n    if x:\n\n        # more\n        stop()"),
        ("m.py", PY, PY, PY.replace("    ", "  ")), ("m.py", PY, "x + 1", "x \\\n        + 1"), ("m.py", PY, "go()", "go(\n)"),
        ("m.ex", EX, "    attrs |>", "    # a note\n    attrs |>"), ("m.ex", EX, "[:a, :b]", "[:a]"), ("m.ex", EX, "y + 1", "y + 2"),
        ("m.ts", TS, "{ go(); }", "{\n    go(); // yes\n  }"), ("m.ts", TS, "return 2", "return 3"), ("m.mts", TS, "return 1;", "return 1 ;"), ("m.rs", RS, "    2", "    3"), ("m.rs", RS, "    1", "    /* one */ 1"),
    ],
)
def test_comments_layout_and_siblings_do_not_count(path, text, old, new):
    assert old in text and bound(text.replace(old, new), path) == bound(text, path)


@pytest.mark.parametrize(
    ("path", "text", "old", "new"),
    [
        ("m.py", PY, "        go()", "    go()"), ("m.py", PY, "x + 1", "x + 2"), ("m.py", PY, "stop()\n        go()", "go()\n        stop()"), ("m.py", PY, "stop()\n        go()", "stop() ; go()"),
        ("m.py", PY, "        stop()\n        go()\n", "        stop()\n        if x:\n            go()\n"), ("m.ex", EX, "cast(@castable)", "cast([:a])"), ("m.ts", TS, "go();", "go(1);"), ("m.ts", TS, "{ go(); }\n  return 1;", "{ go(); return 1; }"), ("m.rs", RS, "    1", "    10"),
    ],
)
def test_tokens_order_and_nesting_count(path, text, old, new):
    assert old in text and bound(text.replace(old, new), path)[1] != bound(text, path)[1]


@pytest.mark.parametrize(("path", "template"), [("m.py", "def f(w):\n    return S.join(w)\n"), ("m.rs", "fn f() -> &'static str { S }\n"), ("m.rs", "fn f() -> &'static str { r#S# }\n"), ("m.ts", "function f() { return S; }\n"), ("m.ex", "def f, do: S\n")])
def test_white_space_in_strings_counts(path, template):
    assert len({next(d for k, _, _, _, d in file_digests(template.replace("S", s), path, MARK) if k == "symbol") for s in ('""', '" "', '"  "')}) == 3


def test_what_a_landmark_is_bound_to():
    assert bound(PY, "m.py")[0] == "f" and bound(EX, "m.ex")[0] == "changeset/1" and bound(RS, "m.rs")[0] == "guard" and bound(TS, "m.ts")[0] == "f"
    assert bound("# ※ cap\nCAP = 100\n", "d/m.py")[0] == "m.py" and bound(PY, "m.py", "gone") is None and file_digests("※ cap", "m.txt", MARK) is None
    inside = "fn wrap(a: u32) -> u32 {\n    // ※ cap\n    a + 1\n}\n\nfn other() {}\n"
    assert bound(inside, "m.rs")[0] == "wrap" and bound(inside.replace("other() {}", "other() { 1 }"), "m.rs") == bound(inside, "m.rs")
    rust = "struct P;\nimpl P {\n  // ※ cap\n  fn go(&self) -> u8 { if true { 1 } else { 2 } }\n}\n"
    assert bound(rust, "p.rs")[0] == "go"


def test_names_of_regions():
    assert [r.name for r in R.regions("const X: u8 = 1;\npub const fn y() {}\nmod m { enum E { A } }\n// fn no() {}\nlet s = \"fn no\";", "rust")] == ["X", "y", "m", "E"]
    assert [r.name for r in R.regions("export class A {\n  run(x) { if (x) {} }\n}\nfunction* g() {}\ntype T = {};\n", "script")] == ["A", "run", "g", "T"]
    heads = {"def f(a, {b, c}), do: 1": "f/2", "def f(a, g(b, c), [d, e]), do: 1": "f/3", "def f(\n  a,\n  %{x: 1, y: 2}\n) do\nend": "f/2", "def f(), do: 1": "f/0", "def f, do: 1": "f/0", "def f({a, b}) do\nend": "f/1", 'def f("a, b"), do: 1': "f/1", "def f(<<a, b>>, c), do: 1": "f/2"}
    assert {h: R.regions(h, "elixir")[0].name for h in heads} == heads


def test_odd_texts_end():
    for text in (")" * 5000, "(" * 5000, "[" * 20_000 + "]" * 20_000, "def f(:\n\tx\n  y\n )", "\n" * 10, ""):
        assert len(tree_digests(text, "python", R.regions(text, "python"))[0]) == 64


def test_each_content_is_parsed_once(spark):
    versions = spark.createDataFrame(
        [("a.py", 1, PY), ("a.py", 2, PY.replace("x + 1", "x + 2")), ("a.py", 3, PY), ("b.py", 1, PY), ("b.py", 2, None), ("c.md", 1, "# ※ cap"), ("d.py", 1, "x = 1\n")], "file string, seq int, text string"
    )
    anchors = spark.createDataFrame([("a.py", "※ cap", None), ("a.py", "a.py#g", None), ("a.py", "a.py#gone", None), ("b.py", "※ cap", 1), ("b.py", "※ cap", 7), ("c.md", "※ cap", None)], "file string, anchor string, at_line int")
    contents = G.content_digests(versions.withColumn("content", F.sha2("text", 256)), Notation())
    assert contents.filter("kind = 'file'").count() == 3
    got = {(r.file, r.seq, r.anchor, r.at_line): (r.region, r.digest) for r in G.anchor_digests(anchors, versions, Notation()).collect()}
    of = lambda text, name: next(d for k, n, _, _, d in file_digests(text, "x.py", MARK) if (k, n) == name)
    assert len(got) == 3 * 3 + 2 * 2 + 1 and got["a.py", 1, "※ cap", None] == got["a.py", 3, "※ cap", None] == got["b.py", 1, "※ cap", 1] == ("f", of(PY, ("symbol", "f")))
    assert got["a.py", 2, "※ cap", None][1] != got["a.py", 1, "※ cap", None][1] and got["a.py", 2, "a.py#g", None] == got["a.py", 1, "a.py#g", None]
    assert got["a.py", 1, "a.py#gone", None] == ("a.py", of(PY, ("file", ""))) and got["b.py", 1, "※ cap", 7] == ("b.py", of(PY, ("file", "")))
    assert got["b.py", 2, "※ cap", 1] == got["c.md", 1, "※ cap", None] == (None, None)
