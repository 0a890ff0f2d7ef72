"""Spans by byte offset, masks, splicing, and rule files written and pruned in tasks."""

import random

import pytest

from waymark.functions.spans import Malformed, scan, splice
from waymark.jobs import emit
from waymark.jobs.graph import compile_graph
from waymark.operators import masks

BEGIN, END = "<!-- @graph router — do not edit -->", "<!-- @end -->"


@pytest.mark.parametrize(
    ("text", "inner"),
    [
        (f"# é\n{BEGIN}\nold\n{END}\ntail", "old\n"), (f"a\r\n{BEGIN}\r\nold\r\n{END}\r\n", "old\r\n"), (f"{BEGIN}{END}\n", ""), (f"<!-- @graph -->{END}\n", ""), (f"<!-- @graph router-->{END}\n", ""), (f"{BEGIN}\n{END}", ""),
        (f"```\n{BEGIN}\n```\n{BEGIN}\nx\n{END}\n```\n{END}\n", "x\n"), (f"<!-- note\n{BEGIN[5:]}\n{BEGIN}\ny\n{END}\n", "y\n"), (f"     {BEGIN}\n{BEGIN}\nz\n{END}\n", "z\n"),
    ],
)
def test_regions_are_found_by_bytes(text, inner):
    region, raw = scan(text)[1], text.encode()
    assert region.name == "router" and raw[region.start : region.stop].decode() == inner
    once = splice(raw, "new ※ row")
    assert splice(once, "new ※ row") == once and once.startswith(raw[: region.start]) and once.endswith(raw[region.stop :]) and b"new \xe2\x80\xbb row\n" in once
    assert splice(splice(once, ""), "new ※ row") == once


@pytest.mark.parametrize("text", [f"{BEGIN}\n", f"{END}\n", f"{BEGIN}\n{END}\n{BEGIN}\n{END}\n", f"{BEGIN}\n{BEGIN}\n{END}\n"])
def test_malformed_regions(text):
    with pytest.raises(Malformed):
        scan(text)


def test_fences_and_comments():
    text = "é <!-- a --> b <!-- c\nd --> e\n```py\n<!-- no -->\n```\n~~~\nopen <!--"
    raw = text.encode()
    assert [(k, raw[a:b].decode()) for k, a, b in scan(text)[0]] == [("comment", "<!-- a -->"), ("comment", "<!-- c\nd -->"), ("fence", "```py\n<!-- no -->\n```\n"), ("fence", "~~~\nopen <!--")]


def test_masks_equal_a_plain_loop(spark):
    rng = random.Random(3)
    spans = [(f, a, a + rng.randrange(30)) for f in "ab" for a in (rng.randrange(200) for _ in range(12))]
    points = [(f, rng.randrange(240), k) for k, f in enumerate("abc" * 40)]
    got = masks.inside(spark.createDataFrame(points, "file string, at long, id int"), spark.createDataFrame(spans, "file string, start long, stop long"), ["file"])
    assert {(r.file, r.at, r.id): r.inside for r in got.collect()} == {(f, at, k): any(g == f and a <= at < b for g, a, b in spans) for f, at, k in points}


def test_landmarks_in_generated_rows_are_no_occurrences(spark):
    node = "```graph\nkind: system\npurpose: all\n```\n\n<!-- ※ kept -->\n" + BEGIN + "\n<!-- ※ rendered -->\n" + END + "\n"
    graph = compile_graph(spark.createDataFrame([("AGENTS.md", bytearray(node.encode()))], "path string, content binary"))
    assert [r.slug for r in graph.landmark_occ.collect()] == ["kept"]


def test_rule_files_are_written_once_and_pruned(spark, tmp_path):
    block = "```graph\nkind: {}\npurpose: p\ninvariants:\n  - claim: keeps  {}\n    anchor: ※ {}\n```\n"
    files = {"AGENTS.md": block.format("system", "all", "top"), "a/b/AGENTS.md": block.format("component", "one", "one"), "a-b/AGENTS.md": block.format("component", "two", "two"), "c/AGENTS.md": block.format("component", "three", "three")}
    graph = compile_graph(spark.createDataFrame([(p, bytearray(c.encode())) for p, c in files.items()], "path string, content binary"))
    made, twice = emit.rule_files(graph)
    assert [(r.path, r.ids) for r in twice.collect()] == [("rules/a-b.md", ["a-b", "a/b"])]
    root = str(tmp_path)
    assert {tuple(r) for r in emit.write_files(made, root).collect()} == {("rules/root.md", "written"), ("rules/c.md", "written")}
    assert {r.state for r in emit.write_files(made, root).collect()} == {"same"}
    assert (tmp_path / "rules/c.md").read_text() == f"{emit.STAMP}\n# c\n\n- keeps three (※ three)\n"
    (tmp_path / "rules/old.md").write_text(emit.STAMP + "\n# old\n")
    (tmp_path / "rules/own.md").write_text("# mine\n")
    present = spark.createDataFrame([(f"rules/{p.name}", p.read_text()) for p in (tmp_path / "rules").iterdir()], "path string, text string")
    assert [r.path for r in emit.prune(spark, emit.stale(present, made), root).collect()] == ["rules/old.md"]
    assert sorted(p.name for p in (tmp_path / "rules").iterdir()) == ["c.md", "own.md", "root.md"]


def test_splicing_says_why_it_leaves_a_file(spark):
    files = spark.createDataFrame([("a", bytearray(b"x\n")), ("b", bytearray(f"{END}\n".encode())), ("c", bytearray(b"\xff")), ("d", bytearray(f"{BEGIN}\n{END}\n".encode()))], "path string, content binary")
    bodies = spark.createDataFrame([(p, "new") for p in "abcd"], "path string, body string")
    assert {r.path: r.state for r in emit.spliced(files, bodies).collect()} == {"a": "no generated region", "b": "malformed: line 1: an end without a begin", "c": "not UTF-8", "d": "changed"}
