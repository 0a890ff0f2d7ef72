"""Scalar rules against small models in Python."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.functions import expr as X

PATHS = st.lists(st.text("ab./\\|-`é  ", max_size=9), min_size=1, max_size=30)
SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def each(spark, values, make):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.out for r in frame.select("k", make(F.col("v")).alias("out")).orderBy("k").collect()]


def model_id(raw):
    slashed = raw.replace("\\", "/")
    if slashed.startswith("/") and slashed != "/":
        return None
    parts = [s for s in slashed.split("/") if s not in ("", ".")]
    return None if ".." in parts else "/".join(parts) or "/"


@SLOW
@given(PATHS)
def test_normalize_id(spark, values):
    assert each(spark, values, X.normalize_id) == [model_id(v) for v in values]


@SLOW
@given(PATHS)
def test_node_id_bars_what_breaks_a_cell(spark, values):
    assert each(spark, values, X.node_id) == [None if re.search(r"[|` ]", v) else model_id(v) for v in values]


@SLOW
@given(st.lists(st.text("aZ09-_ é./#", max_size=12), min_size=1, max_size=30))
def test_slugs(spark, values):
    collapsed = [re.sub(r"[^a-z0-9]+", "-", "".join(c if c == "é" else c.lower() for c in v)).strip("-") for v in values]
    assert each(spark, values, X.collapse_symbol) == collapsed
    assert each(spark, values, X.is_valid_slug) == [bool(re.fullmatch(r"[a-z0-9]+(-[a-z0-9]+)*", v)) for v in values]


@SLOW
@given(st.lists(st.tuples(st.text("ab./", max_size=8), st.text("ab./", max_size=8)), min_size=1, max_size=20))
def test_join_path(spark, pairs):
    def model(base, relative):
        out = []
        for s in f"{base}/{relative}".split("/"):
            if s == "..":
                out = out[:-1]
            elif s not in ("", "."):
                out.append(s)
        return "/".join(out)

    frame = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string")
    got = [r.out for r in frame.select("k", X.join_path(F.col("a"), F.col("b")).alias("out")).orderBy("k").collect()]
    assert got == [model(*p) for p in pairs]


@pytest.mark.parametrize(
    ("make", "cases"),
    [
        (lambda c: X.derive_slug(c, "~ "), {"~ keep-it": "keep-it", "~ Bad": None, "a/b.rs#Foo::bar_baz": "foo-bar-baz", "a#": None, "~  two": None}),
        (X.is_claim_address, {"a/b/c-d": True, "//x": True, "x": False, "/x": False, "a/../b": False, "a/B": False}),
        (lambda c: X.decision_number(c, "§ "), {"§ 0007": "0007", "§ 7x": None, "§  7": None, "7": None, "§ ": None}),
        (X.parent_dir, {"a/b/c": "a/b", "a": "", "": ""}),
        (X.extension, {"a/b.TS": "ts", ".bashrc": "", "a.b/c": "", "x.tar.gz": "gz", "x.": ""}),
        (X.last_segment, {"/": "/", "a/b": "b", "a": "a"}),
        (X.heading_slug, {"Hello, World!": "hello-world", "  a -- b ": "a-b", "Über 2.0": "über-20", "---": ""}),
        (X.flat, {" a\n\t b  c ": "a b c", "": ""}),
        (X.cell, {"a | b": "a \\| b"}),
        (X.status_word, {" **Accepted**": "accepted", "[Superseded](x)": "superseded", "12": None, "in-review now": "in-review"}),
        (lambda c: X.kib(F.length(c)), {"x" * 1536: "1.5 KiB"}),
        (lambda c: X.ancestors(c), {"": [""], "a/b": ["", "a", "a/b"]}),
        (lambda c: X.ancestors(c, root=False), {"": [], "a": ["a"]}),
        (lambda c: c.rlike(X.glob_regex("a?i*", across=True)), {"api": True, "api/x": True, "ai": False, "xapi": False}),
        (lambda c: c.rlike(X.glob_regex("a*", across=False)), {"api": True, "a/x": False}),
    ],
)
def test_table(spark, make, cases):
    assert each(spark, list(cases), make) == list(cases.values())
