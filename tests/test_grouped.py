"""Declared edges given by groups: the same violations as with all pairs listed."""

import random

from pyspark.sql import functions as F

from waymark.jobs import queries
from waymark.operators import edges
from waymark.sources.tables import table


def test_groups_stand_for_all_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(edges, "LISTED", 3)
    rnd = random.Random(4)
    pick = lambda names: rnd.choice(names)
    people, shops = [f"c{i}" for i in range(30)] + [None], [f"s{i}" for i in range(20)] + [None]
    refs = spark.createDataFrame([(pick(people), pick(shops)) for _ in range(200)], "from_id string, to_id string")
    sources = spark.createDataFrame([(pick(people), pick([0, 1, 2, None])) for _ in range(40)], "from_id string, group long")
    targets = spark.createDataFrame([(pick(shops), pick([0, 1, 2, 3, None])) for _ in range(30)], "to_id string, group long")
    pairs = sources.join(targets, "group").select("from_id", "to_id")
    rows = lambda d: sorted(map(repr, d.collect()))
    whole = edges.structural_violations(refs, pairs)
    assert rows(edges.grouped_violations(refs, sources, targets)) == rows(whole)
    frozen = spark.createDataFrame([("c1", "vestigial"), ("c2", "undeclared")], "node string, direction string")
    less = whole.join(frozen, ["node", "direction"], "left_anti").select("node", "direction", "target")
    assert rows(edges.grouped_violations(refs, sources, targets, frozen)) == rows(less)
    assert not edges.grouped_violations(refs.limit(0), sources.limit(0), targets).count()


def test_hops_by_groups_equal_hops_by_pairs(spark):
    rnd = random.Random(5)
    names = [f"n{i}" for i in range(40)]
    links = spark.createDataFrame([(rnd.choice(names), rnd.choice(names)) for _ in range(12)] + [("n0", "n7"), ("n0", None)], "src string, dst string")
    sources = spark.createDataFrame([(rnd.choice(names), rnd.choice([0, 1, 2, 3, None])) for _ in range(12)] + [("n7", 0)], "id string, group long")
    targets = spark.createDataFrame([(rnd.choice([*names, None]), rnd.choice([0, 1, 2, 3, None])) for _ in range(15)], "id string, group long")
    pairs = sources.withColumnRenamed("id", "src").join(targets.withColumnRenamed("id", "dst"), "group").select("src", "dst")
    start = spark.createDataFrame([("n0",)], "id string")
    for depth in (None, 2):
        want = edges.hops_from(links.union(pairs), start, depth=depth).filter("id IS NOT NULL").collect()
        got = edges.hops_from(links, start, depth=depth, sources=sources, targets=targets).filter("id IS NOT NULL").collect()
        assert len(got) > 3 and sorted(got) == sorted(want)


def test_unfold_hops_lists_no_pairs(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(edges, "hops_from", lambda links, *a, **b: seen.append(links.count()))
    queries.unfold_hops(spark, sf_dir)
    assert seen == [table(spark, sf_dir, "lineitem").count()]


def test_small_tables_with_many_pairs_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(edges, "PAIRS", 1000, raising=False)
    sources = spark.createDataFrame([(f"c{i}", 0) for i in range(400)], "from_id string, group long")
    targets = spark.createDataFrame([(f"s{i}", 0) for i in range(100)], "to_id string, group long")
    refs = spark.createDataFrame([(f"c{i}", f"s{i % 100}") for i in range(400)], "from_id string, to_id string")
    for few, frozen, n in ((0, None, 400), (16, spark.createDataFrame([(f"c{i}", d) for i in range(50) for d in ("vestigial", "undeclared")], "node string, direction string"), 350)):
        monkeypatch.setattr(edges, "FEW", few, raising=False)
        counts = [r["count"] for r in edges.grouped_violations(refs, sources, targets, frozen).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(counts) == n * 99 and max(counts) < n * 99 / 4, counts
