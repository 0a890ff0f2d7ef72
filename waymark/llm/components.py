"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for each node of ``edges(a, b)``: the smallest node it can reach.

    Large-star then small-star rounds: every node tells its larger (then its smaller-or-equal)
    neighbours the smallest node it knows, until the edges are stars that no round changes. A hot
    node costs rows in proportion to its edges only: minima are taken by map-side sums and written
    before they are joined back, so that Spark can split a hot node's edges. Each round's edges are written to the shared folder; at most logarithmically many rounds
    follow. Self loops and null ends are ignored; an empty table gives an empty table.
    """
    kind = dict(edges.dtypes)["a"]
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    size = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while size[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialize(large, "edges")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lower = materialize(down.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = down.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(lower.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        after = materialize(small, "edges")
        grown = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for done in (now, large, least, lower):
            discard(done)
        now, same = after, tuple(grown) == tuple(size)
        size = grown
        if same:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.unionByName(roots).select(F.col("node").cast(kind), F.col("component").cast(kind))
