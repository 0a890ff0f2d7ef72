"""Joins and sums along path prefixes: owners, chains, rollups, containment, coverage.

A directory contains a path if it is one of the path's ancestors, so every prefix condition is an
equi-join on exploded ancestors (depth rows per distinct directory), never a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..sources.shared import ensure_checkpoints


def deepest_owner(dirs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``dir, owner``: for each distinct ``dirs.dir`` the id of the deepest of ``nodes(id, dir)`` above it."""
    above = dirs.select("dir").distinct().select("dir", F.explode(X.ancestors(F.col("dir"))).alias("__up"))
    owners = nodes.select(F.col("dir").alias("__up"), "id")
    return above.join(owners, "__up").groupBy("dir").agg(F.max_by("id", F.struct(F.length("__up"), "id")).alias("owner"))


def territory_owner(files: DataFrame, nodes: DataFrame, *, path: str = "path", fallback: str | None = None) -> DataFrame:
    """``files`` with the ``owner`` of each path: the node whose directory is the deepest above it.

    Owners are found once per directory. Null where no node covers the path (or ``fallback``).
    """
    placed = files.withColumn("__dir", X.parent_dir(F.col(path)))
    owned = deepest_owner(placed.select(F.col("__dir").alias("dir")), nodes).withColumnRenamed("dir", "__dir")
    owner = F.coalesce("owner", F.lit(fallback)) if fallback is not None else F.col("owner")
    return placed.join(owned, "__dir", "left").withColumn("owner", owner).drop("__dir")


def contains_edges(nodes: DataFrame) -> DataFrame:
    """``parent, child``: each node under the owner of the directory above its own; the root has no parent."""
    inner = nodes.filter("dir <> ''").select("id", "dir", X.parent_dir(F.col("dir")).alias("__up"))
    owned = deepest_owner(inner.select(F.col("__up").alias("dir")), nodes).withColumnRenamed("dir", "__up")
    return inner.join(owned, "__up").select(F.col("owner").alias("parent"), F.col("id").alias("child"))


def contains_ordered(edges: DataFrame) -> DataFrame:
    """``parent, child, position``: each parent's distinct children numbered from 1 in order.

    One range-partitioned order of all edges; a child's position is its place among its parent's
    children in its range, plus those in earlier ranges. A parent with most of the children is spread
    over as many ranges as it fills, and only (range, parent) counts are added up.
    """
    ensure_checkpoints(edges.sparkSession)
    ranged = edges.select("parent", "child").distinct().repartitionByRange("parent", "child").withColumn("__range", F.spark_partition_id()).checkpoint()
    counts = ranged.groupBy("parent", "__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("parent").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("parent", "__range", before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range", "parent").orderBy("child"))
    return ranged.withColumn("__place", place).join(offsets, ["parent", "__range"]).select("parent", "child", (F.col("__before") + F.col("__place")).alias("position"))


def dir_rollup(files: DataFrame, *, path: str = "path") -> DataFrame:
    """``dir, n_files, n_direct``: files in and below each directory. Counts are per directory first."""
    direct = files.groupBy(X.parent_dir(F.col(path)).alias("own")).agg(F.count("*").alias("n"))
    return (
        direct.filter("own <> ''").select("own", "n", F.explode(X.ancestors(F.col("own"), root=False)).alias("dir"))
        .groupBy("dir").agg(F.sum("n").alias("n_files"), F.sum(F.when(F.col("own") == F.col("dir"), F.col("n")).otherwise(0)).alias("n_direct"))
    )


def uncovered_dirs(files: DataFrame, covering: DataFrame, *, depth: int = 1, excluded: Column | None = None) -> DataFrame:
    """``dir, n_files`` of the shallowest directories that no covering directory reaches.

    A directory within a covering one is covered; one above a covering directory only passes through.
    The walk from the top reports the first directory that is neither: those whose proper ancestors
    all pass through. ``depth`` 0 leaves top-level ones out. Root files are no subject. ``excluded``
    is a condition over ``dir``; files below such a directory do not count.
    """
    named = files.select(X.parent_dir(F.col("path")).alias("own")).filter("own <> ''")
    if excluded is not None:
        tree = named.distinct().select("own", F.explode(X.ancestors(F.col("own"), root=False)).alias("dir"))
        named = named.join(tree.filter(excluded).select("own").distinct(), "own", "left_anti")
    dirs = dir_rollup(named.select(F.concat("own", F.lit("/f")).alias("path"))).select("dir", "n_files")
    cover = covering.select("dir").filter("dir <> ''").distinct()
    passing = cover.select(F.explode(X.ancestors(X.parent_dir(F.col("dir")), root=False)).alias("__up")).distinct()
    up = dirs.select("dir", F.explode(X.ancestors(F.col("dir"), root=False)).alias("__up"))
    state = (
        up.join(cover.select(F.col("dir").alias("__up"), F.lit(True).alias("__covers")), "__up", "left")
        .join(passing.withColumn("__passes", F.lit(True)), "__up", "left")
        .groupBy("dir").agg(
            F.bool_or(F.col("__covers").isNotNull()).alias("covered"),
            F.bool_or((F.col("__up") == F.col("dir")) & F.col("__passes").isNotNull()).alias("passes"),
            F.bool_and((F.col("__up") == F.col("dir")) | F.col("__passes").isNotNull()).alias("reached"),
        )
    )
    fires = ~F.col("covered") & ~F.col("passes") & F.col("reached") & (F.lit(depth >= 1) | F.col("dir").contains("/"))
    return dirs.join(state.filter(fires), "dir").select("dir", "n_files")


def chain_bytes(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``id, chain_bytes, chain_docs``: what a reader at each node loads, root to node.

    ``docs(dir, text)``: every document counts, whether or not its directory declares a node.
    """
    sizes = docs.groupBy(F.col("dir").alias("__up")).agg(F.sum(F.octet_length("text")).alias("__bytes"), F.count("*").alias("__docs"))
    up = nodes.select("id", F.explode(X.ancestors(F.col("dir"))).alias("__up"))
    return up.join(sizes, "__up").groupBy("id").agg(F.sum("__bytes").alias("chain_bytes"), F.sum("__docs").alias("chain_docs"))


def inherited(paths: DataFrame, nodes: DataFrame, claims: DataFrame) -> DataFrame:
    """``path, node_id, slug``: claims of the owner of each path and of all nodes above that owner.

    ``nodes(id, dir)``, ``claims(node_id, slug)``. Exposure goes up the owner's chain.
    """
    owned = territory_owner(paths.select("path").distinct(), nodes).filter("owner IS NOT NULL")
    per_owner = owned.select("owner").distinct().join(nodes.select(F.col("id").alias("owner"), "dir"), "owner")
    chain = per_owner.select("owner", F.explode(X.ancestors(F.col("dir"))).alias("dir")).join(nodes, "dir").select("owner", F.col("id").alias("node_id"))
    return owned.join(chain.join(claims.select("node_id", "slug"), "node_id"), "owner").select("path", "node_id", "slug")
