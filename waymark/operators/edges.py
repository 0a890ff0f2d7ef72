"""Edges between nodes: attribution, declared against extracted, neighbours by hops."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import ensure_checkpoints, stored
from .prefix import territory_owner


def attribute_refs(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``from_id, to_id`` and the reference's columns: both files of ``refs(from_file, to_file, ...)`` owned, by different nodes."""
    one = territory_owner(refs, nodes, path="from_file").withColumnRenamed("owner", "from_id")
    both = territory_owner(one, nodes, path="to_file").withColumnRenamed("owner", "to_id")
    return both.filter("from_id IS NOT NULL AND to_id IS NOT NULL AND from_id <> to_id")


def edge_summary(refs: DataFrame, *first: str) -> DataFrame:
    """One row per edge: how many references it has, and the first by ``first``."""
    return refs.groupBy("from_id", "to_id").agg(F.count("*").alias("n_refs"), F.min(F.struct(*first)).alias("first")).select("from_id", "to_id", "n_refs", "first.*")


def structural_violations(extracted: DataFrame, declared: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """``node, direction, target``: edges found but not declared, and declared but not found.

    All tables are ``(from_id, to_id)``. An allowed edge counts in neither direction.
    """
    keys = ["from_id", "to_id"]
    forward = extracted.select(keys).distinct().join(declared.select(keys), keys, "left_anti")
    reverse = declared.select(keys).distinct().join(extracted.select(keys), keys, "left_anti")
    both = forward.withColumn("direction", F.lit("undeclared")).unionByName(reverse.withColumn("direction", F.lit("vestigial")))
    if allowed is not None:
        both = both.join(allowed.select(keys), keys, "left_anti")
    return both.select(F.col("from_id").alias("node"), "direction", F.col("to_id").alias("target"))


#: Targets of a group that are listed for a source at once, and pairs that one key of the listing join stands for, about.
LISTED, PAIRS = 4096, 1 << 23
#: Found targets of a list that are compared one by one.
FEW = 16


def grouped_violations(extracted: DataFrame, sources: DataFrame, targets: DataFrame, frozen: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """``structural_violations`` where each of ``sources(from_id, group)`` declares all ``targets(to_id, group)`` of its groups.

    The declared pairs are never shuffled or written: a source meets its groups' targets as lists, less
    those that were found, and the pairs stream out of that join, whose partitions follow the number of pairs, not
    the small tables that are joined. What is shuffled is in proportion to
    edges, sources and targets; the result itself grows with the pairs. ``frozen(node, direction)``
    is a baseline of whole nodes, whose violations in a direction are left out before they are listed. The edges are
    dealt by source into ``parts``, or as many as Spark chooses.
    """
    spark = extracted.sparkSession
    own = sources.groupBy("from_id").agg(F.sort_array(F.collect_set("group")).alias("__set"))
    sets = own.select("__set").distinct().select("__set", F.explode("__set").alias("group"))
    members = stored(sets.join(targets.filter("group IS NOT NULL"), "group").select("__set", "to_id").distinct(), "members")
    most = members.groupBy("__set").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    chunk = F.pmod(F.xxhash64("to_id"), F.lit(-(-most // LISTED)))
    if frozen is None:
        own = own.withColumns({"__undeclared": F.lit(None).cast("boolean"), "__vestigial": F.lit(None).cast("boolean")})
    else:
        is_in = lambda d: F.max(F.col("direction") == d).alias(f"__{d}")
        own = own.join(frozen.groupBy(F.col("node").alias("from_id")).agg(is_in("undeclared"), is_in("vestigial")), "from_id", "full")

    # One shuffle by source serves the distinct edges and their join with the sources.
    dealt = extracted.select("from_id", "to_id").repartition(*([parts] if parts else []), "from_id")
    found = dealt.distinct().join(own, "from_id", "left")
    found = found.join(members.withColumn("__declared", F.lit(True)), ["__set", "to_id"], "left").withColumn("__declared", F.col("__declared").isNotNull())
    wanted = ~F.coalesce(F.when(F.col("__declared"), F.col("__vestigial")).otherwise(F.col("__undeclared")), F.lit(False))
    found = stored(found.filter(wanted).select("from_id", "to_id", "__declared"), "found")
    forward = found.filter("NOT __declared").select("from_id", "to_id")
    left = own.filter("__set IS NOT NULL AND NOT coalesce(__vestigial, false)").select("from_id", "__set")

    listed = left.groupBy("__set").agg(F.count("*").alias("__left")).join(members.groupBy("__set").agg(F.count("*").alias("__n")), "__set")
    listed = listed.select("__set", (F.col("__left") * F.col("__n")).alias("__pairs"), F.ceil(F.col("__left") * F.least("__n", F.lit(LISTED)) / PAIRS).alias("__parts"))
    pairs = listed.agg(F.sum("__pairs")).first()[0] or 0
    hits = found.filter("__declared").groupBy("from_id", chunk.alias("__chunk")).agg(F.collect_list("to_id").alias("__hits"))
    lists = members.groupBy("__set", chunk.alias("__chunk")).agg(F.collect_list("to_id").alias("__some"), F.max(F.col("to_id").isNull()).alias("__null"))
    # Lists leave nulls out; a null target is one of its group's pairs and is never found.
    lists = lists.select("__set", "__chunk", F.when(F.col("__null"), F.concat("__some", F.array(F.lit(None).cast(dict(members.dtypes)["to_id"])))).otherwise(F.col("__some")).alias("__some"))
    asked = left.select("from_id", "__set", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-most // LISTED) - 1).cast("long"))).alias("__chunk")).join(hits, ["from_id", "__chunk"], "left")
    keys = ["__set", "__chunk", "__part"]
    asked = asked.join(listed, "__set").withColumn("__part", F.pmod(F.xxhash64("from_id"), F.col("__parts"))).drop("__pairs", "__parts")
    lists = lists.join(listed, "__set").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1))).drop("__pairs", "__parts")
    if pairs > PAIRS:
        # A number that is asked for is kept; Spark would put small tables into one partition, however many pairs they give.
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS))
        asked, lists = asked.repartition(parts, *keys), lists.repartition(parts, *keys)
    # A few found targets are told from each listed one; many are taken out by one hash set per list.
    few = F.coalesce(F.size("__hits"), F.lit(0)) <= FEW
    rest = F.when(few, F.col("__some")).otherwise(F.array_except("__some", "__hits"))
    some = asked.join(lists, keys).select("from_id", F.when(few, F.col("__hits")).alias("__hits"), F.explode(rest).alias("to_id"))
    reverse = some.filter("NOT coalesce(array_contains(__hits, to_id), false)").select("from_id", "to_id")
    both = forward.withColumn("direction", F.lit("undeclared")).unionByName(reverse.withColumn("direction", F.lit("vestigial")))
    return both.select(F.col("from_id").alias("node"), "direction", F.col("to_id").alias("target"))


def subtract_frozen(violations: DataFrame, baseline: DataFrame) -> DataFrame:
    """Violations that the baseline ``(node, direction, target)`` does not list."""
    return violations.join(baseline, ["node", "direction", "target"], "left_anti")


def neighbours(contains: DataFrame, depends: DataFrame) -> DataFrame:
    """``src, dst``: what a node contains or depends on."""
    return contains.select(F.col("parent").alias("src"), F.col("child").alias("dst")).union(depends.select("from_id", "to_id")).distinct()


def hops_from(edges: DataFrame, start: DataFrame, *, depth: int | None = None, sources: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """``id, hop``: nodes of ``edges(src, dst)`` reached from ``start(id)``, each at its least distance.

    One join per hop with what is left after an anti-join of all visited nodes; it stops when a hop
    reaches nothing new, so a depth beyond the graph costs nothing. Each frontier is written to the
    checkpoint folder, which cuts its lineage.

    Each of ``sources(id, group)`` leads to all ``targets(id, group)`` of its groups too, in one hop. Those pairs
    are not listed: the first source of a group that is reached reaches all its targets, so a group's
    targets are read once.
    """
    ensure_checkpoints(edges.sparkSession)
    edges = edges.select("src", "dst").persist(StorageLevel.MEMORY_AND_DISK)
    seen = start.select("id").distinct().withColumn("hop", F.lit(0)).checkpoint()
    frontier, hop, used = seen, 0, None
    while depth is None or hop < depth:
        hop += 1
        reached = frontier.join(edges, frontier["id"] == edges["src"]).select(F.col("dst").alias("id"))
        if sources is not None:
            groups = frontier.select("id").join(sources.filter("group IS NOT NULL"), "id").select("group").distinct()
            groups = (groups if used is None else groups.join(used, "group", "left_anti")).checkpoint()
            used = groups if used is None else used.unionByName(groups)
            reached = reached.unionByName(groups.join(targets, "group").select("id"))
        frontier = reached.distinct().join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop)).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    edges.unpersist()
    return seen
