"""What is read off a compiled graph: nodes, hazards, anchors and routers, what is rendered from them, and what differs on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import resolve
from .graph import GraphTables


def node(graph: GraphTables, ids: DataFrame) -> DataFrame:
    """``query, outcome, candidates`` and all fields of the node that each query names, null where it names none."""
    return resolve.node_lookup(ids, graph.nodes.select("id")).join(graph.nodes, "id", "left")


def hazards(graph: GraphTables, ids: DataFrame | None = None) -> DataFrame:
    """``slug, node_id, text, anchor`` of all hazards (of the nodes ``ids(id)``), to be read by slug, then node."""
    found = graph.claims.filter("kind = 'hazard'")
    if ids is not None:
        found = found.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    return found.select("slug", "node_id", "text", "anchor")


def anchors(graph: GraphTables) -> DataFrame:
    """``node_id, slug, place``: the landmarks in each node's territory, their files told from the node's directory."""
    own = graph.nodes.select(F.col("id").alias("node"), "dir")
    return graph.landmarks.join(own, "node").select(F.col("node").alias("node_id"), "slug", F.concat_ws(":", X.flat(X.relativize(F.col("file"), F.col("dir"))), "line").alias("place"))


def router(graph: GraphTables, *, system: bool = True) -> DataFrame:
    """``node_id, id, kind, purpose, source``: each node's children; for the system's node also what it depends on."""
    links = graph.contains.select(F.col("parent").alias("node_id"), F.col("child").alias("id"))
    if system:
        links = links.union(graph.depends.filter(F.col("node_id") == X.SYSTEM_ID).select("node_id", F.col("target").alias("id"))).distinct()
    return links.join(graph.nodes.select("id", "kind", "purpose", "source"), "id").select("node_id", "id", "kind", "purpose", "source")


def root(graph: GraphTables) -> DataFrame:
    """``section, ord, line``: the system's node as text rows: identity, commands, hazards by slug, and its router."""
    own = graph.nodes.filter(F.col("id") == X.SYSTEM_ID)
    rows = own.select(F.lit(1).alias("section"), F.lit("").alias("ord"), X.flat(F.coalesce("purpose", F.lit(""))).alias("line"))
    rows = rows.unionByName(own.select(F.explode("commands").alias("ord", "c")).select(F.lit(2).alias("section"), "ord", F.concat(F.lit("- "), "ord", F.lit(": "), X.flat(F.col("c"))).alias("line")))
    said = F.concat(F.lit("- "), "node_id", F.lit(": "), X.flat(F.col("text")), F.lit(" ("), "anchor", F.lit(")"))
    rows = rows.unionByName(hazards(graph).select(F.lit(3).alias("section"), F.concat_ws(" ", "slug", "node_id").alias("ord"), said.alias("line")))
    listed = router(graph).filter(F.col("node_id") == X.SYSTEM_ID)
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(X.cell(F.coalesce(c, F.lit(""))) for c in ("id", "kind", "purpose", "source"))), F.lit(" |"))
    return rows.unionByName(listed.select(F.lit(4).alias("section"), F.col("id").alias("ord"), cells.alias("line")))


def regions(graph: GraphTables) -> DataFrame:
    """``node_id, body``: the generated region of each node but the system's: its anchors by slug, then its children by id."""
    marks = anchors(graph).groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slug", "place"))), lambda r: F.concat(F.lit("- ※ "), r["slug"], F.lit(" → "), r["place"], F.lit("\n"))), "").alias("a"))
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(X.cell(F.coalesce(c, F.lit(""))) for c in ("id", "kind", "purpose", "source"))), F.lit(" |\n"))
    children = router(graph, system=False).groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", cells.alias("c")))), lambda r: r["c"]), "").alias("r"))
    heads = F.when(F.col("a").isNotNull(), F.concat(F.lit("## Anchors in this territory\n\n"), "a")), F.when(F.col("r").isNotNull(), F.concat(F.lit("## Router\n\n| node | kind | purpose | source |\n| --- | --- | --- | --- |\n"), "r"))
    ids = graph.nodes.filter(F.col("id") != X.SYSTEM_ID).select(F.col("id").alias("node_id"))
    return ids.join(marks, "node_id", "left").join(children, "node_id", "left").select("node_id", F.concat_ws("\n", *heads).alias("body"))


def differences(rendered: DataFrame, present: DataFrame) -> DataFrame:
    """``path, state``: missing, changed or stale (on disk but not rendered) outputs; those that agree are left out."""
    both = rendered.select("path", F.col("text").alias("__new")).join(present.select("path", F.col("text").alias("__old")), "path", "full_outer")
    state = F.when(F.col("__old").isNull(), "missing").when(F.col("__new").isNull(), "stale").when(F.col("__old") != F.col("__new"), "changed")
    return both.select("path", state.alias("state")).filter("state IS NOT NULL")


def proposable(files: DataFrame, covered: DataFrame, *, reserved: tuple[str, ...] = (".git",)) -> DataFrame:
    """``dir, n_files``: first-level directories with tracked files that hold no covered directory and are not reserved."""
    tops = files.filter(F.contains("path", F.lit("/"))).groupBy(F.substring_index("path", "/", 1).alias("dir")).agg(F.count("*").alias("n_files"))
    taken = covered.filter("dir <> ''").select(F.substring_index("dir", "/", 1).alias("dir")).distinct()
    return tops.filter(~F.col("dir").isin(*reserved)).join(taken, "dir", "left_anti")


def untracked_nodes(present: DataFrame, tracked: DataFrame, node_file: str) -> DataFrame:
    """``path``: node files in the work tree that are not tracked, so that no build sees them."""
    return present.filter(X.basename(F.col("path")) == node_file).select("path").distinct().join(tracked.select("path"), "path", "left_anti")


def with_overlay(files: DataFrame, private: DataFrame) -> DataFrame:
    """``files(path, content)`` with the private ones added; where both have a path, the private one counts."""
    return files.join(private.select("path"), "path", "left_anti").unionByName(private)


def blame(graph: GraphTables, states: DataFrame, addresses: DataFrame) -> DataFrame:
    """``address, lookup, node_id, slug, outcome, region, attribution, staled_sha, n_later``: what became of the claims asked for.

    ``addresses(address)`` may be short; ``lookup`` is found, ambiguous or not-found. ``states`` come from
    ``check.claim_states``.
    """
    every = graph.nodes.select(F.col("id").alias("node_id"), F.lit(None).cast("string").alias("slug")).unionByName(graph.claims.select("node_id", "slug"))
    asked = resolve.claim_lookup(addresses, every).withColumnRenamed("outcome", "lookup").withColumn("slug", F.substring_index("address", "/", -1))
    told = states.select("node_id", "slug", "outcome", "region", "attribution", "staled_sha", "n_later")
    return asked.join(told, ["node_id", "slug"], "left").select("address", "lookup", "node_id", "slug", "outcome", "region", "attribution", "staled_sha", "n_later")
