"""Histories with merges: which commits an ancestor holds, told by where they entered a line of first parents.

Commits fall into lines (paths along first parents). A commit is an ancestor of another one if it
entered that one's line at its place or before. So sets of ancestors are never listed: a line knows
each other line by a few (place, reach) pairs, and walks go from line to line, not from commit to commit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .history import WIDTH, after_marks

#: Where a commit enters a line that never holds it.
NEVER = (1 << 62) - 1


def lines(commits: DataFrame, parents: DataFrame) -> DataFrame:
    """``sha, seq, line``: the commits by lines, named by their last commit.

    ``commits(sha, seq)``: ``seq`` grows from parents to children; ``parents(sha, ord, parent)``, ``ord`` 0 for
    the first parent. A commit goes on to the last of the children whose first parent it is. Lines are found by
    doubling, in as many rounds as the number of commits has binary digits.
    """
    place = commits.select(F.col("sha").alias("child"), "seq")
    after = parents.filter("ord = 0").select(F.col("sha").alias("child"), F.col("parent").alias("sha")).join(place, "child").groupBy("sha").agg(F.max_by("child", "seq").alias("line"))
    known = stored(commits.select("sha", "seq").join(after, "sha", "left").withColumn("line", F.coalesce("line", "sha")), "lines")
    for _ in range(max(1, math.ceil(math.log2(max(2, known.count()))))):
        ahead = known.select(F.col("sha").alias("line"), F.col("line").alias("beyond"))
        moved = stored(known.join(ahead, "line", "left").select("sha", "seq", F.coalesce("beyond", "line").alias("line"), (F.coalesce("beyond", "line") != F.col("line")).alias("moved")), "lines")
        known = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break
    return known


def _least_before(rows: DataFrame, keys: list[str], place: Column, value: Column, *ties: Column) -> DataFrame:
    """``rows`` with ``__least``: the least ``value`` of those that stand before them among their ``keys``, by ``place`` and ``ties``.

    Places are cut into ranges of ``history.WIDTH``, each scanned by itself; one row of a range stands for it
    where ranges are scanned in turn. So no window holds all places of a line.
    """
    ranged = rows.withColumn("__range", F.floor(place / WIDTH))
    own = Window.partitionBy(*keys, "__range").orderBy(place, *ties).rowsBetween(Window.unboundedPreceding, -1)
    turns = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranged.groupBy(*keys, "__range").agg(F.min(value).alias("__own")).select(*keys, "__range", F.min("__own").over(turns).alias("__carried"))
    return ranged.withColumn("__own", F.min(value).over(own)).join(carried, [*keys, "__range"]).withColumn("__least", F.least("__own", "__carried")).drop("__range", "__own", "__carried")


def _best(reach: DataFrame, *ties: Column) -> DataFrame:
    """The pairs that no earlier place outdoes: ``at`` and ``to`` grow together."""
    seen = _least_before(reach, ["line", "other"], F.col("at"), -F.col("to"), F.desc("to"), *ties)
    return seen.filter("__least IS NULL OR to > -__least").drop("__least")


def _entered(marks: DataFrame, reach: DataFrame) -> DataFrame:
    """``marks(other, seq, ...)`` for each line of ``reach`` that ever holds them, with ``line`` and the first place ``at`` that does.

    A mark meets each line once, however many pairs the line and the mark's own line have.
    """
    asked = marks.join(reach.select("line", "other").distinct(), "other").withColumn("at", F.lit(None).cast("long"))
    pairs = reach.select("line", "other", F.col("to").alias("seq"), F.col("at").cast("long").alias("at"))
    both = asked.withColumn("__mark", F.lit(True)).unionByName(pairs.withColumn("__mark", F.lit(False)), allowMissingColumns=True)
    seen = _least_before(both, ["line", "other"], -F.col("seq"), F.col("at"), F.col("__mark"))
    return seen.filter("__mark AND __least IS NOT NULL").withColumn("at", F.col("__least")).drop("__mark", "__least")


def reaches(known: DataFrame, parents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``line, other, at, to``: from ``at`` on, the ``wanted(line)`` lines hold the line ``other`` up to ``to`` (both as ``seq``).

    One round per line that lies between; each round takes the parents that lead from one line to
    another from the first place that holds them, and drops what is outdone.
    """
    child = known.select("sha", F.col("line").alias("from"), F.col("seq").alias("out"))
    parent = known.select(F.col("sha").alias("parent"), F.col("line").alias("into"), F.col("seq").alias("in"))
    steps = stored(parents.join(child, "sha").join(parent, "parent").filter("from <> into").select("from", "out", "into", "in"), "steps")
    own = wanted.select("line").distinct()
    fresh = stored(_best(steps.join(own, steps["from"] == own["line"]).select("line", F.col("into").alias("other"), F.col("out").alias("at"), F.col("in").alias("to"))), "reach")
    found = fresh
    leads = steps.select(F.col("from").alias("other"), F.col("out").alias("seq"), "into", "in")
    while not fresh.isEmpty():
        onward = _entered(leads, fresh).filter("into <> line").select("line", F.col("into").alias("other"), "at", F.col("in").alias("to"))
        merged = stored(found.withColumn("new", F.lit(False)).unionByName(onward.distinct().withColumn("new", F.lit(True))), "merged")
        kept = stored(_best(merged, F.col("new")), "reach")
        found, fresh = kept.drop("new"), kept.filter("new").drop("new")
    return found


def entries(known: DataFrame, reach: DataFrame, wanted: DataFrame) -> DataFrame:
    """``line, sha, seq, at``: where each commit entered each ``wanted(line)`` that ever holds it."""
    own = known.join(wanted.select("line").distinct(), "line").select("line", "sha", "seq", F.col("seq").alias("at"))
    placed = _entered(known.select(F.col("line").alias("other"), "sha", "seq"), reach)
    return own.unionByName(placed.select("line", "sha", "seq", "at"))


def since_stamps(claims: DataFrame, commits: DataFrame, parents: DataFrame, versions: DataFrame, head: str) -> DataFrame:
    """``claims(file, verified_sha, ...)`` with ``known, n_later, first, first_digest, second`` over the commits since their stamp.

    Those are the commits to the file that ``head`` holds and the stamp's commit does not, as
    ``versions(sha, file, digest)`` lists them: ``n_later`` of them, and the two that ``history.after_marks`` gives,
    by ``seq``. ``known`` is false where the stamp's commit is not among ``commits(sha, seq)``. Without merges
    this is all that comes later.
    """
    placed = lines(commits, parents)
    stamps = claims.select("verified_sha").distinct().join(placed.select(F.col("sha").alias("verified_sha"), F.col("seq").alias("mark"), "line"), "verified_sha")
    ours = placed.filter(F.col("sha") == head).select("line", F.col("seq").alias("top"))
    wanted = stored(stamps.select("line").unionByName(ours.select("line")).distinct(), "wanted")
    entered = stored(entries(placed, reaches(placed, parents, wanted), wanted), "entries")
    held = entered.join(ours, "line").filter("at <= top").select("sha", "seq")
    touched = versions.join(held, "sha").join(claims.select("file").distinct(), "file", "left_semi")
    by_line = touched.join(claims.join(stamps, "verified_sha").select("file", "line").distinct(), "file")
    by_line = by_line.join(entered.select("line", "sha", "at"), ["line", "sha"], "left").select("file", "line", F.coalesce("at", F.lit(NEVER)).alias("at"), "seq", "digest")
    asked = claims.join(stamps, "verified_sha").select("file", "line", "mark")
    found = after_marks(asked, by_line, ["file", "line"])
    joined = claims.join(stamps, "verified_sha", "left").withColumn("known", F.col("line").isNotNull())
    return joined.join(found, ["file", "line", "mark"], "left").drop("line", "mark").withColumn("n_later", F.coalesce("n_later", F.lit(0)))


def attribute(claims: DataFrame, digest: str = "verified_digest") -> DataFrame:
    """The rows of ``since_stamps`` with ``staled_by`` and ``attribution``: commit, uncommitted or history-unavailable.

    ``tree_differs`` tells whether the work tree's file is another than the head's. A change is put down to the
    oldest commit that changed the digest; without one to the work tree, if it differs; a stamp that
    history lacks, and a change that neither explains, to history that is not there.
    """
    by = F.when(F.col("first_digest").eqNullSafe(F.col(digest)) & F.col(digest).isNotNull(), F.col("second")).otherwise(F.col("first"))
    staled = claims.withColumn("staled_by", F.when(F.col("known"), by))
    why = F.when(F.col("staled_by").isNotNull(), "commit").when(F.col("known") & F.col("tree_differs"), "uncommitted").otherwise("history-unavailable")
    return staled.withColumn("attribution", why)
