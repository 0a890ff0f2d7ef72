"""Freshness of claims against an ordered change history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_over(rebuilt: DataFrame, committed: DataFrame, keys: list[str], stamp: list[str]) -> DataFrame:
    """``rebuilt`` with the stamp that the committed row of the same key has, null where there is none."""
    return rebuilt.join(committed.select(*keys, *stamp), keys, "left")


def thresholds(claims: DataFrame, overrides: DataFrame, *, key: str, default: int | None) -> DataFrame:
    """``claims`` with the ``threshold`` of their node, or the general one; null switches the check off."""
    return claims.join(overrides.select(key, F.col("threshold").alias("__own")), key, "left").withColumn("threshold", F.coalesce("__own", F.lit(default).cast("long"))).drop("__own")


#: Positions of a file's history that are scanned together; what lies beyond is carried from range to range.
WIDTH = 4096


def _suffixes(line: DataFrame, within: list[str], at: str) -> DataFrame:
    """The marks of ``line(within, at, __mark, __n, __v)`` with what lies after each: ``__n``, and ``__one, __two``.

    ``__v`` is a version's ``(seq, digest)``; ``__one`` is the first by ``seq`` of those after the mark, ``__two``
    the ``seq`` of the first with another digest than that. Both are running values: a version of
    another digest than the first one's either stands behind it, or before it, which makes that one second.
    """
    after = Window.partitionBy(*within).orderBy(F.desc(at), F.desc("__mark")).rowsBetween(Window.unboundedPreceding, -1)
    seen = line.withColumns({"__later": F.coalesce(F.sum("__n").over(after), F.lit(0)), "__one": F.min("__v").over(after)})
    other = F.col("__one").isNotNull() & ~F.col("__v.digest").eqNullSafe(F.col("__one.digest"))
    seen = seen.withColumn("__c", F.when(F.col("__v").isNotNull() & other, F.greatest("__v.seq", "__one.seq")))
    return seen.withColumn("__two", F.min("__c").over(after)).filter("__mark").select(*within, at, F.col("__later").alias("__n"), "__one", "__two")


def after_marks(marks: DataFrame, versions: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """``keys, mark, n_later, first, first_digest, second``: what stands after each distinct mark of a key.

    ``marks(keys, mark)``, ``versions(keys, at, seq, digest)``: a version is later if ``at > mark``. ``first`` is
    the least ``seq`` of the later versions, ``second`` the least whose digest is another one. Histories are
    cut into ranges of ``width`` positions (of a day, if they are times). A range is scanned by itself; its count, its first version and
    its first of another digest stand for it where ranges are scanned in turn, so a file that half of
    all commits touch is many tasks, and one row or two for each range in the last scan.
    """
    kind = dict(versions.dtypes)["at"]
    part = F.unix_date(F.col("at").cast("date")) if kind.startswith(("timestamp", "date")) else F.floor(F.col("at") / width)
    held = versions.select(*keys, "at", part.alias("__range"), F.struct("seq", "digest").alias("__v"), F.lit(1).cast("long").alias("__n"), F.lit(False).alias("__mark"))
    asked = marks.filter("mark IS NOT NULL").select(*keys, F.col("mark").cast(kind).alias("at")).distinct()
    asked = asked.withColumns({"__range": part, "__v": F.lit(None).cast(dict(held.dtypes)["__v"]), "__n": F.lit(0).cast("long"), "__mark": F.lit(True)})
    own = _suffixes(held.unionByName(asked), [*keys, "__range"], "at")

    whole = held.groupBy(*keys, "__range", F.col("__v.digest").alias("__d")).agg(F.min("__v").alias("__v"), F.sum("__n").alias("__n"))
    place = Window.partitionBy(*keys, "__range").orderBy("__v")
    every = Window.partitionBy(*keys, "__range")
    tops = whole.withColumns({"__k": F.row_number().over(place), "__all": F.sum("__n").over(every)}).filter("__k <= 2")
    tops = tops.select(*keys, "__range", "__v", F.when(F.col("__k") == 1, F.col("__all")).otherwise(0).cast("long").alias("__n"), F.lit(False).alias("__mark"))
    turns = asked.select(*keys, "__range", "__v", "__n", "__mark").distinct()
    carried = _suffixes(tops.unionByName(turns), keys, "__range").withColumnsRenamed({"__n": "__n2", "__one": "__one2", "__two": "__two2"})

    both = own.join(carried, [*keys, "__range"])
    near = F.col("__one2").isNull() | (F.col("__one.seq") <= F.col("__one2.seq"))
    first = F.when(F.col("__one").isNotNull() & near, F.col("__one")).otherwise(F.col("__one2"))
    lost = F.when(F.col("__one").isNotNull() & near, F.col("__one2")).otherwise(F.col("__one"))
    mine = F.when(F.col("__one").isNotNull() & near, F.col("__two")).otherwise(F.col("__two2"))
    its = F.when(F.col("__one").isNotNull() & near, F.col("__two2")).otherwise(F.col("__two"))
    second = F.least(mine, F.when(lost["digest"].eqNullSafe(first["digest"]), its).otherwise(lost["seq"]))
    return both.select(*keys, F.col("at").alias("mark"), (F.col("__n") + F.col("__n2")).alias("n_later"), first["seq"].alias("first"), first["digest"].alias("first_digest"), second.alias("second"))


def churn(claims: DataFrame, commits: DataFrame, *, key: str = "file") -> DataFrame:
    """``claims(key, mark, threshold)`` with ``n_later`` and ``state``.

    Commits ``(key, seq)`` after a claim's mark are counted by ``after_marks``: commits and distinct marks
    are one row each, never pairs. More than the threshold is stale; a null mark means that history is
    unavailable, a null threshold that the check is off.
    """
    versions = commits.select(key, F.col("seq").alias("at"), "seq", F.lit(None).cast("string").alias("digest"))
    counted = after_marks(claims.select(key, "mark"), versions, [key]).select(key, F.col("mark").cast(dict(claims.dtypes)["mark"]).alias("mark"), "n_later")
    joined = claims.join(counted, [key, "mark"], "left").withColumn("n_later", F.coalesce("n_later", F.lit(0)))
    state = (
        F.when(F.col("threshold").isNull(), "off").when(F.col("mark").isNull(), "history-unavailable")
        .when(F.col("n_later") > F.col("threshold"), "stale").otherwise("fresh")
    )
    return joined.withColumn("state", state)


def staling_commit(claims: DataFrame, versions: DataFrame, *, key: str = "file") -> DataFrame:
    """``claims(key, mark, digest)`` with the oldest later version whose digest differs: ``staled_by``.

    ``versions(key, seq, digest)``; a version without a digest (region gone) differs from any. No claim
    meets more than the two versions that ``after_marks`` finds for its mark.
    """
    found = after_marks(claims.select(key, "mark"), versions.select(key, F.col("seq").alias("at"), "seq", "digest"), [key])
    found = found.withColumn("mark", F.col("mark").cast(dict(claims.dtypes)["mark"])).drop("n_later")
    joined = claims.join(found, [key, "mark"], "left")
    return joined.withColumn("staled_by", differing(F.col("digest"))).drop("first", "first_digest", "second")


def differing(digest: Column) -> Column:
    """Of a row of ``after_marks``, the first version that has another digest than this one."""
    return F.when(F.col("first_digest").eqNullSafe(digest) & digest.isNotNull(), F.col("second")).otherwise(F.col("first"))


def blame(claims: DataFrame) -> DataFrame:
    """``claims`` with ``outcome``: unverified, unresolved, stale, fresh, history-unavailable or churn.

    Columns read: ``verified_sha, verified_digest, resolved, current_digest, mark``. A claim that was
    never stamped is unverified; one whose anchor is gone unresolved; one with a digest is stale or
    fresh by it; the others are counted by commits, if their mark is in the history.
    """
    return claims.withColumn(
        "outcome",
        F.when(F.col("verified_sha").isNull(), "unverified").when(F.col("resolved").isNull(), "unresolved")
        .when(F.col("verified_digest").isNotNull(), F.when(F.col("current_digest").isNotNull() & (F.col("current_digest") != F.col("verified_digest")), "stale").otherwise("fresh"))
        .when(F.col("mark").isNull(), "history-unavailable").otherwise("churn"),
    )


def digest_freshness(claims: DataFrame, current: DataFrame, *, key: str = "file") -> DataFrame:
    """``claims(key, digest, guarded)`` with ``state``: guarded, fresh or stale by the digest now in ``current``."""
    joined = claims.join(current.select(key, F.col("digest").alias("__now")), key, "left")
    state = F.when(F.col("guarded"), "guarded").when(F.col("__now").eqNullSafe(F.col("digest")), "fresh").otherwise("stale")
    return joined.withColumn("state", state).drop("__now")
