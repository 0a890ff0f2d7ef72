"""Mixing sources to target weights: capped water-filling and seeded repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Hash bins into which each source's documents are dealt for the fractional repetition.
BINS = 4096


def word_count(text: Column) -> Column:
    """Words in ``text``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Targets for ``sources(source, source_size, weight)`` that add up to ``total`` words.

    Each source gets words in proportion to its weight, ``max_epochs`` times its size at most.
    What the full sources cannot take goes to the others by weight, again and again, until no
    target is above its limit. One aggregate row per round reaches the driver; each round fills
    at least one more source, and the level only rises.

    A source of size 0 or of null or negative weight gets 0. If all limits together are below
    ``total``, every source with a positive weight gets its limit.
    """
    weight = F.greatest(F.coalesce(F.col("weight"), F.lit(0)).cast("double"), F.lit(0.0))
    limit = F.col("source_size") * F.lit(float(max_epochs))
    level = 0.0
    while True:
        full = weight * F.lit(level) >= limit
        row = sources.filter(weight > 0).agg(
            F.sum(F.when(full, limit)).alias("full"), F.sum(F.when(~full, weight)).alias("open")
        ).first()
        if not row["open"]:
            level = float("inf")
            break
        risen = (total - (row["full"] or 0.0)) / row["open"]
        if risen <= level:
            break
        level = risen
    share = limit if level == float("inf") else F.least(limit, weight * F.lit(level))
    return sources.withColumn("target", F.when(weight > 0, share).otherwise(F.lit(0.0)))


def mix_sources(
    docs: DataFrame,
    weights: DataFrame,
    *,
    total: float,
    max_epochs: float = 2.0,
    id_col: str = "doc_id",
    seed: int = 20,
) -> DataFrame:
    """Decide how often the mix repeats each row of ``docs(<id>, source, size, ...)``.

    ``weights(source, source_size, weight)`` has one row per source of ``docs``; null is a source
    like any other. Every document is repeated ``floor(target / source_size)`` times. For the
    remaining fraction, documents are dealt into bins by a seeded hash of their id; bins are taken
    whole in order until the source's remaining words are reached, and of the bin at the border
    the same fraction of the hash range. So a source misses its target by about one document, and
    no task orders a whole source: only the bins' sums are added up, and the join back is on
    (source, bin), which deals a hot source over ``BINS`` keys.

    Adds ``source_size, target, repeats``. Rows with equal ids (or null ids) share a hash and are
    taken alike; rows of size 0 follow their bin and add no words; reruns give the same mix. An
    empty table gives an empty table. Other columns pass through; a column named like one that is
    added here is replaced.
    """
    targets = water_fill(weights, total, max_epochs)
    docs = docs.drop("source_size", "target", "repeats", "weight")
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(BINS << 32))
    dealt = docs.withColumns({"__bin": F.shiftright(u, 32).cast("int"), "__at": F.pmod(u, F.lit(1 << 32)) / F.lit(float(1 << 32))})
    bins = dealt.groupBy("source", "__bin").agg(F.sum("size").alias("__words"))
    per_source = targets.select(F.col("source").alias("__source"), "source_size", "target")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    running = Window.partitionBy("source").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        bins.join(per_source, F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("__before", F.coalesce(F.sum("__words").over(running), F.lit(0)))
        .withColumn("__whole", whole)
        .withColumn("__rest", F.col("target") - F.col("__whole") * F.col("source_size") - F.col("__before"))
        .select(
            "__source", F.col("__bin").alias("__b"), "source_size", "target", "__whole",
            F.when(F.col("__words") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__rest") / F.col("__words")))).otherwise(F.lit(0.0)).alias("__part"),
        )
    )
    joined = dealt.join(bins, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__bin") == F.col("__b")))
    repeats = (F.col("__whole") + (F.col("__at") < F.col("__part")).cast("int")).cast("int")
    return joined.withColumn("repeats", repeats).drop("__bin", "__b", "__at", "__source", "__whole", "__part")


def cycle_weights(sized: DataFrame, cycle: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """One row per source of ``sized(source, size)``: its words, and a weight by its rank.

    Sources rank by code point, null last. Only the per-source sums are ordered in one place.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    pick = F.element_at(F.array(*map(F.lit, cycle)), ((rank - 1) % len(cycle) + 1).cast("int"))
    return per_source.withColumn("weight", pick)


def mix_documents(docs: DataFrame, *, budget: float = 1.5, max_epochs: float = 2.0, seed: int = 20) -> DataFrame:
    """Mix ``docs(doc_id, text, source, ...)`` to cyclic source weights and ``budget`` times its words.

    Returns ``doc_id, source, size, source_size, target, repeats``. Sizes are words of whole texts (null and
    empty: 0); a null source is a source of its own, the last in order; rows with one id and source share
    their number of repeats; an empty table gives no rows. Other columns are not read, so their names do
    not clash. Sources are ordered in one place, a row each.
    """
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    weights = materialize(cycle_weights(sized), "weights")
    total = budget * (weights.agg(F.sum("source_size")).first()[0] or 0)
    return mix_sources(sized, weights, total=total, max_epochs=max_epochs, seed=seed)
