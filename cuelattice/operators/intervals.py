"""Interval algebra over (key, start_ms, end_ms) tables.

Every operation partitions by the key columns and keeps intervals half open. Rows whose start or end is
null, or whose end is not after the start, carry no time and are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since the epoch of a timestamp (with or without a zone), truncated."""
    return (F.unix_micros(ts.cast("timestamp")) / F.lit(1000)).cast("long")


def valid(df: DataFrame, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    return df.where(F.col(end) > F.col(start))


def islands(df: DataFrame, keys: Sequence[str], start: str = "start_ms", end: str = "end_ms", bridge_ms: int = 0) -> DataFrame:
    """Union of each key's intervals as disjoint rows; gaps of at most ``bridge_ms`` are bridged.

    Returns the keys, ``island``, ``start_ms``, ``end_ms`` and ``members``. Touching intervals merge.
    """
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(before)
    marked = valid(df, start, end).withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + bridge_ms), 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(
        F.min(start).alias("start_ms"), F.max(end).alias("end_ms"), F.count(F.lit(1)).alias("members")
    )


def union_measure(df: DataFrame, keys: Sequence[str], **kw: str | int) -> DataFrame:
    """Active time and number of islands of each key."""
    return islands(df, keys, **kw).groupBy(*keys).agg(
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("active_ms"), F.count(F.lit(1)).alias("islands")
    )


def gaps(df: DataFrame, keys: Sequence[str], start: str = "start_ms", end: str = "end_ms", least_ms: int = 1, most_ms: int | None = None) -> DataFrame:
    """What lies between a key's islands: the complement of its intervals within its own span."""
    whole = islands(df, keys, start, end)
    follow = F.lead("start_ms").over(Window.partitionBy(*keys).orderBy("island"))
    found = whole.select(*keys, F.col("end_ms").alias("gap_start_ms"), follow.alias("gap_end_ms")).where("gap_end_ms IS NOT NULL")
    length = F.col("gap_end_ms") - F.col("gap_start_ms")
    wanted = length >= least_ms
    return found.where(wanted if most_ms is None else wanted & (length <= most_ms))


def overlap_sweep(df: DataFrame, keys: Sequence[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Time of each key with two or more intervals at once, and the most at once, by a sweep over the edges."""
    live = valid(df, start, end)
    edges = live.select(*keys, F.explode(F.array(
        F.struct(F.col(start).alias("at"), F.lit(1).alias("step")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("step"))
    )).alias("e")).groupBy(*keys, "e.at").agg(F.sum("e.step").alias("step"))
    order = Window.partitionBy(*keys).orderBy("at")
    swept = edges.select(*keys, "at", F.sum("step").over(order).alias("active"), F.lead("at").over(order).alias("until"))
    return swept.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("active") >= 2, F.col("until") - F.col("at"))), F.lit(0)).alias("overlap_ms"),
        F.max("active").alias("most_active"),
    )


def overlap_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], width_ms: int = 60_000) -> DataFrame:
    """Overlapping pairs of two (keys, start_ms, end_ms, ...) tables whose other columns have different names.

    The right side's interval columns become r_start_ms and r_end_ms. Both sides are dealt out by key and
    stretch of time, so that a busy key is many small joins; a pair is kept in the stretch where its later
    start lies, hence once. ``overlap_ms`` is the shared time.
    """
    stretch = lambda c: F.floor(F.col(c) / width_ms)
    spread = lambda s, e: F.explode(F.sequence(stretch(s), F.floor((F.col(e) - 1) / width_ms)))
    ours = valid(left).withColumn("_stretch", spread("start_ms", "end_ms"))
    theirs = valid(right).withColumnsRenamed({"start_ms": "r_start_ms", "end_ms": "r_end_ms"}).withColumn("_stretch", spread("r_start_ms", "r_end_ms"))
    begin, finish = F.greatest("start_ms", "r_start_ms"), F.least("end_ms", "r_end_ms")
    return (
        ours.join(theirs, [*keys, "_stretch"])
        .where((begin < finish) & (F.floor(begin / width_ms) == F.col("_stretch")))
        .withColumn("overlap_ms", finish - begin).drop("_stretch")
    )


def best_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], row: str, label: str, order: str, width_ms: int = 60_000) -> DataFrame:
    """For each ``row`` of the left, the right ``label`` with the longest overlap; the first by ``order`` on ties."""
    pairs = overlap_pairs(left, right, keys, width_ms)
    best = F.max(F.struct(F.col("overlap_ms"), (-F.col(order)).alias("first"), F.col(label).alias("label")))
    return pairs.groupBy(*keys, row).agg(best.alias("b")).select(*keys, row, F.col("b.label").alias(label), F.col("b.overlap_ms").alias("overlap_ms"))


def covered(left: DataFrame, right: DataFrame, keys: Sequence[str], row: str, width_ms: int = 60_000) -> DataFrame:
    """Rows of the left with any overlap on the right, once each."""
    return overlap_pairs(left, right, keys, width_ms).select(*keys, row).distinct()


def nearest_within(left: DataFrame, right: DataFrame, keys: Sequence[str], row: str, order: str, within_ms: int) -> DataFrame:
    """The right interval nearest to each left midpoint, at ``within_ms`` or less; the first by ``order`` on ties."""
    middle = F.floor((F.col("start_ms") + F.col("end_ms")) / 2).cast("long")
    points = valid(left).select(*keys, row, middle.alias("mid_ms"), (middle - within_ms).alias("start_ms"), (middle + within_ms + 1).alias("end_ms"))
    wide = valid(right).select(*keys, order, F.col("start_ms").alias("at_ms"), F.col("end_ms").alias("to_ms"), "start_ms", (F.col("end_ms") + 1).alias("end_ms"))
    away = F.greatest(F.col("at_ms") - F.col("mid_ms"), F.col("mid_ms") - F.col("to_ms"), F.lit(0))
    pairs = overlap_pairs(points, wide, keys).withColumn("distance_ms", away).where(F.col("distance_ms") <= within_ms)
    best = F.min(F.struct("distance_ms", order))
    return pairs.groupBy(*keys, row).agg(best.alias("b")).select(*keys, row, "b.*")


def subtract(left: DataFrame, right: DataFrame, keys: Sequence[str], row: str) -> DataFrame:
    """The parts of each left interval that no right interval covers."""
    inside = overlap_pairs(left, right, keys)
    cut = islands(
        inside.select(*keys, row, F.col("start_ms").alias("l0"), F.col("end_ms").alias("l1"),
                      F.greatest("start_ms", "r_start_ms").alias("start_ms"), F.least("end_ms", "r_end_ms").alias("end_ms")),
        [*keys, row, "l0", "l1"],
    )
    order = Window.partitionBy(*keys, row, "l0", "l1").orderBy("island")
    before = cut.select(*keys, row, F.coalesce(F.lag("end_ms").over(order), F.col("l0")).alias("start_ms"), F.col("start_ms").alias("end_ms"))
    after = cut.groupBy(*keys, row, "l0", "l1").agg(F.max("end_ms").alias("start_ms")).select(*keys, row, "start_ms", F.col("l1").alias("end_ms"))
    alone = valid(left).join(inside.select(*keys, row).distinct(), [*keys, row], "left_anti").select(*keys, row, "start_ms", "end_ms")
    return before.unionByName(after).where("end_ms > start_ms").unionByName(alone)
