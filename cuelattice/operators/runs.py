"""Runs of equal labels, sessions and rolling frames over ordered rows of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def label_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Run-length encoding: keys, run, label, start_ms, end_ms, members."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    numbered = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "run").agg(
        F.first(label).alias(label), F.min(start).alias("start_ms"), F.max(end).alias("end_ms"), F.count(F.lit(1)).alias("members")
    )


def short_islands(runs: DataFrame, keys: Sequence[str], label: str, most_ms: int = 1500) -> DataFrame:
    """Runs of at most ``most_ms`` between two runs of one other label (A, B, A)."""
    w = Window.partitionBy(*keys).orderBy("run")
    sides = runs.withColumns({"before": F.lag(label).over(w), "after": F.lead(label).over(w)})
    short = (F.col("before") == F.col("after")) & (F.col("end_ms") - F.col("start_ms") <= most_ms)
    return sides.where(short).select(*keys, "run", label, F.col("before").alias("around"), "start_ms", "end_ms", "members")


def sessions(df: DataFrame, keys: Sequence[str], order: Sequence[str], gap_ms: int, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Rows of a key joined while each starts within ``gap_ms`` of the end reached so far."""
    w = Window.partitionBy(*keys).orderBy(start, *order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = df.withColumn("_new", F.when(reach.isNull() | (F.col(start) - reach > gap_ms), 1).otherwise(0))
    numbered = numbered.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "session").agg(
        F.min(start).alias("start_ms"), F.max(end).alias("end_ms"), F.count(F.lit(1)).alias("members"), F.sum(F.col(end) - F.col(start)).alias("support_ms")
    )


def rolling(df: DataFrame, keys: Sequence[str], at: str, value: str, back_ms: int) -> DataFrame:
    """Number and sum of a key's rows in the ``back_ms`` up to and with each row; ``value`` is a whole or decimal number.

    A frame reaches into the stretch of ``back_ms`` before its own at most, so a key's stretches are counted apart. A
    stretch starts with the totals of the one before, each row adds itself when it comes, and takes itself off in the next
    stretch when it leaves the frames: one running sum, whose cost doesn't grow with the rows of a frame. Rows without a time are left out.
    """
    timed = df.withColumn("_stretch", F.floor(F.col(at) / back_ms)).where(F.col("_stretch").isNotNull())
    some = F.when(F.col(value).isNotNull(), 1).otherwise(0)
    own = timed.select("*", F.col(at).alias("_at"), F.lit(1).alias("_n"), some.alias("_some"), F.col(value).alias("_sum"))
    left = timed.select(*keys, (F.col("_stretch") + 1).alias("_stretch"), (F.col(at) + back_ms + 1).alias("_at"), F.lit(-1).alias("_n"), (-some).alias("_some"), (-F.col(value)).alias("_sum"))
    left = left.where(F.col("_at") < (F.col("_stretch") + 1) * back_ms)
    sums = [F.sum(c).alias(c) for c in ("_n", "_some", "_sum")]
    before = timed.select(*keys, "_stretch", F.lit(1).alias("_n"), some.alias("_some"), F.col(value).alias("_sum")).groupBy(*keys, "_stretch").agg(*sums)
    before = before.select(*keys, (F.col("_stretch") + 1).alias("_stretch"), ((F.col("_stretch") + 1) * back_ms).alias("_at"), "_n", "_some", "_sum")
    steps = own.withColumn("_row", F.lit(True)).unionByName(left.unionByName(before), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_stretch").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    counted = steps.withColumns({"window_count": F.sum("_n").over(w), "window_sum": F.when(F.sum("_some").over(w) > 0, F.sum("_sum").over(w))})
    return counted.where("_row").select(*df.columns, "window_count", "window_sum")


def isolated(df: DataFrame, keys: Sequence[str], order: Sequence[str], away_ms: int, most_ms: int, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Rows of at most ``most_ms`` with no neighbour within ``away_ms`` on either side."""
    w = Window.partitionBy(*keys).orderBy(start, *order)
    before = F.col(start) - F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead(start).over(w) - F.col(end)
    alone = (F.coalesce(before, F.lit(away_ms)) >= away_ms) & (F.coalesce(after, F.lit(away_ms)) >= away_ms)
    return df.withColumn("_alone", alone).where(F.col("_alone") & (F.col(end) - F.col(start) <= most_ms)).drop("_alone")


def snap_gaps(df: DataFrame, keys: Sequence[str], order: Sequence[str], below_ms: int = 100, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Closes gaps of under ``below_ms``: both edges meet at the gap's middle plus a quarter of the gap."""
    w = Window.partitionBy(*keys).orderBy(start, *order)
    after, before = F.lead(start).over(w), F.lag(end).over(w)
    meet = lambda e, s: F.floor((e + s) / 2).cast("long") + F.floor((s - e) / 4).cast("long")
    small = lambda g: (g > 0) & (g < below_ms)
    return df.withColumns({
        "snapped_end_ms": F.when(small(after - F.col(end)), meet(F.col(end), after)).otherwise(F.col(end)),
        "snapped_start_ms": F.when(small(F.col(start) - before), meet(before, F.col(start))).otherwise(F.col(start)),
    })
