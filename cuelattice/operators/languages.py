"""Language labels over time: switches that hold on both sides, and labels with too little behind them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelattice.operators.runs import label_runs

#: Labels that recognisers take for each other, and the label of several at once.
CONFUSED, MIXED = ("ja", "ko", "zh", "yue"), "mixed"
#: Rows or time that make a run count.
LEAST_ROWS, LEAST_MS = 3, 800
#: Support, agreed ranges, and share of the first label's support that keep a further label.
LEAST_SUPPORT, LEAST_AGREED, LEAST_SHARE = 8.0, 2, 0.5


def material_switches(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, least_rows: int = LEAST_ROWS, least_ms: int = LEAST_MS) -> DataFrame:
    """(keys, run, before, after, at_ms): changes between two labels whose runs both have ``least_rows`` rows or last ``least_ms``.

    A null or empty label, or that of several at once, switches to nothing and ends the run before it.
    """
    runs = label_runs(df, keys, order, label)
    w = Window.partitionBy(*keys).orderBy("run")
    told = F.nullif(F.col(label), F.lit("")).isNotNull() & (F.col(label) != MIXED)
    holds = told & ((F.col("members") >= least_rows) | (F.col("end_ms") - F.col("start_ms") >= least_ms))
    sides = runs.withColumn("_holds", holds).withColumns({"before": F.lag(label).over(w), "_held": F.lag("_holds").over(w)})
    return sides.where("_holds AND _held").select(*keys, "run", "before", F.col(label).alias("after"), F.col("start_ms").alias("at_ms"))


def stabilised(
    ranges: DataFrame, keys: Sequence[str], label: str, support: Column, agreed: Column, confused: Sequence[str] = CONFUSED,
    least_support: float = LEAST_SUPPORT, least_agreed: int = LEAST_AGREED, least_share: float = LEAST_SHARE,
) -> DataFrame:
    """``ranges`` with ``retained``: false where a label of ``confused`` has too little behind it within its key.

    Of these labels the one with most ``support`` stays (of equal ones the first by name), and each other that has
    ``least_support``, ``least_agreed`` ranges that are ``agreed``, and ``least_share`` of the first one's support.
    Other labels and nulls stay. What is ranked is a row a key and label, summed before the shuffle.
    """
    sums = ranges.where(F.col(label).isin(*confused)).groupBy(*keys, label).agg(F.sum(support).alias("_support"), F.count_if(agreed).alias("_agreed"))
    sums = sums.withColumn("_support", F.coalesce("_support", F.lit(0)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_support"), label)
    most = F.first("_support").over(w)
    enough = (F.col("_support") >= least_support) & (F.col("_agreed") >= least_agreed) & (F.col("_support") >= most * least_share)
    lost = sums.withColumn("_kept", (F.row_number().over(w) == 1) | enough).where("NOT _kept")
    lost = lost.select(*[F.col(k).alias(f"_lost_{i}") for i, k in enumerate((*keys, label))])
    same = [F.col(k).eqNullSafe(F.col(f"_lost_{i}")) for i, k in enumerate((*keys, label))]
    return ranges.join(lost, same, "left").select(*ranges.columns, F.col(f"_lost_{len(keys)}").isNull().alias("retained"))
