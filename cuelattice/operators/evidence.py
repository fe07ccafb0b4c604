"""Evidence over whole documents: repeats, chunk borders, windows of text, labels that stand for a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def periodic_repeats(words: DataFrame, key: str, at: str, word: str, widths: Sequence[int], least: int = 4) -> DataFrame:
    """Stretches of a document in which the same ``width`` words come ``least`` times or more in a row.

    A word that equals the one ``width`` places before it goes on with a repeat; islands of such words are
    the stretches. Returns key, width, first_at, last_at, repeats.
    """
    order = Window.partitionBy(key).orderBy(at)
    same = F.array(*[F.when(F.lag(word, k).over(order) == F.col(word), F.lit(k)) for k in widths])
    hits = words.select(key, at, same.alias("s")).select(key, at, F.explode(F.filter("s", lambda k: k.isNotNull())).alias("width"))
    island = F.col(at) - F.row_number().over(Window.partitionBy(key, "width").orderBy(at))
    runs = hits.withColumn("island", island).groupBy(key, "width", "island").agg(F.min(at).alias("a"), F.max(at).alias("b"))
    repeats = F.floor((F.col("b") - F.col("a") + 1) / F.col("width")) + 1
    return runs.select(key, "width", (F.col("a") - F.col("width")).alias("first_at"), F.col("b").alias("last_at"), repeats.alias("repeats")).where(F.col("repeats") >= least)


def placed(rows: DataFrame, key: str, order: Sequence[str], start: str, end: str, stretch_ms: int) -> DataFrame:
    """key, idx (from 0) and gap to the next row, for rows in ``order``, whose first column is ``start``.

    Rows are numbered within stretches of time, and the stretches' sums shift them, so that no task gets a key whole.
    """
    cut = rows.withColumn("_stretch", F.floor(F.col(start) / stretch_ms))
    sums = cut.groupBy(key, "_stretch").agg(F.count(F.lit(1)).alias("n"), F.min(start).alias("first"))
    over = Window.partitionBy(key).orderBy("_stretch")
    before = F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifted = sums.select(F.col(key).alias("_key"), F.col("_stretch").alias("_at"), before.alias("before"), F.lead("first").over(over).alias("next"))
    w = Window.partitionBy(key, "_stretch").orderBy(*order)
    inner = cut.withColumns({"_nth": F.row_number().over(w) - 1, "_lead": F.lead(start).over(w)})
    met = inner.join(shifted, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_stretch") == F.col("_at")))
    return met.select(key, (F.col("before") + F.col("_nth")).alias("idx"), (F.coalesce("_lead", "next") - F.col(end)).alias("gap"))


def even_borders(
    rows: DataFrame, key: str, order: Sequence[str], size: int, reach: int = 30, start: str = "start_ms", end: str = "end_ms", stretch_ms: int = 3_600_000,
) -> DataFrame:
    """Rows after which a document is cut into near-even parts of about ``size`` rows.

    Around each even border, the widest gap within ``reach`` rows is taken, the first on ties.
    """
    numbered = placed(rows, key, order, start, end, stretch_ms)
    parts = F.ceil(F.col("n") / size).cast("int")
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("parts", parts).where("parts > 1")
    targets = sizes.select(key, "n", "parts", F.explode(F.sequence(F.lit(1), F.col("parts") - 1)).alias("border"))
    near = targets.select(key, "border", F.explode(F.sequence(-F.lit(reach), F.lit(reach))).alias("off"), F.floor(F.col("border") * F.col("n") / F.col("parts")).alias("t"))
    met = near.select(key, "border", (F.col("t") + F.col("off")).alias("idx")).join(numbered.where("gap IS NOT NULL"), [key, "idx"])
    best = F.max(F.struct("gap", (-F.col("idx")).alias("first")))
    return met.groupBy(key, "border").agg(best.alias("b")).select(key, "border", (-F.col("b.first")).alias("idx"), F.col("b.gap").alias("gap"))


def text_windows(text: Column, most: int, count: int = 5) -> Column:
    """A text of over ``most`` characters as ``count`` evenly spaced windows, joined; others as they are."""
    width = most // count
    windows = [F.substring(text, F.floor((F.length(text) - width) * i / (count - 1)).cast("int") + 1, F.lit(width)) for i in range(count)]
    return F.when(F.length(text) > most, F.array_join(F.array_distinct(F.array(*windows)), "\n")).otherwise(text)


def dominant(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """The most frequent known label of each key, the least on ties, and one value for all or ``mixed``."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    best = F.array_min(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(label).alias("v"))))
    return counts.groupBy(*keys).agg(best.alias("b"), F.count(F.lit(1)).alias("labels"), F.min(label).alias("only")).select(
        *keys, F.col("b.v").alias("dominant"), (-F.col("b.m")).alias("support"), F.when(F.col("labels") == 1, F.col("only")).otherwise("mixed").alias("common")
    )
