"""Speech activity, speaker labels and timing of cues: window and join forms over (key, start_ms, end_ms) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelattice.operators import intervals as iv


def speech_ranges(frames: DataFrame, keys: Sequence[str], at: str, flag: str, frame_ms: int, least_ms: int, silence_ms: int, pad_ms: int) -> DataFrame:
    """Ranges of speech from flagged frames: runs of ``least_ms`` or more, joined over less than ``silence_ms``.

    Each range grows by ``pad_ms`` on both sides, but by no more than half the gap to its neighbour.
    """
    w = Window.partitionBy(*keys).orderBy(at)
    on = frames.where(F.col(flag)).withColumn("_new", F.when(F.col(at) - F.lag(at).over(w) <= frame_ms, 0).otherwise(1))
    on = on.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = on.groupBy(*keys, "_run").agg(F.min(at).alias("start_ms"), (F.max(at) + frame_ms).alias("end_ms")).where(F.col("end_ms") - F.col("start_ms") >= least_ms)
    joined = iv.islands(runs, keys, bridge_ms=silence_ms - 1)
    order = Window.partitionBy(*keys).orderBy("start_ms")
    before = F.floor((F.col("start_ms") - F.lag("end_ms").over(order)) / 2)
    after = F.floor((F.lead("start_ms").over(order) - F.col("end_ms")) / 2)
    pad = F.lit(pad_ms)
    return joined.select(
        *keys, (F.col("start_ms") - F.least(pad, F.coalesce(before, pad), F.col("start_ms"))).cast("long").alias("start_ms"),
        (F.col("end_ms") + F.least(pad, F.coalesce(after, pad))).cast("long").alias("end_ms"),
    )


def filled_labels(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, most_ms: int) -> DataFrame:
    """Rows without a label get that of both neighbours with one, if these agree and are ``most_ms`` away at most."""
    w = Window.partitionBy(*keys).orderBy(*order)
    known = F.when(F.col(label).isNotNull(), F.struct(F.col(label).alias("label"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e")))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    near = (F.col("start_ms") - F.col("_b.e") <= most_ms) & (F.col("_a.s") - F.col("end_ms") <= most_ms)
    sided = df.withColumns({"_b": before, "_a": after})
    agreed = F.when(F.col(label).isNull() & (F.col("_b.label") == F.col("_a.label")) & near, F.col("_b.label"))
    return sided.withColumn("filled", F.coalesce(F.col(label), agreed)).drop("_b", "_a")


def capped_durations(df: DataFrame, most_ms: Column, least_trim_ms: int = 250) -> DataFrame:
    """Ends moved forward so that no row lasts over ``most_ms``, where that trims ``least_trim_ms`` or more."""
    over = F.col("end_ms") - F.col("start_ms") - most_ms
    return df.withColumn("capped_end_ms", F.when(over >= least_trim_ms, F.col("start_ms") + most_ms).otherwise(F.col("end_ms")).cast("long"))


def trimmed_to_speech(cues: DataFrame, speech: DataFrame, keys: Sequence[str], row: str, least_ms: int = 300, pad_ms: int = 80) -> DataFrame:
    """Cues cut to the speech they overlap, with ``pad_ms`` around, at each side where ``least_ms`` or more is silent."""
    span = iv.overlap_pairs(cues, speech, keys).groupBy(*keys, row).agg(F.min("r_start_ms").alias("first_ms"), F.max("r_end_ms").alias("last_ms"))
    both = cues.join(span, [*keys, row], "left")
    start = F.when(F.col("first_ms") - F.col("start_ms") >= least_ms, F.col("first_ms") - pad_ms).otherwise(F.col("start_ms"))
    end = F.when(F.col("end_ms") - F.col("last_ms") >= least_ms, F.col("last_ms") + pad_ms).otherwise(F.col("end_ms"))
    return both.select(*keys, row, start.alias("start_ms"), end.alias("end_ms"))


def speech_share(cues: DataFrame, speech: DataFrame, keys: Sequence[str], row: str) -> DataFrame:
    """Time of each cue under speech, overlaps of the speech counted once, and its share of the cue."""
    inside = iv.overlap_pairs(cues, speech, keys).select(*keys, row, (F.col("end_ms") - F.col("start_ms")).alias("length"), F.greatest("start_ms", "r_start_ms").alias("start_ms"), F.least("end_ms", "r_end_ms").alias("end_ms"))
    return iv.union_measure(inside, [*keys, row, "length"]).select(*keys, row, F.col("active_ms").alias("speech_ms"), F.round(F.col("active_ms") / F.col("length"), 6).alias("share"))


def audio_windows(media: DataFrame, key: str, length: str, window_ms: int = 600_000, overlap_ms: int = 10_000) -> DataFrame:
    """Windows over each recording, each starting ``overlap_ms`` before the last ends; a tail within the overlap is folded in."""
    step = window_ms - overlap_ms
    last = F.greatest(F.lit(0), F.ceil((F.col(length) - window_ms) / step)).cast("int")
    rows = media.select(key, F.col(length).alias("_n"), F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    start = (F.col("chunk") * step).cast("long")
    return rows.select(key, F.col("chunk").cast("long").alias("chunk"), start.alias("start_ms"), F.least(start + window_ms, F.col("_n")).cast("long").alias("end_ms"))


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: int) -> DataFrame:
    """The first ``keep`` rows of each key in ``order``."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_nth") <= keep).drop("_nth")


def review_flags(cues: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Flags a reviewer looks at: bad times, fast reading, near followers, long cues.

    Fixed values: 20 characters a second, followers within 80 ms, cues over 7.5 s.
    """
    after = F.lead("start_ms").over(Window.partitionBy(*keys).orderBy("start_ms", *order))
    length, gap = F.col("end_ms") - F.col("start_ms"), after - F.col("end_ms")
    return cues.withColumns({
        "bad_time": (length <= 0) | F.coalesce(gap < 0, F.lit(False)), "fast": (length > 0) & (F.length("text") * 1000 > 20 * length),
        "close": F.coalesce((gap >= 0) & (gap <= 80), F.lit(False)), "long": length > 7500,
    })
