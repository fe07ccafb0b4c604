"""Times of cues and words moved to where speech begins and ends, by as-of joins.

Both sides of an as-of join are put into one order of time, dealt out by key and stretch of time, so that a busy key is
many small windows. A row without a match in its own stretch takes the last one of the stretches before it, which are
one row a stretch. Nothing is compared pair by pair.

Where ``parts`` is given, what is sorted is dealt into as many partitions, which adaptive execution doesn't merge: a task's
memory grows with its rows, so callers let ``parts`` grow with the input.

Times are milliseconds; rows without a time or a key are left as they are. Speech is a table of intervals that don't
overlap (``intervals.islands`` makes them) and are further apart than ``pad_ms``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dealt_by(df: DataFrame, parts: int | None, *by: str) -> DataFrame:
    """``df`` by hash of ``by`` in ``parts`` partitions, or as it is where None."""
    return df.repartition(parts, *by) if parts else df


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: Column, right_at: Column, value: str, forward: bool = False, order: Sequence[str] = (), width_ms: int = 600_000, parts: int | None = None) -> DataFrame:
    """``left`` with ``value``: the right row (a struct) with the latest ``right_at`` at or before ``at``, or, ``forward``, the earliest at or after.

    Of right rows at the same time the last by ``order`` counts, ``forward`` the first; null where there is none.
    """
    sign = -1 if forward else 1
    found = right.where(right_at.isNotNull()).select(*keys, (right_at * sign).alias("_at"), F.struct(*right.columns).alias("_found"), F.array(*[F.col(c).cast("long") * sign for c in order]).alias("_order") if order else F.array().cast("array<bigint>").alias("_order"))
    asked = left.select(*keys, (at * sign).alias("_at"), F.struct(*left.columns).alias("_row"))
    both = found.withColumn("_side", F.lit(0)).unionByName(asked.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    dealt = dealt_by(both.withColumn("_stretch", F.floor(F.col("_at") / width_ms)), parts, *keys, "_stretch")
    within = Window.partitionBy(*keys, "_stretch").orderBy("_at", "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumn("_own", F.last("_found", ignorenulls=True).over(within))
    ends = dealt.groupBy(*keys, "_stretch").agg(F.max(F.when(F.col("_side") == 0, F.struct("_at", "_order", "_found"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_stretch", F.last("_end", ignorenulls=True).over(before)["_found"].alias("_carried"))
    met = own.where("_side = 1").join(carried, [*keys, "_stretch"], "left")
    known = F.forall(F.array(F.col("_at").isNotNull(), *[F.col(k).isNotNull() for k in keys]), lambda x: x)
    unmatched = asked.where(~known).select("_row.*", F.lit(None).cast(found.schema["_found"].dataType).alias(value))
    matched = met.where(known).select("_row.*", F.coalesce("_own", "_carried").alias(value))
    return matched.unionByName(unmatched)


def extended_tails(
    cues: DataFrame, speech: DataFrame, keys: Sequence[str], media_ms: Column | None = None, least_gap_ms: int = 220, safety_ms: int = 80, tail_ms: int = 160,
    least_ms: int = 60, most_ms: int = 3200, most_crossing_ms: int = 1200, pad_ms: int = 30, parts: int | None = None,
) -> DataFrame:
    """``cues`` (keys, idx, start_ms, end_ms, word_end_ms) with later ends where speech goes on after their last word.

    A cue keeps its end if the next one follows within ``least_gap_ms`` or it has no words. Others end ``tail_ms`` after
    their last word, or with the first speech that is at hand there (begun 80 ms after the word at the latest, ended 120
    ms before it at the earliest) if it ends within ``most_ms``; never closer to the next cue than ``safety_ms``, nor
    after the media, and only if that adds ``least_ms``. Speech that runs into the next cue counts up to ``most_crossing_ms``.
    """
    w = Window.partitionBy(*keys).orderBy("start_ms", "end_ms", "idx")
    ahead = dealt_by(cues, parts, *keys).withColumn("_next", F.lead("start_ms").over(w))
    met = as_of(ahead, speech.select(*keys, "start_ms", "end_ms"), keys, F.col("word_end_ms") - 120, F.col("end_ms"), "_speech", forward=True, order=["start_ms"], parts=parts)
    end, word, has_next = F.col("end_ms"), F.col("word_end_ms"), F.col("_next").isNotNull()
    s_end = F.when(F.col("_speech.start_ms") <= word + 80, F.col("_speech.end_ms"))
    more = s_end - word
    media = media_ms if media_ms is not None else F.lit(None).cast("long")
    open_end = ~has_next & media.isNull() & (more > 0) & (more <= most_ms)
    most = F.when(has_next, F.col("_next") - safety_ms).when(open_end, s_end + pad_ms).otherwise(F.coalesce(media, end))
    wanted = F.when((s_end > most) & has_next, F.least(most, word + most_crossing_ms)).when(s_end <= most, s_end + pad_ms)
    heard = F.when((more > tail_ms) & (more <= most_ms) & (wanted > word + tail_ms), F.least(wanted, most))
    target = F.least(F.greatest(end, word + tail_ms, heard), most)
    stays = word.isNull() | (has_next & ((F.col("_next") - end < least_gap_ms) | (most <= end))) | (target - end < least_ms)
    return met.withColumn("end_ms", F.when(F.coalesce(stays, F.lit(True)), end).otherwise(target)).drop("_next", "_speech")


def refined_edges(words: DataFrame, speech: DataFrame, keys: Sequence[str], most_ms: int = 700, pad_ms: int = 30, least_ms: int = 80, parts: int | None = None) -> DataFrame:
    """``words`` (keys, idx, start_ms, end_ms) whose first and last within each speech interval are moved to its ends.

    Words are in order of start and end. A start that lags the speech's by ``least_ms`` to ``most_ms`` moves to
    ``pad_ms`` before it, but not nearer than that to the word before; an end that leads the speech's by as much moves
    to ``pad_ms`` after it, if the next word starts ``least_ms`` after the speech or later.
    """
    w = Window.partitionBy(*keys).orderBy("start_ms", "end_ms", "idx")
    placed = dealt_by(words, parts, *keys).withColumns({"_n": F.row_number().over(w), "_before": F.lag("idx").over(w), "_before_end": F.lag("end_ms").over(w), "_next": F.lead("start_ms").over(w)})
    slim = placed.select(*keys, "idx", "start_ms", "end_ms", "_n", "_before", "_before_end", "_next")
    ranges = speech.select(*keys, F.col("start_ms").alias("_from"), F.col("end_ms").alias("_to"))
    firsts = as_of(ranges, slim, keys, F.col("_from"), F.col("end_ms"), "_first", forward=True, order=["_n"], parts=parts)
    both = as_of(firsts, slim, keys, F.col("_to"), F.col("start_ms"), "_last", order=["_n"], parts=parts).where(F.col("_last._n") >= F.col("_first._n"))
    late = F.col("_to") - F.col("_last.end_ms")
    after = F.coalesce("_last._next", F.col("_to") + most_ms)
    tail = F.least(F.col("_to") + pad_ms, after - pad_ms)
    tails = both.where(late.between(least_ms, most_ms) & (after >= F.col("_to") + least_ms) & (tail > F.col("_last.end_ms"))).groupBy(*keys, F.col("_last.idx").alias("idx")).agg(F.max(tail).alias("_tail"))
    early = F.col("_first.start_ms") - F.col("_from")
    moved = both.select(*keys, "_from", "_first", early.alias("_early")).where(F.col("_early").between(least_ms, most_ms))
    known = moved.join(tails.withColumnsRenamed({"idx": "_idx", "_tail": "_before_tail"}), [*[moved[k].eqNullSafe(tails[k]) for k in keys], F.col("_first._before") == F.col("_idx")], "left").select(*[moved[k] for k in keys], "_from", "_first", "_before_tail")
    head = F.greatest(F.coalesce("_before_tail", "_first._before_end", F.lit(0)) + pad_ms, F.col("_from") - pad_ms)
    heads = known.where(head < F.col("_first.end_ms")).groupBy(*keys, F.col("_first.idx").alias("idx")).agg(F.min(head).alias("_head"))
    out = dealt_by(words, parts, *keys, "idx").join(tails, [*keys, "idx"], "left").join(heads, [*keys, "idx"], "left")
    return out.withColumns({"start_ms": F.coalesce("_head", "start_ms"), "end_ms": F.coalesce("_tail", "end_ms")}).drop("_head", "_tail")
