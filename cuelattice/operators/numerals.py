"""Numbers that a text keeps or loses when it is rewritten, and times of chunks carried onto one timeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelattice.functions import numbers as nb


def changed_numbers(rows: DataFrame, keys: Sequence[str], source: str, target: str) -> DataFrame:
    """(keys, number, in_source, in_target): numbers that a source has more or less often than its target.

    Spellings of one number count as the same (``numbers``). Null texts have no numbers, and rows of equal keys are
    taken together. Numbers are counted before the shuffle, so what moves is a row a distinct number of a key and task.
    """
    side = lambda c, at: F.transform(F.coalesce(nb.numbers(F.col(c)), F.array().cast("array<string>")), lambda n: F.struct(n.alias("number"), F.lit(at).alias("side")))
    each = rows.select(*keys, F.explode(F.concat(side(source, 0), side(target, 1))).alias("_n")).select(*keys, "_n.*")
    counts = each.groupBy(*keys, "number").agg(F.count_if(F.col("side") == 0).alias("in_source"), F.count_if(F.col("side") == 1).alias("in_target"))
    return counts.where("in_source <> in_target")


def chunk_offsets(cues: DataFrame, keys: Sequence[str], overlap_ms: int, chunk: str = "chunk", order: Sequence[str] = ("idx",), end: str = "end_ms") -> DataFrame:
    """(keys, chunk, offset_ms): where each chunk starts, if each overlaps the one before by ``overlap_ms``.

    A chunk starts ``overlap_ms`` before the end of the last cue of the one before, and never before that one's start.
    Cues' times are those within their chunk. A chunk without cues moves nothing and gets no row; the last cue's null end counts as 0.
    Cues are reduced to a row a chunk before these are put in order.
    """
    last = cues.groupBy(*keys, chunk).agg(F.max(F.struct(*order, F.col(end).alias("_end"))).getField("_end").alias("_end"))
    w = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    step = F.greatest(F.coalesce(F.col("_end"), F.lit(0)) - overlap_ms, F.lit(0))
    return last.select(*keys, chunk, F.coalesce(F.sum(step).over(w), F.lit(0)).cast("long").alias("offset_ms"))


def on_one_timeline(cues: DataFrame, keys: Sequence[str], overlap_ms: int, chunk: str = "chunk", order: Sequence[str] = ("idx",), start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """``cues`` with start and end moved by the offset of their chunk."""
    offsets = chunk_offsets(cues, keys, overlap_ms, chunk, order, end)
    named = offsets.select(*[F.col(k).alias(f"_at_{i}") for i, k in enumerate((*keys, chunk))], F.col("offset_ms").alias("_offset"))
    same = [F.col(k).eqNullSafe(F.col(f"_at_{i}")) for i, k in enumerate((*keys, chunk))]
    return cues.join(named, same).withColumns({start: F.col(start) + F.col("_offset"), end: F.col(end) + F.col("_offset")}).select(*cues.columns)
