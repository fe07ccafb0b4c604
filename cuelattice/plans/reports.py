"""Whole jobs put together from the operators: reports on folders of subtitle files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.functions import text as tx
from cuelattice.operators.speech import review_flags
from cuelattice.sources.subtitles import read_cues

FLAGS = ("bad_time", "fast", "close", "long", "missing", "note", "leak")


def flagged(cues: DataFrame) -> DataFrame:
    """Cues with all that a reviewer would look at."""
    target = F.coalesce("translated", F.lit(""))
    return review_flags(cues, ["doc_id"], ["idx"]).withColumns({
        "missing": target == "", "note": (target != "") & tx.is_note(target), "leak": tx.has_leak(target), "units": tx.reading_units(F.col("text")),
    })


def document_report(cues: DataFrame) -> DataFrame:
    """One row a document: cues, span, reading units, and how many cues have each flag."""
    return flagged(cues).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("cues"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"), F.sum("units").alias("units"),
        F.count_distinct("speaker").alias("speakers"), *[F.count_if(F.col(f)).alias(f) for f in FLAGS],
    )


def folder_report(spark: SparkSession, path: str) -> DataFrame:
    """``document_report`` of every subtitle file under ``path``."""
    return document_report(read_cues(spark, path))
