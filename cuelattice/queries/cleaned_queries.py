"""Turns as cues, against spoken words that hold hesitations and doubled words, and here and there others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.functions import text as tx
from cuelattice.operators import cleaned as cl
from cuelattice.session import table


def heard_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, text, words, speaker): words of 300 ms every 400 ms; every third turn has a few that aren't shown as spoken."""
    careless = F.col("turn") % 3 == 2
    heard = lambda w, i: (
        F.when(careless & (i % 29 == 20), F.array(F.lit("other"))).when(careless & (i % 31 == 25), F.array(w, F.lit("other")))
        .when(i % 7 == 3, F.array(F.lit("um"), w)).when(i % 11 == 5, F.array(w, w)).when(i % 13 == 8, F.array(F.lit("you"), F.lit("know,"), w)).otherwise(F.array(w))
    )
    said = F.flatten(F.transform(tx.pieces(F.col("text")), heard))
    word = lambda w, i: F.struct(w.alias("text"), (i * 400).cast("long").alias("start_ms"), (i * 400 + 300).cast("long").alias("end_ms"), F.col("role").alias("speaker"), F.lit("aligned").alias("timing"))
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "text", F.transform(said, word).alias("words"), F.col("role").alias("speaker"))


def mapped_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",").alias(c)
    return cl.mapped_words(heard_turns(spark, sf_dir), ["conv_id", "turn"]).select("conv_id", "turn", "error", joined("kept"), joined("deleted"))


QUERIES = {"mapped_words": mapped_words}
ORACLES: dict[str, str] = {}
