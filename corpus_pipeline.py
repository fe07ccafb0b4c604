"""A training corpus from raw documents: five stages, each written before the next one reads it, the last in its buckets.

Toxic documents go, then those whose language cannot be told, then near-duplicates but one of each group, then
those that hold a benchmark item; what is left is packed into sequences. All stages but the last return the
columns they are given, also where these have names that the operators use.

Each row is a document of its own, whatever its id. Null and empty texts are not toxic, have no language, and so
go in the second stage; on its own, the third stage keeps one of all that have no word, the fourth keeps them, and
the last packs them as their end id. Very long texts are read whole by every stage. Of near-duplicates the
one with the least id stays, rows without an id last; of equal ids the row read first. Where no labels or no languages
can be learnt, no document is toxic unless over 0.3 of the labels are, and none has a language. An empty table gives
no rows in any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuelattice.llm import decontamination, language, near_copies, packing, toxicity
from cuelattice.llm.common import fresh_path, staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(spark, docs, sf_dir)


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.digest_columns(packing.bucketed(packed, fresh_path(spark, "pipeline-packed")))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unidentified),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Fitted models and components of a graph have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
