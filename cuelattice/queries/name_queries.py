"""Turns whose words are partly acronyms and partly such acronyms misheard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.functions import text as tx
from cuelattice.operators import names as nm
from cuelattice.session import table


def named_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, text): every fifth word in capitals, every seventh without its second letter and with a capital."""
    heard = lambda w, i: F.when(i % 5 == 0, F.upper(w)).when(i % 7 == 3, F.initcap(F.concat(F.substring(w, 1, 1), F.substring(w, 3, 20)))).otherwise(w)
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), F.array_join(F.transform(tx.pieces(F.col("text")), heard), " ").alias("text"))


def misheard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nm.misheard_names(named_turns(spark, sf_dir), ["conv_id"], "turn", "text")


QUERIES = {"misheard_names": misheard_names}
ORACLES: dict[str, str] = {}
