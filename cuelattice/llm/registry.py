"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from cuelattice.llm import decontamination, fill_middle, language, line_rules, lm_score, packing, quality, simhash, spot_signatures, token_counts, token_store, toxicity, vector_codes

MODULES = (token_store, decontamination, lm_score, language, packing, quality, line_rules, toxicity, simhash, token_counts, spot_signatures, vector_codes, fill_middle)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
