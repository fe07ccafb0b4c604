"""The registered queries: each module has QUERIES (name to callable) and ORACLES (name to DuckDB SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuelattice.queries import boundary_queries, cleaned_queries, corpus_queries, cue_queries, edit_queries, evidence_queries, fold_queries, interval_queries, name_queries, number_queries, repair_queries, source_queries, speech_queries, stream_queries, text_queries, timing_queries

MODULES = (interval_queries, text_queries, corpus_queries, fold_queries, stream_queries, speech_queries, evidence_queries, cue_queries, source_queries, edit_queries, timing_queries, boundary_queries, number_queries, cleaned_queries, name_queries, repair_queries)

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
