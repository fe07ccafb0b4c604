"""Queries of the ordered passes; conversations are documents, their turns cues.

Passes whose state is one cue have recursive SQL; tests hold the others against plain searches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelattice.operators import folds as fd
from cuelattice.queries.interval_queries import turns
from cuelattice.session import table


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as cues three seconds apart that last 40 ms a character."""
    start = F.col("turn").cast("long") * 3000
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("long").alias("idx"), start.alias("start_ms"), (start + F.length("text") * 40).alias("end_ms"), "text"
    )


def fix_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.per_document(cues(spark, sf_dir), fd.monotone)


def dedup_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.per_document(cues(spark, sf_dir), fd.without_echoes)


def merge_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.per_document(cues(spark, sf_dir), fd.joined_fragments)


def merge_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.per_document(cues(spark, sf_dir), fd.joined_short)


def rule_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.per_document(cues(spark, sf_dir), fd.grouped_words)


def boundary_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.per_document(cues(spark, sf_dir), fd.best_breaks)


def chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as two chunks that share their middle turns."""
    c = cues(spark, sf_dir).withColumn("end_ms", F.col("start_ms") + 2500)
    placed = c.withColumn("place", F.col("idx") / F.max("idx").over(Window.partitionBy("doc_id")))
    first, second = F.array(F.lit(0)), F.array(F.lit(1))
    chunks = F.when(F.col("place") < 0.3, first).when(F.col("place") > 0.7, second).otherwise(F.concat(first, second))
    return fd.chained(placed.withColumn("chunk", F.explode(chunks)).drop("place"), 60_000)


def source_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike each turn and the one before it are."""
    before = F.lag("text").over(Window.partitionBy("doc_id").orderBy("idx"))
    c = cues(spark, sf_dir).withColumn("before", before).where("before IS NOT NULL")
    return c.select("doc_id", "idx", fd.similarity(F.col("before"), F.col("text")).alias("ratio"))


def speaker_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as speakers, against those of the event before."""
    w = Window.partitionBy("user_id").orderBy("start_ms", "event_id")
    t = turns(spark, sf_dir).withColumn("predicted", F.lag("event_type").over(w)).where("predicted IS NOT NULL")
    return fd.label_error(t.select("user_id", F.col("event_type").alias("truth"), "predicted"), ["user_id"])


def boundary_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).select(F.col("user_id").alias("key"), F.when(F.col("event_id") % 2 == 0, "reference").otherwise("found").alias("side"), F.col("start_ms").alias("at_ms"))
    return fd.boundary_f1(t, 3_600_000)


QUERIES = {
    f.__name__: f
    for f in (fix_overlaps, dedup_adjacent, merge_fragments, merge_short, rule_split, boundary_dp, chunk_merge, source_similarity, speaker_error, boundary_f1)
}

_C = """c AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, turn * 3000 AS s, turn * 3000 + length(text) * 40 AS e, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn * 3000, turn * 3000 + length(text) * 40, turn) - 1 AS i FROM conversations)"""
_N = "len(list_filter(string_split_regex({}, '\\s+'), lambda x: x <> ''))"
_END = """regexp_matches({}, '[.!?。！？][''"”’)\\]]*$')"""


def _merging(rows: str, start: str, condition: str) -> str:
    """SQL of a pass that joins a cue (c) to the one before (r) on a condition."""
    return f"""WITH RECURSIVE {rows}, r AS (SELECT doc_id, i, 0 AS g, s, e, text{start.format(x='')} FROM c WHERE i = 0
UNION ALL SELECT c.doc_id, c.i, CASE WHEN {condition} THEN g ELSE g + 1 END, CASE WHEN {condition} THEN r.s ELSE c.s END, CASE WHEN {condition} THEN greatest(r.e, c.e) ELSE c.e END,
  CASE WHEN {condition} THEN trim(r.text || ' ' || c.text) ELSE c.text END{start.format(x='c.')} FROM r JOIN c ON c.doc_id = r.doc_id AND c.i = r.i + 1)
SELECT doc_id, CAST(g AS BIGINT) AS idx, CAST(s AS BIGINT) AS start_ms, CAST(e AS BIGINT) AS end_ms, text FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, g ORDER BY i DESC) = 1"""


_GAP, _A, _B = "(c.s - r.e)", _N.format("r.text"), _N.format("c.text")
_FIRST = "list_filter(string_split_regex(c.text, '\\s+'), lambda x: x <> '')[1]"
_ON = ", ".join(f"'{w}'" for w in sorted(fd.CONTINUES))
_WORDS = f"""{_C.replace('c AS', 'q AS', 1)},
p AS (SELECT doc_id, i, s, e, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM q),
u AS (SELECT doc_id, i, s, e, unnest(ws) AS w, generate_subscripts(ws, 1) AS j, list_sum(list_transform(ws, lambda x: (length(x) + 3) // 4)) AS total FROM p),
m AS (SELECT *, CAST(floor((e - s) / total * ((length(w) + 3) // 4)) AS BIGINT) AS ms FROM u),
t AS (SELECT *, s + sum(ms) OVER (PARTITION BY doc_id, i ORDER BY j) AS upto FROM m),
c AS (SELECT doc_id, least(upto - ms, e) AS s, least(upto, e) AS e, w AS text, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS i FROM t)"""
ORACLES = {
    "fix_overlaps": f"""WITH RECURSIVE {_C}, r AS (SELECT doc_id, i, s, greatest(s, e) AS e, CAST(NULL AS BIGINT) AS pe, text FROM c WHERE i = 0
UNION ALL SELECT doc_id, i, CASE WHEN laps THEN greatest(s, cut) ELSE s END, CASE WHEN laps THEN greatest(e, greatest(s, cut)) ELSE e END, CASE WHEN laps THEN least(re, cut) ELSE re END, text FROM (
  SELECT c.doc_id, c.i, c.s, greatest(c.s, c.e) AS e, r.e AS re, c.text, r.e > c.s AS laps,
    CASE WHEN r.s + 1 <= greatest(c.s, c.e) - 1 THEN least(greatest(r.s + 1, (r.e + c.s) // 2), greatest(c.s, c.e) - 1) ELSE greatest(r.s, least(c.s, greatest(c.s, c.e))) END AS cut
  FROM r JOIN c ON c.doc_id = r.doc_id AND c.i = r.i + 1))
SELECT doc_id, i AS idx, CAST(s AS BIGINT) AS start_ms, CAST(coalesce(lead(pe) OVER (PARTITION BY doc_id ORDER BY i), e) AS BIGINT) AS end_ms, text FROM r""",
    "merge_short": _merging(_C, "", f"(({_GAP} < 200 AND least({_A}, {_B}) < 5) OR ({_GAP} < 500 AND least({_A}, {_B}) < 3)) AND {_A} + {_B} <= 18 AND NOT {_END.format('r.text')}"),
    "merge_fragments": _merging(
        _C, "", f"""coalesce(trim(lower({_FIRST}), ',.') IN ({_ON}) OR (lower({_FIRST}[1]) = {_FIRST}[1] AND upper({_FIRST}[1]) <> {_FIRST}[1]), false) AND NOT {_END.format('r.text')}
      AND {_GAP} <= 500 AND greatest(r.e, c.e) - r.s <= 8000 AND {_A} + {_B} <= 22""",
    ),
    "rule_split": _merging(_WORDS, ", {x}text AS last", f"NOT {_END.format('r.last')} AND {_A} < 16 AND c.e - r.s <= 6500"),
}
