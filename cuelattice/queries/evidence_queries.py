"""Document evidence over ``documents`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.functions import text as tx
from cuelattice.operators import evidence as ev
from cuelattice.queries.interval_queries import TURNS_SQL, turns
from cuelattice.session import table


def periodic_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.tokens(F.col("text"))).alias("i", "w"))
    found = ev.periodic_repeats(words, "doc_id", "i", "w", (1, 2, 3, 4, 6))
    return found.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("width", "first_at", "last_at", "repeats")])


def loop_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of every width from 1 to 12: eight of one word or four of more, and twelve words at least."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.tokens(F.col("text"))).alias("i", "w"))
    found = ev.periodic_repeats(words, "doc_id", "i", "w", range(1, 13))
    long = (F.col("repeats") >= F.when(F.col("width") == 1, 8).otherwise(4)) & (F.col("repeats") * F.col("width") >= 12)
    return found.where(long).select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("width", "first_at", "last_at", "repeats")])


def even_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.even_borders(turns(spark, sf_dir), "event_type", ["start_ms", "event_id"], 100)
    return found.select("event_type", F.col("border").cast("long").alias("border"), F.col("idx").cast("long").alias("idx"), "gap")


def compact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ev.text_windows(F.col("text"), 3000)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(c).cast("long").alias("n_chars"), F.md5(c).alias("digest"))


def dominant_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.dominant(turns(spark, sf_dir), ["user_id"], "event_type")


QUERIES = {f.__name__: f for f in (periodic_repeats, loop_candidates, even_borders, compact_text, dominant_label)}
_T = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_WIN = ", ".join(f"substr(text, CAST(floor((length(text) - 600) * {i} / 4) AS BIGINT) + 1, 600)" for i in range(5))
ORACLES = {
    "periodic_repeats": f"""WITH w AS (SELECT doc_id, unnest({_T}) AS w, generate_subscripts({_T}, 1) - 1 AS i FROM documents),
h AS ({' UNION ALL '.join(f"SELECT doc_id, i, {k} AS width FROM (SELECT *, lag(w, {k}) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w) WHERE p = w" for k in (1, 2, 3, 4, 6))}),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, width ORDER BY i) AS k FROM h),
r AS (SELECT doc_id, width, min(i) AS a, max(i) AS b FROM g GROUP BY doc_id, width, k)
SELECT doc_id, CAST(width AS BIGINT) AS width, a - width AS first_at, b AS last_at, (b - a + 1) // width + 1 AS repeats FROM r WHERE (b - a + 1) // width + 1 >= 4""",
    "loop_candidates": f"""WITH w AS (SELECT doc_id, unnest({_T}) AS w, generate_subscripts({_T}, 1) - 1 AS i FROM documents),
h AS ({' UNION ALL '.join(f"SELECT doc_id, i, {k} AS width FROM (SELECT *, lag(w, {k}) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w) WHERE p = w" for k in range(1, 13))}),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, width ORDER BY i) AS k FROM h),
r AS (SELECT doc_id, width, min(i) AS a, max(i) AS b, (max(i) - min(i) + 1) // width + 1 AS n FROM g GROUP BY doc_id, width, k)
SELECT doc_id, CAST(width AS BIGINT) AS width, a - width AS first_at, b AS last_at, n AS repeats FROM r WHERE n >= CASE WHEN width = 1 THEN 8 ELSE 4 END AND n * width >= 12""",
    "even_borders": f"""WITH {TURNS_SQL}, p AS (SELECT event_type, row_number() OVER w - 1 AS idx, lead(start_ms) OVER w - end_ms AS gap FROM turns WINDOW w AS (PARTITION BY event_type ORDER BY start_ms, event_id)),
n AS (SELECT event_type, count(*) AS n, (count(*) + 99) // 100 AS parts FROM turns GROUP BY 1), t AS (SELECT *, unnest(range(1, parts)) AS border FROM n WHERE parts > 1)
SELECT t.event_type, border, idx, gap FROM t JOIN p ON t.event_type = p.event_type AND idx BETWEEN border * n // parts - 30 AND border * n // parts + 30 WHERE gap IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY t.event_type, border ORDER BY gap DESC, idx) = 1""",
    "compact_text": f"""WITH c AS (SELECT doc_id, CASE WHEN length(text) > 3000 THEN array_to_string(list_distinct_in_order, chr(10)) ELSE text END AS c
  FROM (SELECT doc_id, text, list_filter([{_WIN}], lambda x, i: list_position([{_WIN}], x) = i) AS list_distinct_in_order FROM documents))
SELECT doc_id, CAST(length(c) AS BIGINT) AS n_chars, md5(c) AS digest FROM c""",
    "dominant_label": f"""WITH {TURNS_SQL}, c AS (SELECT user_id, event_type, count(*) AS n FROM turns WHERE event_type IS NOT NULL GROUP BY ALL)
SELECT user_id, arg_min(event_type, {{'m': -n, 'v': event_type}}) AS dominant, max(n) AS support, CASE WHEN count(*) = 1 THEN min(event_type) ELSE 'mixed' END AS common FROM c GROUP BY user_id""",
}
