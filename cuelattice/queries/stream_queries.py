"""Streams over the supplied tables, run until they have read all there is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.session import table
from cuelattice.streaming import tasks


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tasks.drained(tasks.windowed(tasks.event_stream(spark, sf_dir)))
    return found.select((F.unix_micros("window.start") / 1_000_000).cast("long").alias("window_s"), "event_type", "n", "total")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tasks.drained(tasks.sessions(tasks.event_stream(spark, sf_dir)))
    return found.select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")


def preview_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of each conversation as one snapshot, most of it as the next."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("task_id"), F.col("turn").alias("position"), "text")
    after = c.where("position <> 1 OR cast(task_id AS long) % 3 <> 0").withColumn("text", F.when(F.col("task_id").cast("long") % 2 == 0, F.upper("text")).otherwise(F.col("text")))
    return tasks.preview_delta(c.where("position < 3"), after).drop("rows")


QUERIES = {f.__name__: f for f in (stream_windows, stream_sessions, preview_delta)}
ORACLES = {
    "stream_windows": """SELECT CAST(epoch_us(ts) // 3600000000 * 3600 AS BIGINT) AS window_s, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""",
    "stream_sessions": """WITH x AS (SELECT user_id, epoch_us(ts) AS t FROM events),
m AS (SELECT *, CASE WHEN t - lag(t) OVER w < 1800000000 THEN 0 ELSE 1 END AS nw FROM x WINDOW w AS (PARTITION BY user_id ORDER BY t)),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(t) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""",
    "preview_delta": """WITH b AS (SELECT CAST(conv_id AS VARCHAR) AS task_id, turn, text FROM conversations WHERE turn < 3),
a AS (SELECT CAST(conv_id AS VARCHAR) AS task_id, turn, CASE WHEN conv_id % 2 = 0 THEN upper(text) ELSE text END AS text FROM conversations WHERE turn <> 1 OR conv_id % 3 <> 0),
j AS (SELECT coalesce(b.task_id, a.task_id) AS task_id, b.text AS o, a.text AS n FROM b FULL OUTER JOIN a ON b.task_id = a.task_id AND b.turn = a.turn),
c AS (SELECT task_id, count(*) FILTER (o IS NULL) AS added, count(*) FILTER (n IS NULL) AS lost, count(*) FILTER (o <> n) AS changed FROM j GROUP BY 1)
SELECT task_id, CASE WHEN lost > 0 THEN 'replace' WHEN changed > 0 THEN 'patch' WHEN added > 0 THEN 'append' ELSE 'none' END AS kind, added, lost, changed FROM c""",
}
