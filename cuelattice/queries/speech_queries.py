"""Speech and timing queries over ``events`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.operators import speech as sp
from cuelattice.queries.fold_queries import cues
from cuelattice.queries.interval_queries import SIDES_SQL, TURNS_SQL, sides, turns
from cuelattice.session import table


def speech_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours as frames: those in which a type of event is seen are speech."""
    frame = 3_600_000
    frames = turns(spark, sf_dir).select("event_type", (F.floor(F.col("start_ms") / frame) * frame).alias("at")).distinct().withColumn("on", F.lit(True))
    return sp.speech_ranges(frames, ["event_type"], "at", "on", frame, 2 * frame, 2 * frame, frame)


def filled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third event has lost its type."""
    t = turns(spark, sf_dir).withColumn("event_type", F.when(F.col("event_id") % 3 != 0, F.col("event_type")))
    return sp.filled_labels(t, ["user_id"], ["start_ms", "event_id"], "event_type", 200_000_000).select("event_id", "filled")


def capped_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = F.when(F.col("event_type") == "click", 9000).otherwise(20000)
    return sp.capped_durations(turns(spark, sf_dir), most).select("event_id", "capped_end_ms")


def trim_to_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = sides(spark, sf_dir)
    return sp.trimmed_to_speech(c.select("user_id", "event_id", "start_ms", "end_ms"), s.select("user_id", "start_ms", "end_ms"), ["user_id"], "event_id")


def speech_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = sides(spark, sf_dir)
    return sp.speech_share(c, s.select("user_id", "start_ms", "end_ms"), ["user_id"], "event_id")


def audio_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * 10).cast("long").alias("ms")).where("ms > 0")
    return sp.audio_windows(media, "o_orderkey", "ms")


def newest_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.newest(table(spark, sf_dir, "orders"), ["o_orderstatus"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 50).select("o_orderstatus", "o_orderkey")


def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.review_flags(cues(spark, sf_dir), ["doc_id"], ["idx"]).select("doc_id", "idx", "bad_time", "fast", "close", "long")


QUERIES = {f.__name__: f for f in (speech_ranges, filled_labels, capped_durations, trim_to_speech, speech_share, audio_windows, newest_tasks, review_flags)}
ORACLES = {
    "speech_ranges": f"""WITH {TURNS_SQL}, f AS (SELECT DISTINCT event_type, start_ms // 3600000 AS h FROM turns),
g AS (SELECT *, h - row_number() OVER (PARTITION BY event_type ORDER BY h) AS k FROM f),
r AS (SELECT event_type, min(h) AS a, max(h) + 1 AS b FROM g GROUP BY event_type, k HAVING max(h) + 1 - min(h) >= 2),
m AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY event_type ORDER BY a) < 2 THEN 0 ELSE 1 END AS nw FROM r),
n AS (SELECT *, sum(nw) OVER (PARTITION BY event_type ORDER BY a ROWS UNBOUNDED PRECEDING) AS i FROM m),
j AS (SELECT event_type, min(a) * 3600000 AS s, max(b) * 3600000 AS e FROM n GROUP BY event_type, i),
p AS (SELECT *, (s - lag(e) OVER w) // 2 AS bf, (lead(s) OVER w - e) // 2 AS af FROM j WINDOW w AS (PARTITION BY event_type ORDER BY s))
SELECT event_type, CAST(s - least(3600000, coalesce(bf, 3600000), s) AS BIGINT) AS start_ms, CAST(e + least(3600000, coalesce(af, 3600000)) AS BIGINT) AS end_ms FROM p""",
    "filled_labels": f"""WITH {TURNS_SQL}, t AS (SELECT event_id, user_id, start_ms, end_ms, CASE WHEN event_id % 3 <> 0 THEN event_type END AS l FROM turns),
x AS (SELECT *, last_value(CASE WHEN l IS NOT NULL THEN {{'l': l, 's': start_ms, 'e': end_ms}} END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  first_value(CASE WHEN l IS NOT NULL THEN {{'l': l, 's': start_ms, 'e': end_ms}} END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM t WINDOW w AS (PARTITION BY user_id ORDER BY start_ms, event_id))
SELECT event_id, coalesce(l, CASE WHEN b.l = a.l AND start_ms - b.e <= 200000000 AND a.s - end_ms <= 200000000 THEN b.l END) AS filled FROM x""",
    "capped_durations": f"""WITH {TURNS_SQL}, m AS (SELECT *, CASE WHEN event_type = 'click' THEN 9000 ELSE 20000 END AS most FROM turns)
SELECT event_id, CAST(CASE WHEN end_ms - start_ms - most >= 250 THEN start_ms + most ELSE end_ms END AS BIGINT) AS capped_end_ms FROM m""",
    "trim_to_speech": f"""WITH {SIDES_SQL}, s AS (SELECT user_id, event_id, min(rs) AS f, max(re) AS z FROM p GROUP BY ALL)
SELECT l.user_id, l.event_id, CASE WHEN f - start_ms >= 300 THEN f - 80 ELSE start_ms END AS start_ms, CASE WHEN end_ms - z >= 300 THEN z + 80 ELSE end_ms END AS end_ms FROM l LEFT JOIN s USING (user_id, event_id)""",
    "speech_share": f"""WITH {SIDES_SQL}, c AS (SELECT user_id, event_id, end_ms - start_ms AS n, greatest(start_ms, rs) AS s, least(end_ms, re) AS e FROM p),
m AS (SELECT *, max(e) OVER (PARTITION BY event_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
u AS (SELECT user_id, event_id, n, greatest(0, e - greatest(s, coalesce(reach, s))) AS d FROM m)
SELECT user_id, event_id, CAST(sum(d) AS BIGINT) AS speech_ms, round(sum(d) / n, 6) AS share FROM u GROUP BY user_id, event_id, n""",
    "audio_windows": """WITH m AS (SELECT o_orderkey, CAST(floor(o_totalprice * 10) AS BIGINT) AS ms FROM orders WHERE floor(o_totalprice * 10) > 0),
x AS (SELECT *, unnest(range(0, greatest(0, CAST(ceil((ms - 600000) / 590000) AS BIGINT)) + 1)) AS chunk FROM m)
SELECT o_orderkey, chunk, chunk * 590000 AS start_ms, least(chunk * 590000 + 600000, ms) AS end_ms FROM x""",
    "newest_tasks": "SELECT o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) <= 50",
    "review_flags": """WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, turn AS idx, turn * 3000 AS s, turn * 3000 + length(text) * 40 AS e, text FROM conversations),
x AS (SELECT *, lead(s) OVER (PARTITION BY doc_id ORDER BY s, idx) - e AS gap FROM c)
SELECT doc_id, CAST(idx AS BIGINT) AS idx, e - s <= 0 OR coalesce(gap < 0, false) AS bad_time, e > s AND length(text) * 1000 > 20 * (e - s) AS fast, coalesce(gap BETWEEN 0 AND 80, false) AS close, e - s > 7500 AS long FROM x""",
}
