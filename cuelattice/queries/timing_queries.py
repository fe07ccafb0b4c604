"""Queries of timing by speech: turns as words with pauses after sentences, and speech as those sentences with other ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelattice.functions import text as tx
from cuelattice.operators import timing as tm
from cuelattice.session import table


#: Bytes of text whose words go to one partition; a task takes about a hundred times as much memory for them.
TEXT_OF_PART = 1 << 20


def parts_for(spark: SparkSession, sf_dir: str) -> int:
    """Into how many partitions the words of all turns go."""
    size = table(spark, sf_dir, "conversations").agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    return max(spark.sparkContext.defaultParallelism, -(-size // TEXT_OF_PART))


def spoken(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    """Words of 300 ms every 400 ms; a sentence's end makes a pause of two seconds, and turns are 1000 seconds apart."""
    w = Window.partitionBy("conv_id").orderBy("turn", "i").rowsBetween(Window.unboundedPreceding, -1)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").repartition(parts, "conv_id")
    words = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.posexplode(tx.pieces(F.col("text"))).alias("i", "word"))
    told = words.withColumn("sentence", F.coalesce(F.sum(F.col("word").endswith(".").cast("long")).over(w), F.lit(0)))
    start = F.col("turn") * 1_000_000 + F.col("i") * 400 + F.col("sentence") * 2000
    return told.select("conv_id", "turn", "sentence", (F.col("turn") * 100_000 + F.col("i")).alias("idx"), start.alias("start_ms"), (start + 300).alias("end_ms"), "word")


def speech_of(words: DataFrame) -> DataFrame:
    """Each sentence from up to 900 ms before its first word to up to 990 ms after its last, by their lengths."""
    told = words.groupBy("conv_id", "turn", "sentence").agg(
        F.min("start_ms").alias("s"), F.max("end_ms").alias("e"), F.min_by(F.length("word"), "idx").alias("a"), F.max_by(F.length("word"), "idx").alias("b")
    )
    return told.select("conv_id", (F.col("s") - F.col("a") * 97 % 900).alias("start_ms"), (F.col("e") + F.col("b") * 131 % 990).alias("end_ms"))


def refined_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = parts_for(spark, sf_dir)
    words = spoken(spark, sf_dir, parts)
    return tm.refined_edges(words.select("conv_id", "idx", "start_ms", "end_ms"), speech_of(words), ["conv_id"], parts=parts)


def extended_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences as cues, every seventh without words, and every eleventh sentence's speech 3 seconds longer."""
    parts = parts_for(spark, sf_dir)
    words = spoken(spark, sf_dir, parts)
    cues = words.groupBy("conv_id", "turn", "sentence").agg(F.min("idx").alias("idx"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("turn")
    told = cues.withColumn("word_end_ms", F.when(F.col("sentence") % 7 != 6, F.col("end_ms"))).drop("sentence")
    speech = speech_of(words).withColumn("end_ms", F.col("end_ms") + F.when(F.col("end_ms") % 11 == 0, 1500).otherwise(0))
    return tm.extended_tails(told, speech, ["conv_id"], parts=parts).select("conv_id", "idx", "start_ms", "end_ms")


def last_error_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each click, the same user's last error at or before it and first one at or after it."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    clicks, errors = e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'error'").select("user_id", F.col("at").alias("at_error"), F.col("event_id").alias("error_id"))
    back = tm.as_of(clicks, errors, ["user_id"], F.col("at"), F.col("at_error"), "before", order=["error_id"], width_ms=86_400_000_000)
    both = tm.as_of(back, errors, ["user_id"], F.col("at"), F.col("at_error"), "after", forward=True, order=["error_id"], width_ms=86_400_000_000)
    return both.select("event_id", F.col("before.error_id").alias("error_before"), F.col("after.error_id").alias("error_after"))


QUERIES = {f.__name__: f for f in (refined_edges, extended_tails, last_error_before)}

_WORDS = """p AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS ws FROM conversations),
u AS (SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM p),
n AS (SELECT *, coalesce(sum(CASE WHEN suffix(word, '.') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM u),
w AS (SELECT conv_id, turn, sentence, turn * 100000 + i AS idx, CAST(turn * 1000000 + i * 400 + sentence * 2000 AS BIGINT) AS s, CAST(turn * 1000000 + i * 400 + sentence * 2000 + 300 AS BIGINT) AS e, word FROM n),
sp AS (SELECT conv_id, min(s) - arg_min(length(word), idx) * 97 % 900 AS f, max(e) + arg_max(length(word), idx) * 131 % 990 AS t FROM w GROUP BY conv_id, turn, sentence)"""
ORACLES = {
    "refined_edges": f"""
WITH {_WORDS},
o AS (SELECT *, row_number() OVER x AS k, coalesce(lag(e) OVER x, 0) AS pe, lag(idx) OVER x AS pi, lead(s) OVER x AS ns FROM w WINDOW x AS (PARTITION BY conv_id ORDER BY s, e, idx)),
m AS (SELECT sp.conv_id, f, t, min(k) FILTER (o.e >= f) AS fk, max(k) FILTER (o.s <= t) AS lk FROM sp JOIN o USING (conv_id) GROUP BY ALL),
r AS (SELECT * FROM m WHERE lk >= fk),
tl AS (SELECT o.conv_id, o.idx, max(least(t + 30, coalesce(ns, t + 700) - 30)) AS v FROM r JOIN o ON o.conv_id = r.conv_id AND o.k = lk
  WHERE t - o.e BETWEEN 80 AND 700 AND coalesce(ns, t + 700) >= t + 80 AND least(t + 30, coalesce(ns, t + 700) - 30) > o.e GROUP BY ALL),
hd AS (SELECT o.conv_id, o.idx, min(greatest(coalesce(tl.v, pe) + 30, f - 30)) AS v FROM r JOIN o ON o.conv_id = r.conv_id AND o.k = fk LEFT JOIN tl ON tl.conv_id = o.conv_id AND tl.idx = pi
  WHERE o.s - f BETWEEN 80 AND 700 AND greatest(coalesce(tl.v, pe) + 30, f - 30) < o.e GROUP BY ALL)
SELECT w.conv_id, w.idx, CAST(coalesce(hd.v, s) AS BIGINT) AS start_ms, CAST(coalesce(tl.v, e) AS BIGINT) AS end_ms FROM w
  LEFT JOIN hd ON hd.conv_id = w.conv_id AND hd.idx = w.idx LEFT JOIN tl ON tl.conv_id = w.conv_id AND tl.idx = w.idx""",
    "extended_tails": f"""
WITH {_WORDS},
g AS (SELECT conv_id, sentence, min(idx) AS idx, min(s) AS s, max(e) AS e FROM w GROUP BY conv_id, turn, sentence),
c AS (SELECT *, CASE WHEN sentence % 7 <> 6 THEN e END AS we, lead(s) OVER (PARTITION BY conv_id ORDER BY s, e, idx) AS ns FROM g),
z AS (SELECT conv_id, f, t + CASE WHEN t % 11 = 0 THEN 1500 ELSE 0 END AS t FROM sp),
h AS (SELECT c.*, x.f, CASE WHEN x.f <= we + 80 THEN x.t END AS t FROM c LEFT JOIN LATERAL (SELECT f, t FROM z WHERE z.conv_id = c.conv_id AND z.t >= c.we - 120 ORDER BY t, f LIMIT 1) x ON true),
k AS (SELECT *, CASE WHEN ns IS NOT NULL THEN ns - 80 WHEN t - we > 0 AND t - we <= 3200 THEN t + 30 ELSE e END AS most FROM h),
q AS (SELECT *, CASE WHEN t > most AND ns IS NOT NULL THEN least(most, we + 1200) WHEN t <= most THEN t + 30 END AS want FROM k),
v AS (SELECT *, least(greatest(e, we + 160, CASE WHEN t - we > 160 AND t - we <= 3200 AND want > we + 160 THEN least(want, most) END), most) AS target FROM q)
SELECT conv_id, idx, s AS start_ms, CAST(CASE WHEN we IS NULL OR (ns IS NOT NULL AND (ns - e < 220 OR most <= e)) OR target - e < 60 THEN e ELSE target END AS BIGINT) AS end_ms FROM v""",
    "last_error_before": """
WITH c AS (SELECT * FROM events WHERE event_type = 'click'), x AS (SELECT * FROM events WHERE event_type = 'error')
SELECT event_id, (SELECT event_id FROM x WHERE x.user_id = c.user_id AND x.ts <= c.ts ORDER BY x.ts DESC, x.event_id DESC LIMIT 1) AS error_before,
  (SELECT event_id FROM x WHERE x.user_id = c.user_id AND x.ts >= c.ts ORDER BY x.ts, x.event_id LIMIT 1) AS error_after FROM c""",
}
