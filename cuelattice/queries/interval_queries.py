"""Interval and run queries over ``events``: the user is the recording, [ts, ts + value seconds] the interval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.operators import intervals as iv
from cuelattice.operators import runs as rn
from cuelattice.session import table

TURNS_SQL = """turns AS (
  SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS start_ms,
         epoch_us(ts) // 1000 + CAST(floor(value * 1000) AS BIGINT) AS end_ms
  FROM events WHERE value > 0)"""
ISLANDS_SQL = """m AS (
  SELECT *, max(end_ms) OVER (PARTITION BY user_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM turns WHERE end_ms > start_ms),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM m),
i AS (SELECT user_id, island, min(start_ms) AS s, max(end_ms) AS e FROM n GROUP BY ALL)"""
RUNS_SQL = """r0 AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND lag(1) OVER w IS NOT NULL THEN 0 ELSE 1 END AS nw
    FROM turns WINDOW w AS (PARTITION BY user_id ORDER BY start_ms, event_id)),
r1 AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY start_ms, event_id ROWS UNBOUNDED PRECEDING) AS run FROM r0),
runs AS (SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS members FROM r1 GROUP BY user_id, run)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timed turns."""
    start = iv.epoch_ms(F.col("ts"))
    return table(spark, sf_dir, "events").where("value > 0").select(
        "event_id", "user_id", "event_type", "value", start.alias("start_ms"),
        (start + F.floor(F.col("value") * 1000).cast("long")).alias("end_ms"),
    )


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Even events as cues, odd ones as speaker turns, both a minute longer."""
    t = turns(spark, sf_dir).withColumn("end_ms", F.col("end_ms") + 60000)
    return t.where("event_id % 2 = 0"), t.where("event_id % 2 = 1").select("user_id", "start_ms", "end_ms", F.col("event_id").alias("turn_id"), F.col("event_type").alias("speaker"))


SIDES_SQL = f"""{TURNS_SQL}, l AS (SELECT user_id, event_id, start_ms, end_ms + 60000 AS end_ms FROM turns WHERE event_id % 2 = 0),
r AS (SELECT user_id, event_id AS turn_id, event_type AS speaker, start_ms AS rs, end_ms + 60000 AS re FROM turns WHERE event_id % 2 = 1),
p AS (SELECT l.*, r.turn_id, r.speaker, rs, re, least(end_ms, re) - greatest(start_ms, rs) AS overlap_ms
      FROM l JOIN r ON l.user_id = r.user_id AND start_ms < re AND rs < end_ms)"""


def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.union_measure(turns(spark, sf_dir), ["user_id"])


def interval_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.gaps(turns(spark, sf_dir), ["user_id"], least_ms=1000)


def interval_overlap_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.overlap_sweep(turns(spark, sf_dir).withColumn("end_ms", F.col("end_ms") + 3_600_000), ["user_id"])


def max_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues, spoken = sides(spark, sf_dir)
    return iv.best_overlap(cues, spoken, ["user_id"], "event_id", "speaker", "turn_id")


def interval_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues, spoken = sides(spark, sf_dir)
    return iv.covered(cues, spoken, ["user_id"], "event_id")


def nearest_turn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues, spoken = sides(spark, sf_dir)
    return iv.nearest_within(cues, spoken, ["user_id"], "event_id", "turn_id", 120_000)


def interval_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues, spoken = sides(spark, sf_dir)
    return iv.subtract(cues, spoken, ["user_id"], "event_id").groupBy("user_id", "event_id").agg(
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("left_ms"), F.count(F.lit(1)).alias("parts")
    )


def label_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.label_runs(turns(spark, sf_dir), ["user_id"], ["start_ms", "event_id"], "event_type")


def short_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.short_islands(label_runs(spark, sf_dir), ["user_id"], "event_type", 60_000)


def label_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_runs(spark, sf_dir).groupBy("user_id").agg((F.count(F.lit(1)) - 1).alias("switches"), F.max("members").alias("longest_run"))


def session_merge_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.sessions(turns(spark, sf_dir), ["user_id", "event_type"], ["event_id"], 3_600_000)


def rolling_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rn.rolling(turns(spark, sf_dir).withColumn("ms", F.col("end_ms") - F.col("start_ms")), ["event_type"], "start_ms", "ms", 12 * 3_600_000)
    return found.select("event_id", "window_count", "window_sum", ((F.col("window_count") > 50) | (F.col("window_sum") > 5_000_000)).alias("limited"))


def isolated_group_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.isolated(turns(spark, sf_dir), ["user_id"], ["event_id"], 600_000, 50_000).select("user_id", "event_id", "start_ms", "end_ms")


def micro_gap_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapped = rn.snap_gaps(turns(spark, sf_dir), ["user_id"], ["event_id"], 3_600_000)
    return snapped.select("event_id", "snapped_start_ms", "snapped_end_ms")


def tumbling_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean square of the value in each hour of a user."""
    hour = F.floor(F.col("start_ms") / 3_600_000)
    return turns(spark, sf_dir).groupBy("user_id", hour.alias("window")).agg(F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms"), F.count(F.lit(1)).alias("n"))


def sliding_probe_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of an hour that start every half hour: each event counts in both that hold it."""
    at = F.floor(F.col("start_ms") / 1_800_000)
    spread = turns(spark, sf_dir).select("event_type", "value", F.explode(F.array(at - 1, at)).alias("slide"))
    return spread.groupBy("event_type", "slide").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("support"))


QUERIES = {
    f.__name__: f
    for f in (
        interval_union, interval_complement, interval_overlap_sweep, max_overlap_join, interval_semi_join, nearest_turn_join,
        interval_difference, label_runs, short_islands, label_switches, session_merge_by_label, rolling_rate_limit,
        isolated_group_filter, micro_gap_snap, tumbling_rms, sliding_probe_support,
    )
}
ORACLES = {
    "interval_union": f"""WITH {TURNS_SQL}, {ISLANDS_SQL}
SELECT user_id, CAST(sum(e - s) AS BIGINT) AS active_ms, count(*) AS islands FROM i GROUP BY user_id""",
    "interval_complement": f"""WITH {TURNS_SQL}, {ISLANDS_SQL}
SELECT user_id, e AS gap_start_ms, nx AS gap_end_ms FROM (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY island) AS nx FROM i)
WHERE nx - e >= 1000""",
    "interval_overlap_sweep": f"""WITH {TURNS_SQL},
e AS (SELECT user_id, start_ms AS t, 1 AS d FROM turns UNION ALL SELECT user_id, end_ms + 3600000, -1 FROM turns),
g AS (SELECT user_id, t, sum(d) AS d FROM e GROUP BY ALL),
s AS (SELECT user_id, t, sum(d) OVER w AS active, lead(t) OVER w AS nx FROM g WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, CAST(coalesce(sum(CASE WHEN active >= 2 THEN nx - t END), 0) AS BIGINT) AS overlap_ms, CAST(max(active) AS BIGINT) AS most_active FROM s GROUP BY user_id""",
    "max_overlap_join": f"""WITH {SIDES_SQL}
SELECT user_id, event_id, speaker, overlap_ms FROM p QUALIFY row_number() OVER (PARTITION BY user_id, event_id ORDER BY overlap_ms DESC, turn_id) = 1""",
    "interval_semi_join": f"WITH {SIDES_SQL} SELECT DISTINCT user_id, event_id FROM p",
    "nearest_turn_join": f"""WITH {SIDES_SQL}, q AS (SELECT l.user_id, l.event_id, r.turn_id, (start_ms + end_ms) // 2 AS mid, rs, re FROM l JOIN r ON l.user_id = r.user_id),
d AS (SELECT *, greatest(rs - mid, mid - re, 0) AS distance_ms FROM q)
SELECT user_id, event_id, distance_ms, turn_id FROM d WHERE distance_ms <= 120000
QUALIFY row_number() OVER (PARTITION BY user_id, event_id ORDER BY distance_ms, turn_id) = 1""",
    "interval_difference": f"""WITH {SIDES_SQL},
c AS (SELECT user_id, event_id, start_ms AS l0, end_ms AS l1, greatest(start_ms, rs) AS s, least(end_ms, re) AS e FROM p),
m AS (SELECT *, max(e) OVER (PARTITION BY event_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
holes AS (SELECT user_id, event_id, coalesce(reach, l0) AS a, s AS b FROM m WHERE s > coalesce(reach, l0)
  UNION ALL SELECT user_id, event_id, max(e), any_value(l1) FROM c GROUP BY user_id, event_id HAVING max(e) < any_value(l1)
  UNION ALL SELECT user_id, event_id, start_ms, end_ms FROM l WHERE event_id NOT IN (SELECT event_id FROM p))
SELECT user_id, event_id, CAST(sum(b - a) AS BIGINT) AS left_ms, count(*) AS parts FROM holes GROUP BY ALL""",
    "label_runs": f"WITH {TURNS_SQL}, {RUNS_SQL} SELECT * FROM runs",
    "short_islands": f"""WITH {TURNS_SQL}, {RUNS_SQL}
SELECT user_id, run, event_type, a AS around, start_ms, end_ms, members FROM (SELECT *, lag(event_type) OVER w AS a, lead(event_type) OVER w AS z FROM runs WINDOW w AS (PARTITION BY user_id ORDER BY run))
WHERE a = z AND end_ms - start_ms <= 60000""",
    "label_switches": f"WITH {TURNS_SQL}, {RUNS_SQL} SELECT user_id, count(*) - 1 AS switches, max(members) AS longest_run FROM runs GROUP BY user_id",
    "session_merge_by_label": f"""WITH {TURNS_SQL},
m AS (SELECT *, max(end_ms) OVER (PARTITION BY user_id, event_type ORDER BY start_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM turns),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms - reach > 3600000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY start_ms, event_id ROWS UNBOUNDED PRECEDING) AS session FROM m)
SELECT user_id, event_type, CAST(session AS BIGINT) AS session, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS members, CAST(sum(end_ms - start_ms) AS BIGINT) AS support_ms FROM n GROUP BY user_id, event_type, session""",
    "rolling_rate_limit": f"""WITH {TURNS_SQL}, w AS (SELECT event_id, count(*) OVER x AS window_count, CAST(sum(end_ms - start_ms) OVER x AS BIGINT) AS window_sum
  FROM turns WINDOW x AS (PARTITION BY event_type ORDER BY start_ms RANGE BETWEEN 43200000 PRECEDING AND CURRENT ROW))
SELECT *, window_count > 50 OR window_sum > 5000000 AS limited FROM w""",
    "isolated_group_filter": f"""WITH {TURNS_SQL}, x AS (SELECT *, start_ms - max(end_ms) OVER (PARTITION BY user_id ORDER BY start_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  lead(start_ms) OVER (PARTITION BY user_id ORDER BY start_ms, event_id) - end_ms AS a FROM turns)
SELECT user_id, event_id, start_ms, end_ms FROM x WHERE coalesce(b, 600000) >= 600000 AND coalesce(a, 600000) >= 600000 AND end_ms - start_ms <= 50000""",
    "micro_gap_snap": f"""WITH {TURNS_SQL}, x AS (SELECT *, lead(start_ms) OVER w AS ns, lag(end_ms) OVER w AS pe FROM turns WINDOW w AS (PARTITION BY user_id ORDER BY start_ms, event_id))
SELECT event_id, CASE WHEN start_ms - pe > 0 AND start_ms - pe < 3600000 THEN (pe + start_ms) // 2 + (start_ms - pe) // 4 ELSE start_ms END AS snapped_start_ms,
  CASE WHEN ns - end_ms > 0 AND ns - end_ms < 3600000 THEN (end_ms + ns) // 2 + (ns - end_ms) // 4 ELSE end_ms END AS snapped_end_ms FROM x""",
    "tumbling_rms": f"""WITH {TURNS_SQL} SELECT user_id, start_ms // 3600000 AS "window", round(sqrt(avg(value * value)), 6) AS rms, count(*) AS n FROM turns GROUP BY ALL""",
    "sliding_probe_support": f"""WITH {TURNS_SQL}, x AS (SELECT event_type, value, unnest([start_ms // 1800000 - 1, start_ms // 1800000]) AS slide FROM turns)
SELECT event_type, slide, count(*) AS n, round(sum(value), 6) AS support FROM x GROUP BY ALL""",
}
