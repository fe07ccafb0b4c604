"""Roll-ups and comparisons over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelattice.functions import text as tx
from cuelattice.operators import corpus as cp
from cuelattice.queries.text_queries import _BARE, NOTE_SQL
from cuelattice.session import table


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as model requests: an order is a task, every tenth lacks its id."""
    li = table(spark, sf_dir, "lineitem")
    stamp = F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    task = F.when(F.col("l_orderkey") % 10 == 0, F.lit("")).otherwise(F.col("l_orderkey").cast("string"))
    return li.select(
        cp.group_id(task, F.col("l_suppkey").cast("string"), stamp).alias("group_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.col("l_linestatus").alias("stage"), F.col("l_returnflag").alias("model"), (F.col("l_returnflag") == "R").alias("is_error"), stamp.alias("timestamp"),
        F.floor("l_extendedprice").cast("long").alias("duration_ms"), F.col("l_quantity").cast("long").alias("tokens"),
        F.col("l_partkey").cast("long").alias("prompt_tokens"), F.col("l_linenumber").cast("long").alias("cached_tokens"),
    )


def log_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.task_rollup(requests(spark, sf_dir))


def log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of tasks, the latest first."""
    rolled = log_rollup(spark, sf_dir).select("group_id", "request_count", "ended_at", "stages")
    return cp.page(rolled, [F.desc("ended_at"), F.asc("group_id")], 2, 50)


def telemetry_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each task and of each stage within it."""
    r = requests(spark, sf_dir)
    return r.groupingSets([[F.col("group_id")], [F.col("group_id"), F.col("stage")]], "group_id", "stage").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), F.count_if("is_error").alias("errors"), F.count_distinct("model").alias("models")
    )


def weighted_vs_macro_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumns({"errors": F.col("l_linenumber").cast("double"), "total": F.col("l_quantity")})
    return cp.weighted_and_macro(li, ["l_returnflag", "l_linestatus"], "errors", "total")


def corpus_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"), F.count("quality").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"),
        F.count_if(F.col("quality") == 0).alias("low"), F.count_distinct("lang").alias("langs"),
    )


def defect_index_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation with a defect, as lists."""
    t = F.col("text")
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.col("turn")))), lambda x: x.cast("string")), ",")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        listed(F.length(t) > 400).alias("long"), listed(~tx.ends_sentence(t)).alias("open"), listed(tx.is_note(t)).alias("notes")
    )


def percentile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.percentile("n_chars", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), p.alias("p"))
    return out.select("lang", "n", "mean", *[F.round(F.col("p")[i], 6).alias(k) for i, k in enumerate(("p5", "p50", "p95"))])


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    agg = lambda x: x.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.sum("n_chars").alias("chars"))
    return agg(d.where("doc_id % 2 = 0")), agg(d.where("doc_id % 2 = 1"))


def legacy_candidate_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = halves(spark, sf_dir)
    return cp.metric_gates(old, new, "source", ["docs", "toxic", "chars"])


def admission_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's failed metrics, and what follows: blocked, observe or review."""
    g = legacy_candidate_compare(spark, sf_dir)
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("metric"))))
    out = g.groupBy("source").agg(F.array_join(failed, ",").alias("failed"), F.count_if(~F.col("passed")).alias("n_failed"), F.bool_or((F.col("metric") == "toxic") & ~F.col("passed")).alias("hard"))
    return out.withColumn("decision", F.when(F.col("hard"), "blocked").when(F.col("n_failed") > 0, "observe").otherwise("review")).drop("hard")


def shifted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations, and a copy with some turns lost, added or changed."""
    c = table(spark, sf_dir, "conversations")
    kept = c.where("(conv_id + turn) % 11 <> 0").withColumn("text", F.when(F.col("turn") % 3 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    added = c.where("conv_id % 5 = 0 AND turn = 0").withColumn("turn", F.lit(999).cast(dict(c.dtypes)["turn"]))
    return c, kept.unionByName(added)


def structure_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = shifted(spark, sf_dir)
    return cp.rows_compared(before, after, ["conv_id", "turn"], ["role", "text"]).groupBy("conv_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def integrity_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = shifted(spark, sf_dir)
    return cp.rows_compared(before, after, ["conv_id", "turn"], ["role", "text"]).select("conv_id", "turn", "column", "kind", F.md5("before").alias("before"), F.md5("after").alias("after"))


def key_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = shifted(spark, sf_dir)
    sets = lambda d, n: d.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.col("turn").cast("long"))).alias(n))
    both = sets(before, "b").join(sets(after, "a"), "conv_id", "full_outer")
    empty = F.array().cast("array<bigint>")
    join = lambda x, y: F.array_join(F.array_sort(F.array_except(F.coalesce(x, empty), F.coalesce(y, empty))), ",")
    return both.select("conv_id", join(F.col("b"), F.col("a")).alias("missing"), join(F.col("a"), F.col("b")).alias("extra"))


def speaker_centroid_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.centroid_margins(table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")), "label", "embedding", "vec_id")


def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


def cross_key_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose edited tokens (their own and the first six of the next turn) claim a neighbour's words."""
    c = table(spark, sf_dir, "conversations").withColumn("own", tx.tokens(F.col("text")))
    after = F.when(F.col("turn") % 2 == 0, F.concat(F.col("own"), F.slice(F.coalesce(F.lead("own").over(Window.partitionBy("conv_id").orderBy("turn")), F.array().cast("array<string>")), 1, 6))).otherwise(F.col("own"))
    return cp.neighbour_claims(c.withColumn("edited", after), ["conv_id"], "turn", "own", "edited").select("conv_id", "turn", "from_previous", "from_next")


def diagonal_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns of a conversation laid over each other."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(tx.tokens(F.col("text"))).alias("i", "w"))
    return cp.best_diagonal(words, words.withColumn("turn", F.col("turn") - 1), ["conv_id", "turn"], "w", "i")


QUERIES = {
    f.__name__: f
    for f in (
        log_rollup, log_page, telemetry_grouping_sets, weighted_vs_macro_rate, corpus_rollup, defect_index_lists, percentile_stats,
        legacy_candidate_compare, admission_gate, structure_diff, integrity_diff, key_set_diff, speaker_centroid_margin, confusion_counts,
        cross_key_overlap, diagonal_alignment,
    )
}

_R = r"""r AS (SELECT CASE WHEN l_orderkey % 10 = 0 THEN 'legacy:' || substr(sha256(CAST(l_suppkey AS VARCHAR) || chr(31) || substr(strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S'), 1, 16)), 1, 20) ELSE CAST(l_orderkey AS VARCHAR) END AS group_id,
  l_orderkey * 10 + l_linenumber AS seq, l_linestatus AS stage, l_returnflag AS model, l_returnflag = 'R' AS is_error, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS ts,
  CAST(floor(l_extendedprice) AS BIGINT) AS duration_ms, CAST(l_quantity AS BIGINT) AS tokens, l_partkey AS prompt_tokens, CAST(l_linenumber AS BIGINT) AS cached_tokens FROM lineitem)"""
_ROLL = f"""{_R}, s AS (SELECT group_id, stage, min(seq) AS q FROM r GROUP BY ALL), m AS (SELECT group_id, model, min(seq) AS q FROM r GROUP BY ALL),
ss AS (SELECT group_id, string_agg(stage, ',' ORDER BY q, stage) AS stages FROM s GROUP BY 1), mm AS (SELECT group_id, string_agg(model, ',' ORDER BY q, model) AS models FROM m GROUP BY 1),
g AS (SELECT group_id, count(*) AS request_count, count(*) FILTER (is_error) AS error_count, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, CAST(sum(tokens) AS BIGINT) AS tokens,
  CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, min(ts) AS started_at, max(ts) AS ended_at FROM r GROUP BY group_id)"""
_SHIFT = """b AS (SELECT * FROM conversations), a AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 2 THEN text || '!' ELSE text END AS text FROM conversations WHERE (conv_id + turn) % 11 <> 0
  UNION ALL SELECT conv_id, 999, role, text FROM conversations WHERE conv_id % 5 = 0 AND turn = 0),
j AS (SELECT coalesce(b.conv_id, a.conv_id) AS conv_id, coalesce(b.turn, a.turn) AS turn, b.role AS br, a.role AS ar, b.text AS bt, a.text AS atx, b.conv_id IS NULL AS nob, a.conv_id IS NULL AS noa
  FROM b FULL OUTER JOIN a ON b.conv_id = a.conv_id AND b.turn = a.turn),
d AS (SELECT conv_id, turn, NULL AS "column", CASE WHEN noa THEN 'missing' ELSE 'extra' END AS kind, NULL AS before, NULL AS after FROM j WHERE noa OR nob
  UNION ALL SELECT conv_id, turn, 'role', 'changed', br, ar FROM j WHERE NOT noa AND NOT nob AND br IS DISTINCT FROM ar
  UNION ALL SELECT conv_id, turn, 'text', 'changed', bt, atx FROM j WHERE NOT noa AND NOT nob AND bt IS DISTINCT FROM atx)"""
_GATES = """h AS (SELECT source, doc_id % 2 AS side, count(*) AS docs, count(*) FILTER (toxic = 1) AS toxic, sum(n_chars) AS chars FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
u AS (SELECT source, side, unnest(['docs', 'toxic', 'chars']) AS metric, unnest([CAST(docs AS DOUBLE), CAST(toxic AS DOUBLE), CAST(chars AS DOUBLE)]) AS v FROM h),
g AS (SELECT source, metric, coalesce(max(v) FILTER (side = 0), 0.0) AS legacy, coalesce(max(v) FILTER (side = 1), 0.0) AS candidate FROM u GROUP BY ALL),
gates AS (SELECT *, round(candidate - legacy, 6) AS delta, CASE WHEN legacy = 0 AND candidate = 0 THEN 0.0 WHEN legacy = 0 THEN -1.0 ELSE round(candidate / legacy, 6) END AS ratio, candidate <= legacy AS passed FROM g)"""
_T = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_ENDS = r"""(regexp_matches(trim(text), '[.!?。！？]["''”’)\]]*$') AND NOT regexp_matches(trim(text), '(\.\.|…)["''”’)\]]*$'))"""

_RUNS = "CASE WHEN len({t}) >= {n} THEN list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i:i + {n} - 1], ' ')) ELSE [] END"
_CLAIMED = lambda other: "CASE " + " ".join(
    f"WHEN len(list_filter(list_intersect({_RUNS.format(t='edited', n=n)}, {_RUNS.format(t=other, n=n)}), lambda x: NOT list_contains({_RUNS.format(t='own', n=n)}, x))) > 0 THEN {n}" for n in range(12, 3, -1)
) + " ELSE 0 END"
_CLAIMS = f"""WITH c AS (SELECT conv_id, turn, {_T} AS own FROM conversations),
n AS (SELECT *, lag(own) OVER w AS prev, lead(own) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
e AS (SELECT *, CASE WHEN turn % 2 = 0 THEN list_concat(own, coalesce(nxt, [])[1:6]) ELSE own END AS edited FROM n),
f AS (SELECT conv_id, turn, {_CLAIMED('prev')} AS from_previous, {_CLAIMED('nxt')} AS from_next FROM e)
SELECT * FROM f WHERE from_previous > 0 OR from_next > 0"""

ORACLES = {
    "log_rollup": f"""WITH {_ROLL} SELECT g.*, stages, models, CASE WHEN prompt_tokens > 0 THEN round_even(cached_tokens / prompt_tokens, 4) ELSE 0.0 END AS cache_hit_rate FROM g JOIN ss USING (group_id) JOIN mm USING (group_id)""",
    "log_page": f"""WITH {_ROLL} SELECT group_id, request_count, ended_at, stages FROM g JOIN ss USING (group_id) ORDER BY ended_at DESC, group_id LIMIT 50 OFFSET 50""",
    "telemetry_grouping_sets": f"""WITH {_R} SELECT group_id, stage, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (is_error) AS errors, count(DISTINCT model) AS models FROM r GROUP BY GROUPING SETS ((group_id), (group_id, stage))""",
    "weighted_vs_macro_rate": """SELECT l_returnflag, l_linestatus, round(sum(CAST(l_linenumber AS DOUBLE)) / sum(l_quantity), 8) AS weighted_rate, round(avg(l_linenumber / l_quantity), 8) AS macro_rate, count(*) AS n FROM lineitem GROUP BY ALL""",
    "corpus_rollup": """SELECT source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, count(quality) AS labelled, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality = 0) AS low, count(DISTINCT lang) AS langs
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
    "defect_index_lists": f"""SELECT conv_id, coalesce(string_agg(CASE WHEN length(text) > 400 THEN turn END, ',' ORDER BY turn), '') AS long, coalesce(string_agg(CASE WHEN NOT {_ENDS} THEN turn END, ',' ORDER BY turn), '') AS open,
  coalesce(string_agg(CASE WHEN {NOTE_SQL} THEN turn END, ',' ORDER BY turn), '') AS notes FROM (SELECT *, {_BARE} AS bare FROM conversations) GROUP BY conv_id""",
    "percentile_stats": """SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean, round(quantile_cont(CAST(n_chars AS DOUBLE), 0.05), 6) AS p5, round(quantile_cont(CAST(n_chars AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST(n_chars AS DOUBLE), 0.95), 6) AS p95 FROM documents GROUP BY lang""",
    "legacy_candidate_compare": f"WITH {_GATES} SELECT * FROM gates",
    "admission_gate": f"""WITH {_GATES}, x AS (SELECT source, coalesce(string_agg(CASE WHEN NOT passed THEN metric END, ',' ORDER BY metric), '') AS failed, count(*) FILTER (NOT passed) AS n_failed, bool_or(metric = 'toxic' AND NOT passed) AS hard FROM gates GROUP BY source)
SELECT source, failed, n_failed, CASE WHEN hard THEN 'blocked' WHEN n_failed > 0 THEN 'observe' ELSE 'review' END AS decision FROM x""",
    "structure_diff": f"WITH {_SHIFT} SELECT conv_id, kind, count(*) AS n FROM d GROUP BY ALL",
    "integrity_diff": f'WITH {_SHIFT} SELECT conv_id, turn, "column", kind, md5(before) AS before, md5(after) AS after FROM d',
    "key_set_diff": f"""WITH {_SHIFT} SELECT conv_id, coalesce(string_agg(CASE WHEN noa THEN turn END, ',' ORDER BY turn), '') AS missing, coalesce(string_agg(CASE WHEN nob THEN turn END, ',' ORDER BY turn), '') AS extra FROM j GROUP BY conv_id""",
    "speaker_centroid_margin": """WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
n AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * x)) AS z FROM e GROUP BY 1), u AS (SELECT vec_id, label, i, CAST(x AS DOUBLE) / z AS x FROM e JOIN n USING (vec_id)),
c0 AS (SELECT label AS centre, i, avg(x) AS x FROM u GROUP BY ALL), cz AS (SELECT centre, sqrt(sum(x * x)) AS z FROM c0 GROUP BY 1), c AS (SELECT centre, i, x / z AS x FROM c0 JOIN cz USING (centre)),
s AS (SELECT vec_id, label, centre, sum(u.x * c.x) AS sim FROM u JOIN c USING (i) GROUP BY ALL)
SELECT vec_id, label, round(max(sim) FILTER (label = centre), 4) AS own, round(max(sim) FILTER (label <> centre), 4) AS other FROM s GROUP BY ALL""",
    "cross_key_overlap": _CLAIMS,
    "confusion_counts": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL",
    "diagonal_alignment": f"""WITH w AS (SELECT conv_id, turn, unnest({_T}) AS w, generate_subscripts({_T}, 1) - 1 AS i FROM conversations), nl AS (SELECT conv_id, turn, max(i) + 1 AS n FROM w GROUP BY ALL),
p AS (SELECT a.conv_id, a.turn, nl.n - a.i + b.i AS shift FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn AND a.w = b.w JOIN nl ON nl.conv_id = a.conv_id AND nl.turn = a.turn),
k AS (SELECT conv_id, turn, shift, count(*) AS matches FROM p GROUP BY ALL HAVING count(*) >= 2)
SELECT conv_id, turn, shift, matches, round(matches / shift + shift / 10000, 9) AS score FROM k QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(matches / shift + shift / 10000, 9) DESC, shift) = 1""",
}
