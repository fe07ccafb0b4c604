"""Words with times from captions, plans of repair for orders as tasks with their lines as diagnostics, and turns under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelattice.functions import text as tx
from cuelattice.operators import repairs as rp
from cuelattice.queries.cue_queries import _MAINLY, _WORDS
from cuelattice.session import table
from cuelattice.sources import timed_words as tw

RULES = ("number.missing", "entity.missing", "translation.boundary.tail", "script.mixed", "length.over", "source.copied")
KINDS = ("ownership", "structure", "fluency", "completeness", "duplication")


def caption_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content): a block a turn of a minute, a word every 150 ms; each block first repeats the turn before."""
    said = F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "<>", ""), r"[ \t\r\n]+", " "))
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), "turn", said.alias("said")).where("said <> ''")
    words, start = F.split("said", " "), F.col("turn").cast("long") * 60_000
    at = lambda i: tx.clock(start + i * 150, ".")
    word = lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.lit("<"), at(i), F.lit("><c> "), w, F.lit("</c>")))
    before = F.lag("said", 1, " ").over(Window.partitionBy("doc_id").orderBy("turn"))
    block = F.concat(at(F.lit(0)), F.lit(" --> "), at(F.size(words)), F.lit(" align:start position:0%\n"), before, F.lit("\n"), F.array_join(F.transform(words, word), ""))
    blocks = c.select("doc_id", "turn", block.alias("block")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("turn", "block"))).alias("blocks"))
    return blocks.select("doc_id", F.concat(F.lit("WEBVTT\nKind: captions\n\n"), F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n")).alias("content"))


def timed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tw.parse_timed_vtt(caption_files(spark, sf_dir))


def imported_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What captions hold as imported words, and turns as imported sentences, each counted."""
    words = timed_words(spark, sf_dir)
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("t"), "conv_id").alias("doc_id"), F.col("turn").cast("long").alias("idx"), F.lit(0).cast("long").alias("start_ms"), F.lit(1).cast("long").alias("end_ms"), F.trim("text").alias("text"))
    got = tw.imported(words.unionByName(turns), ["doc_id"])
    return got.groupBy("doc_id", "granularity", "timing_source").agg(F.count(F.lit(1)).alias("cues"), F.sum(F.coalesce(F.size("words"), F.lit(0))).cast("long").alias("words"))


def one_of(values: tuple[str, ...], column: str) -> Column:
    return F.get(F.array(*map(F.lit, values)), (F.col(column) % len(values)).cast("int"))


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 10").select(
        F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("seq"), one_of(RULES, "l_partkey").alias("rule"), one_of(KINDS, "l_suppkey").alias("category"),
        F.when(F.col("l_discount") < 0.08, "deterministic").otherwise("retry").alias("strategy"),
        F.sequence(F.col("l_linenumber").cast("long"), F.col("l_linenumber") + F.col("l_partkey") % 3).alias("cues"),
    )
    tasks = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("task"), (F.col("o_custkey") % 5).alias("attempts"), (F.col("o_custkey") % 2).alias("reasoning_attempts"), (F.col("o_orderstatus") != "F").alias("reasoning"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "O").alias("dialogue"), F.col("o_orderpriority").startswith("1").alias("cancelled"),
    )
    return rp.repair_plans(tasks, lines, ["task"])


def repair_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return plans(spark, sf_dir).withColumns({c: joined(c) for c in ("affected", "rules", "rationale")})


def repair_plan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.plan_counts(plans(spark, sf_dir))


def budgeted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("chars"))
    return rp.within_budget(turns, ["conv_id"], ["turn"], "chars", 4, 900)


QUERIES = {q.__name__: q for q in (timed_words, imported_cues, repair_plans, repair_plan_counts, budgeted_turns)}

_T = r"""t AS (SELECT conv_id, turn, string_split(trim(regexp_replace(translate(coalesce(text, ''), '<>', ''), '[ \t\r\n]+', ' ', 'g')), ' ') AS w FROM conversations),
e AS (SELECT conv_id, turn, w, unnest(range(len(w))) AS i FROM t WHERE len(w) > 1)"""
_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_P = f"""d AS (SELECT l_orderkey AS task, l_linenumber AS seq, {_LIST(RULES)}[CAST(l_partkey % {len(RULES)} AS INT) + 1] AS rule, {_LIST(KINDS)}[CAST(l_suppkey % {len(KINDS)} AS INT) + 1] AS category, l_discount < 0.08 AS plain, range(l_linenumber, l_linenumber + l_partkey % 3 + 1) AS cues FROM lineitem WHERE l_quantity > 10),
r AS (SELECT task, string_agg(rule, ',' ORDER BY s, rule) AS rules FROM (SELECT task, rule, min(seq) AS s FROM d GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT task, string_agg(CAST(cue AS VARCHAR), ',' ORDER BY cue) AS affected FROM (SELECT DISTINCT task, unnest(cues) AS cue FROM d) GROUP BY 1),
f AS (SELECT task, bool_or(rule LIKE 'number.%' OR rule LIKE 'entity.%') AS fact, bool_or(rule LIKE 'translation.boundary%' OR category IN ('ownership', 'fluency')) AS thought, bool_and(plain) AS plain FROM d GROUP BY 1),
o AS (SELECT o_orderkey AS task, greatest(0, 3 - o_custkey % 5) AS remaining, o_custkey % 2 < 1 AND o_orderstatus <> 'F' AS able, CASE o_orderstatus WHEN 'O' THEN 'dialogue' WHEN 'P' THEN 'unknown' ELSE 'monologue' END AS session_mode, o_orderpriority LIKE '1%' AS cancelled FROM orders),
j AS (SELECT *, CASE WHEN cancelled THEN 'cancelled' WHEN rules IS NULL THEN 'no_diagnostics' WHEN remaining = 0 THEN 'budget_exhausted' ELSE 'planned' END AS disposition FROM o LEFT JOIN r USING (task) LEFT JOIN c USING (task) LEFT JOIN f USING (task)),
k AS (SELECT *, CASE WHEN disposition <> 'planned' THEN 'none' WHEN fact THEN 'local_rewrite' WHEN plain THEN 'deterministic' ELSE 'retry' END AS strategy, disposition = 'planned' AND thought AND able AS reasoned FROM j),
p AS (SELECT task, disposition, strategy, coalesce(affected, '') AS affected, CASE WHEN reasoned THEN 2 WHEN strategy = 'local_rewrite' THEN 1 ELSE 0 END AS context_radius,
 CASE WHEN reasoned THEN 'enabled' ELSE 'disabled' END AS reasoning_mode, CASE WHEN disposition = 'planned' THEN 1 ELSE 0 END AS maximum_attempts, coalesce(rules, '') AS rules, session_mode,
 CASE disposition WHEN 'cancelled' THEN 'task_cancelled' WHEN 'no_diagnostics' THEN 'no_diagnostics' WHEN 'budget_exhausted' THEN 'total_attempt_budget_exhausted' ELSE
 CASE strategy WHEN 'local_rewrite' THEN 'source_fact_missing,local_context_only' WHEN 'deterministic' THEN 'all_diagnostics_deterministic' ELSE 'hard_invariant_failed,preserve_legacy_retry_policy' END
 || CASE WHEN reasoned THEN ',confirmed_high_risk_window' ELSE '' END || CASE WHEN session_mode = 'dialogue' THEN ',dialogue_context_is_read_only' ELSE '' END END AS rationale FROM k)"""
ORACLES = {
    "timed_words": f"""WITH {_T} SELECT CAST(conv_id AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS idx, CAST(turn * 60000 + i * 150 AS BIGINT) AS start_ms, CAST(turn * 60000 + i * 150 + 150 AS BIGINT) AS end_ms, w[i + 1] AS text FROM e""",
    "imported_cues": f"""WITH {_T}, u AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, w[i + 1] AS x FROM e UNION ALL SELECT 't' || conv_id, trim(text) FROM conversations),
n AS (SELECT doc_id, count(*) AS cues, count(*) FILTER (CASE WHEN {_MAINLY('x')} THEN length(x) <= 2 ELSE len({_WORDS.format('x')}) = 1 END) AS single FROM u GROUP BY 1)
SELECT doc_id, CASE WHEN single >= 0.8 * cues THEN 'word' ELSE 'sentence' END AS granularity, 'imported' AS timing_source, cues, CASE WHEN single >= 0.8 * cues THEN cues ELSE 0 END AS words FROM n""",
    "repair_plans": f"WITH {_P} SELECT * FROM p",
    "repair_plan_counts": f"""WITH {_P} SELECT kind, value, count(*) AS plans FROM (SELECT 'disposition' AS kind, disposition AS value FROM p UNION ALL SELECT 'session_mode', session_mode FROM p UNION ALL SELECT 'strategy', strategy FROM p WHERE disposition = 'planned'
UNION ALL SELECT 'reasoning_mode', reasoning_mode FROM p WHERE disposition = 'planned' UNION ALL SELECT 'rule', unnest(string_split(rules, ',')) FROM p WHERE rules <> '') GROUP BY 1, 2""",
    "budgeted_turns": """WITH t AS (SELECT conv_id, turn, length(text) AS chars, coalesce(length(text), 0) AS n FROM conversations),
s AS (SELECT *, bool_or(n <= 900) OVER (PARTITION BY conv_id ORDER BY turn) AS begun FROM t),
b AS (SELECT *, sum(n + 1) OVER w - 1 AS used, row_number() OVER w AS nth FROM s WHERE begun WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) SELECT conv_id, turn, chars FROM b WHERE used <= 900 AND nth <= 4""",
}
