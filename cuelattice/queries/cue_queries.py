"""Queries over cue tables: conversations are documents with their turns as cues, and events are timed turns with labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelattice.functions import text as tx
from cuelattice.operators import cues as cu
from cuelattice.queries.corpus_queries import _R, requests
from cuelattice.queries.fold_queries import cues
from cuelattice.queries.interval_queries import TURNS_SQL, sides, SIDES_SQL, turns
from cuelattice.session import table


def blanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues in reverse order of idx, of which every fourth is blank."""
    return cues(spark, sf_dir).withColumns({"idx": -F.col("idx"), "text": F.when(F.col("idx") % 4 == 3, F.lit("  ")).otherwise(F.col("text"))})


def cue_normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cu.normal_form(blanked(spark, sf_dir), ["doc_id"]).select("doc_id", "idx", "start_ms", F.md5("text").alias("digest"))


def word_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of which those with an even number are cut to one word a cue."""
    even = F.col("doc_id").cast("long") % 2 == 0
    return cu.word_level(cues(spark, sf_dir).withColumn("text", F.when(even, F.substring_index(F.trim("text"), " ", 1)).otherwise(F.col("text"))), ["doc_id"])


def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("doc_id") % 5 == 0, "ENG").when(F.col("doc_id") % 5 == 1, F.concat(F.upper("lang"), F.lit("_XX"))).when(F.col("doc_id") % 5 == 2, " zho").when(F.col("doc_id") % 5 == 3, None).otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.language_code(code).alias("code"))


def clipped_to_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cu.clipped(cues(spark, sf_dir), F.lit(7000)).select("doc_id", "idx", "start_ms", "end_ms")


def display_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with Han text, numbers and both kinds of marks added, as they are shown."""
    text = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit("，字幕3.5,x.y、 。"))).otherwise(F.concat(F.lit(" "), "text", F.lit("。，")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(tx.without_tail_marks(text)).alias("trimmed"), F.md5(tx.spaced_marks(text)).alias("spaced"))


def dangling_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[tx.dangles(F.substring_index("text", " ", n)).alias(f"after_{n}") for n in (1, 5, 20)])


def output_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as sources; outputs are copies, copies with other marks, Chinese, or addresses."""
    kind = (F.col("conv_id") + F.col("turn")) % 4
    source = F.when(kind == 3, F.lit("www.example.com/about")).otherwise(F.col("text"))
    output = F.when(kind == 0, F.col("text")).when(kind == 1, F.concat("text", F.lit(" !!"))).when(kind == 2, F.lit("字幕")).otherwise(source)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.source_copy(output, source).alias("source_copy"), tx.is_untranslated(output, source, "zh").alias("untranslated"))


def time_gap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cu.time_groups(turns(spark, sf_dir), ["user_id"], ["start_ms", "event_id"], 36_000_000, ("event_type",))
    return found.select("user_id", F.col("group").cast("long").alias("group"), "start_ms", "end_ms", "members")


def long_groups_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cu.time_groups(turns(spark, sf_dir), ["user_id"], ["start_ms", "event_id"], 86_400_000, most=3)
    return found.select("user_id", F.col("group").cast("long").alias("group"), F.col("part").cast("long").alias("part"), "start_ms", "end_ms", "members")


def label_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns' roles as speakers, swapped in every third; a conversation of every seventh differs in a text too."""
    before = cues(spark, sf_dir).join(table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("long").alias("idx"), F.col("role").alias("speaker")), ["doc_id", "idx"])
    n = F.col("doc_id").cast("long")
    after = before.withColumns({"speaker": F.when(F.col("idx") % 3 == 1, "other").otherwise(F.col("speaker")), "text": F.when((n % 7 == 0) & (F.col("idx") == 0), F.concat("text", F.lit("."))).otherwise(F.col("text"))})
    return cu.relabelled(before, after, ["doc_id"], "idx", "speaker").select("doc_id", "idx", "start_ms", "from", "to", F.md5("context").alias("context"))


def gold_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns against a gold version that changes every third and lacks the first turn of every fifth conversation."""
    mine = cues(spark, sf_dir)
    gold = mine.where("NOT (CAST(doc_id AS BIGINT) % 5 = 0 AND idx = 0)").withColumn("text", F.when(F.col("idx") % 3 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return cu.gold_comparison(mine, gold, ["doc_id"], "idx")


def spoken_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("speaker", F.when(F.col("turn") % 5 == 4, None).otherwise(F.col("role")))
    return cu.spoken_words(c, ["conv_id"], "speaker")


def simultaneous_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, spoken = sides(spark, sf_dir)
    longer = spoken.withColumn("end_ms", F.col("end_ms") + 3_600_000)
    return cu.simultaneous(words, longer, ["user_id"], "event_id", "speaker", 3_600_000)


def resegmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir).withColumn("translated", F.when(F.col("idx") % 4 == 1, F.lit("x")))
    return cu.split_evenly(c, ["doc_id", "idx"]).select("doc_id", "idx", "part", "start_ms", "end_ms", F.md5("text").alias("digest"))


GRID = [(s, m, p) for s in (600_000, 7_200_000, 36_000_000) for m in (0, 120_000) for p in (0, 30_000)]


def vad_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cu.sweep(turns(spark, sf_dir).where("end_ms > start_ms"), ["user_id"], GRID)


def disagreement_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = turns(spark, sf_dir).where("end_ms > start_ms")
    after = before.withColumn("event_type", F.when(F.col("event_id") % 3 == 0, "other").otherwise(F.col("event_type")))
    found = cu.disagreement(before, after, ["user_id"], "event_id", "event_type", 7_200_000, 5)
    return found.select("user_id", "window", "labelled_ms", "differing_ms", "share", F.col("rank").cast("long").alias("rank"))


def merged_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cu.merged_snapshots(requests(spark, sf_dir), ["model"], "group_id", "stage", ["duration_ms", "tokens", "prompt_tokens", "cached_tokens"])


def attempt_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a task in order of their number; those of more than 40 tokens fail."""
    return cu.attempts(requests(spark, sf_dir), ["model"], "group_id", ["seq", "tokens", "duration_ms"], F.col("tokens") > 40)


def mention_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with a part number in two of three."""
    c = cues(spark, sf_dir).withColumn("text", F.when(F.col("idx") % 3 != 0, F.concat(F.lit("AB-"), F.col("idx") % 2, F.lit("7 "), "text")).otherwise(F.col("text")))
    return cu.mention_contexts(c, ["doc_id"], "idx").select("doc_id", "mention", "n", "first_at", F.md5("context").alias("context"))


def manifest_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as samples: names of every seventh repeat, segments are splits, and paths clash or lack."""
    n = F.col("c_custkey")
    samples = table(spark, sf_dir, "customer").select(
        F.when(n % 7 == 0, F.concat(F.lit("s"), n % 21)).otherwise(F.col("c_name")).alias("sample_id"), F.lower("c_mktsegment").alias("split"),
        F.when(n % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("src"), F.when(n % 13 == 0, n % 26).otherwise(n))).alias("source_path"), F.concat(F.lit("gold"), n).alias("gold_path"),
    )
    return cu.manifest_problems(samples, ["building", "machinery", "household"], ["source_path", "gold_path"])


def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of which every ninth is broken: the valid entries, the newest first within each user."""
    line = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    told = table(spark, sf_dir, "events").withColumn("entry", F.try_parse_json(line)).where("entry IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return told.select("user_id", "event_id", nth.cast("long").alias("nth"))


QUERIES = {
    f.__name__: f
    for f in (
        cue_normal_form, word_level, language_codes, clipped_to_media, display_marks, dangling_tails, output_checks, time_gap_groups, long_groups_cut,
        label_changes, gold_comparison, spoken_words, simultaneous_speech, resegmented, vad_sweep, disagreement_windows, merged_snapshots,
        attempt_counts, mention_contexts, manifest_problems, log_entries,
    )
}

_C = "c AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn AS BIGINT) AS idx, role, turn * 3000 AS s, turn * 3000 + length(text) * 40 AS e, text FROM conversations)"
_UN = tx.UNSPACED
_WORDS = r"list_filter(string_split_regex({}, '[ \t\n\r\f\v]+'), lambda x: x <> '')"
_MAINLY = lambda x: rf"length(regexp_replace({x}, '[ \t\n\r\f\v]+', '', 'g')) > 0 AND len(regexp_extract_all({x}, '{_UN}')) > 0.5 * length(regexp_replace({x}, '[ \t\n\r\f\v]+', '', 'g'))"
_HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"
_BARE = r"regexp_replace(lower({}), '[^0-9a-z\x{{3400}}-\x{{9fff}}]+', '', 'g')"
_ID = tx.IDENTIFIER
_GRID = ", ".join(f"({s}, {m}, {p})" for s, m, p in GRID)
_DANGLE = ", ".join(f"'{w}'" for w in tx.DANGLING)


def _dangles(n: int) -> str:
    cut = f"array_to_string(string_split(text, ' ')[1:{n}], ' ')"
    return f"coalesce(list_contains([{_DANGLE}], regexp_extract_all(lower({cut}), '[a-z0-9'']+')[-1]) AND NOT regexp_matches(trim({cut}), '^[A-Z]$'), false) AS after_{n}"


ORACLES = {
    "cue_normal_form": f"""WITH {_C} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, -idx) - 1 AS idx, s AS start_ms, md5(text) AS digest FROM c WHERE idx % 4 <> 3 AND trim(text) <> ''""",
    "word_level": f"""WITH {_C}, t AS (SELECT doc_id, trim(CASE WHEN CAST(doc_id AS BIGINT) % 2 = 0 THEN string_split(trim(text), ' ')[1] ELSE text END) AS x FROM c),
k AS (SELECT doc_id, count(*) AS cues, count(*) FILTER (CASE WHEN {_MAINLY('x')} THEN length(x) <= 2 ELSE len({_WORDS.format('x')}) = 1 END) AS single FROM t GROUP BY 1)
SELECT *, single >= 0.8 * cues AS word_level FROM k""",
    "language_codes": """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'en' WHEN 2 THEN 'zh' WHEN 3 THEN '' ELSE lang END AS code FROM documents""",
    "clipped_to_media": f"WITH {_C} SELECT doc_id, idx, s AS start_ms, least(e, 7000) AS end_ms FROM c WHERE s < 7000 AND least(e, 7000) > s",
    "display_marks": rf"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text || '，字幕3.5,x.y、 。' ELSE ' ' || text || '。，' END AS x FROM conversations),
k AS (SELECT *, regexp_replace(x, '[，。]', ' ', 'g') AS p FROM t),
q AS (SELECT *, regexp_replace(regexp_replace(p, '([A-Za-z0-9])([,.])([A-Za-z0-9])', '\1' || chr(1) || '\2\3', 'g'), '([A-Za-z0-9])([,.])([A-Za-z0-9])', '\1' || chr(1) || '\2\3', 'g') AS m FROM k),
r AS (SELECT *, CASE WHEN regexp_matches(x, '{_HAN}') THEN replace(replace(regexp_replace(replace(replace(m, chr(1) || ',', chr(2)), chr(1) || '.', chr(3)), '[,.]', ' ', 'g'), chr(2), ','), chr(3), '.') ELSE p END AS y FROM q)
SELECT conv_id, turn, md5(regexp_replace(trim(x), '[，。]+$', '')) AS trimmed, md5(trim(regexp_replace(regexp_replace(y, '、+[ \t]*$', ''), '[ \t]{{2,}}', ' ', 'g'))) AS spaced FROM r""",
    "dangling_tails": f"SELECT doc_id, {', '.join(map(_dangles, (1, 5, 20)))} FROM documents",
    "output_checks": rf"""WITH k AS (SELECT *, (conv_id + turn) % 4 AS k FROM conversations), o AS (SELECT conv_id, turn, CASE WHEN k = 3 THEN 'www.example.com/about' ELSE text END AS src,
  CASE k WHEN 0 THEN text WHEN 1 THEN text || ' !!' WHEN 2 THEN '字幕' ELSE 'www.example.com/about' END AS out FROM k)
SELECT conv_id, turn, length({_BARE.format('out')}) >= 4 AND {_BARE.format('out')} = {_BARE.format('src')} AS source_copy,
  NOT regexp_matches(out, '{_HAN}') AND regexp_matches(src, '\p{{L}}') AND src <> 'www.example.com/about' AS untranslated FROM o""",
    "time_gap_groups": f"""WITH {TURNS_SQL}, m AS (SELECT *, lag(end_ms) OVER w AS pe, lag(event_type) OVER w AS pt FROM turns WINDOW w AS (PARTITION BY user_id ORDER BY start_ms, event_id)),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR start_ms - pe > 36000000 OR coalesce(pt <> event_type, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start_ms, event_id ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT user_id, CAST(g AS BIGINT) AS "group", min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS members FROM g GROUP BY user_id, g""",
    "long_groups_cut": f"""WITH {TURNS_SQL}, m AS (SELECT *, lag(end_ms) OVER w AS pe FROM turns WINDOW w AS (PARTITION BY user_id ORDER BY start_ms, event_id)),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR start_ms - pe > 86400000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start_ms, event_id ROWS UNBOUNDED PRECEDING) AS g FROM m),
p AS (SELECT *, (row_number() OVER (PARTITION BY user_id, g ORDER BY start_ms, event_id) - 1) * ((count(*) OVER (PARTITION BY user_id, g) + 2) // 3) // count(*) OVER (PARTITION BY user_id, g) AS part FROM g)
SELECT user_id, CAST(g AS BIGINT) AS "group", CAST(part AS BIGINT) AS part, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS members FROM p GROUP BY user_id, g, part""",
    "label_changes": f"""WITH {_C}, a AS (SELECT *, CASE WHEN idx % 3 = 1 THEN 'other' ELSE role END AS sp FROM c WHERE NOT (CAST(doc_id AS BIGINT) % 7 = 0 AND EXISTS (SELECT 1 FROM c d WHERE d.doc_id = c.doc_id AND d.idx = 0))),
w AS (SELECT *, string_agg(text, ' ') OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS ctx FROM a)
SELECT doc_id, idx, s AS start_ms, coalesce(role, 'unassigned') AS "from", coalesce(sp, 'unassigned') AS "to", md5(ctx) AS context FROM w WHERE role IS DISTINCT FROM sp""",
    "gold_comparison": f"""WITH {_C}, m AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS p FROM c),
g AS (SELECT doc_id, CASE WHEN idx % 3 = 2 THEN text || '!' ELSE text END AS gt, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS p FROM c WHERE NOT (CAST(doc_id AS BIGINT) % 5 = 0 AND idx = 0)),
j AS (SELECT coalesce(m.doc_id, g.doc_id) AS doc_id, coalesce(m.p, g.p) AS p, text, gt, m.p IS NOT NULL AS im, g.p IS NOT NULL AS ig FROM m FULL JOIN g ON m.doc_id = g.doc_id AND m.p = g.p),
k AS (SELECT doc_id, count(*) FILTER (im) AS n, count(*) FILTER (im) = count(*) FILTER (ig) AS comparable, string_agg(CASE WHEN text IS DISTINCT FROM gt THEN p END, ',' ORDER BY p) AS ch, count(*) FILTER (text IS DISTINCT FROM gt) AS x FROM j GROUP BY 1)
SELECT doc_id, comparable, CASE WHEN comparable THEN coalesce(ch, '') ELSE '' END AS changed_cues, CASE WHEN comparable THEN round(x / n, 4) END AS changed_rate, CASE WHEN comparable THEN round(1 - x / n, 4) END AS exact_match_rate FROM k""",
    "spoken_words": """SELECT conv_id, CASE WHEN turn % 5 = 4 OR role IS NULL THEN 'unassigned' ELSE role END AS speaker, CAST(sum(greatest(1, len(regexp_extract_all(text, '[A-Za-z0-9'']+')))) AS BIGINT) AS words FROM conversations GROUP BY ALL""",
    "simultaneous_speech": f"""WITH {SIDES_SQL}, q AS (SELECT l.user_id, l.event_id, r.speaker FROM l JOIN r ON l.user_id = r.user_id AND (start_ms + end_ms) // 2 >= rs AND (start_ms + end_ms) // 2 < re + 3600000)
SELECT user_id, event_id, count(DISTINCT speaker) AS speakers FROM q GROUP BY ALL HAVING count(DISTINCT speaker) > 1""",
    "resegmented": f"""WITH {_C}, t AS (SELECT *, trim(text) AS x, CASE WHEN idx % 4 = 1 THEN 1 ELSE greatest(1, CAST(ceil(length(trim(text)) / CASE WHEN {_MAINLY('trim(text)')} THEN 25.0 ELSE 70.0 END) AS BIGINT)) END AS parts FROM c),
w AS (SELECT *, {_WORDS.format('x')} AS ws FROM t), u AS (SELECT *, unnest(ws) AS w, generate_subscripts(ws, 1) AS j FROM w),
p AS (SELECT *, sum(length(w) + 1) OVER (PARTITION BY doc_id, idx ORDER BY j) - length(w) - 1 AS pos FROM u),
k AS (SELECT *, CAST(floor((pos + length(w) / 2) * parts / greatest(1, length(x))) AS BIGINT) AS part FROM p),
h AS (SELECT *, CASE WHEN parts = 1 THEN 0 ELSE part END AS q FROM k WHERE parts = 1 OR part < parts),
g AS (SELECT doc_id, idx, s, e, parts, q AS part, CASE WHEN parts = 1 THEN any_value(text) ELSE string_agg(w, ' ' ORDER BY j) END AS out FROM h GROUP BY doc_id, idx, s, e, parts, q)
SELECT doc_id, idx, part, CAST(floor(s + part * ((e - s) / parts)) AS BIGINT) AS start_ms, CAST(floor(s + (part + 1) * ((e - s) / parts)) AS BIGINT) AS end_ms, md5(out) AS digest FROM g
UNION ALL SELECT doc_id, idx, 0, s, e, md5(text) FROM t WHERE len({_WORDS.format('x')}) = 0 AND text <> ''""",
    "vad_sweep": f"""WITH {TURNS_SQL}, f AS (SELECT * FROM turns WHERE end_ms > start_ms), g(silence_ms, least_ms, pad_ms) AS (VALUES {_GRID}),
m AS (SELECT user_id, g.*, start_ms, end_ms, max(end_ms) OVER (PARTITION BY user_id, silence_ms, least_ms, pad_ms ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f, g),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms - reach >= silence_ms THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, silence_ms, least_ms, pad_ms ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS r FROM m),
r AS (SELECT user_id, silence_ms, least_ms, pad_ms, min(start_ms) AS s, max(end_ms) AS e FROM n GROUP BY user_id, silence_ms, least_ms, pad_ms, r HAVING max(end_ms) - min(start_ms) >= least_ms),
t AS (SELECT user_id, max(end_ms) - min(start_ms) AS total FROM f GROUP BY 1),
k AS (SELECT user_id, silence_ms, least_ms, pad_ms, count(*) AS ranges, CAST(sum(e - s + 2 * pad_ms) AS BIGINT) AS covered_ms FROM r GROUP BY ALL)
SELECT k.*, round(100 * least(1.0, covered_ms / total), 6) AS coverage_pct, round((ranges - 1) * 60000 / total, 6) AS gaps_a_minute FROM k JOIN t USING (user_id)""",
    "disagreement_windows": f"""WITH {TURNS_SQL}, b AS (SELECT user_id, event_id, start_ms, end_ms, event_id % 3 = 0 AND event_type IS DISTINCT FROM 'other' AS d, unnest(range(start_ms // 7200000, (end_ms - 1) // 7200000 + 1)) AS "window" FROM turns WHERE end_ms > start_ms),
s AS (SELECT *, least(end_ms, ("window" + 1) * 7200000) - greatest(start_ms, "window" * 7200000) AS ms FROM b),
a AS (SELECT user_id, "window", CAST(sum(ms) AS BIGINT) AS labelled_ms, CAST(sum(CASE WHEN d THEN ms ELSE 0 END) AS BIGINT) AS differing_ms FROM s GROUP BY ALL),
k AS (SELECT *, round(differing_ms / labelled_ms, 6) AS share FROM a WHERE differing_ms > 0)
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY share DESC, differing_ms DESC, "window") AS rank FROM k QUALIFY rank <= 5""",
    "merged_snapshots": f"""WITH {_R}, t AS (SELECT model, group_id, count(*) AS n, min(stage) AS lo, max(stage) AS hi, {', '.join(f'sum({c}) AS {c}' for c in ('duration_ms', 'tokens', 'prompt_tokens', 'cached_tokens'))} FROM r GROUP BY ALL)
SELECT model, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('duration_ms', 'tokens', 'prompt_tokens', 'cached_tokens'))}, count(*) AS tasks, count(*) FILTER (n > 1) AS repeated_tasks, CASE WHEN min(lo) = max(hi) THEN min(lo) ELSE 'mixed' END AS stage FROM t GROUP BY model""",
    "attempt_counts": f"""WITH {_R}, a AS (SELECT model, group_id, tokens > 40 AS bad, coalesce(lag(tokens > 40) OVER (PARTITION BY model, group_id ORDER BY seq, tokens, duration_ms), false) AS again FROM r),
t AS (SELECT model, group_id, count(*) AS n, count(*) FILTER (again) AS retries, count(*) FILTER (bad) AS failures FROM a GROUP BY ALL)
SELECT model, count(*) AS tasks, CAST(sum(n) AS BIGINT) AS attempts, CAST(sum(retries) AS BIGINT) AS retries, CAST(sum(failures) AS BIGINT) AS failures, count(*) FILTER (failures = n) AS lost_tasks, max(n) AS most_attempts FROM t GROUP BY model""",
    "mention_contexts": f"""WITH {_C}, t AS (SELECT doc_id, idx, CASE WHEN idx % 3 <> 0 THEN 'AB-' || (idx % 2) || '7 ' || text ELSE text END AS x FROM c),
w AS (SELECT *, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS ctx FROM t),
m AS (SELECT doc_id, idx, ctx, lower(unnest(regexp_extract_all(x, '{_ID}'))) AS mention FROM w)
SELECT doc_id, mention, count(*) AS n, min(idx) AS first_at, md5(arg_min(ctx, idx)) AS context FROM m GROUP BY doc_id, mention HAVING count(*) >= 2""",
    "manifest_problems": """WITH s AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN 's' || (c_custkey % 21) ELSE c_name END AS id, lower(c_mktsegment) AS split,
  CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'src' || CASE WHEN c_custkey % 13 = 0 THEN c_custkey % 26 ELSE c_custkey END END AS src FROM customer)
SELECT DISTINCT id AS sample_id, 'unknown split' AS problem FROM s WHERE split NOT IN ('building', 'machinery', 'household')
UNION SELECT id, 'no source_path' FROM s WHERE src = '' UNION SELECT id, 'repeated id' FROM s GROUP BY id HAVING count(*) > 1
UNION SELECT id, 'shared file' FROM s WHERE src <> '' AND src IN (SELECT src FROM s GROUP BY src HAVING count(DISTINCT id) > 1)""",
    "log_entries": """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events WHERE event_id % 9 <> 0 AND json_valid(props)""",
}
