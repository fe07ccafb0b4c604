"""Queries of the text functions over ``documents``, ``conversations``, ``pages`` and ``events``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelattice.functions import text as tx
from cuelattice.operators.intervals import epoch_ms
from cuelattice.session import table

def col() -> Column:
    return F.col("text")


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.word_count(col()).cast("long").alias("words"), tx.reading_units(col()).cast("long").alias("units"))


def script_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(tx.scripts(col()), ",").alias("scripts"), tx.mainly_unspaced(col()).alias("unspaced"), tx.only_punctuation(col()).alias("only_punctuation"))


def token_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.size(tx.tokens(col())).cast("long").alias("n_tokens"), F.size(F.array_distinct(tx.tokens(col()))).cast("long").alias("n_distinct"),
        F.size(tx.numbers(col())).cast("long").alias("n_numbers"), F.size(tx.identifiers(col())).cast("long").alias("n_identifiers"),
        tx.ends_sentence(col()).alias("ends_sentence"),
    )


def note_and_leak_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.is_note(col()).alias("note"), tx.has_leak(col()).alias("leak"))


def filler_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as cues of 40 ms a character: those that survive the filler filter."""
    c = table(spark, sf_dir, "conversations").withColumn("ms", F.length("text") * 40)
    return c.where(~tx.is_filler(col(), F.col("ms"))).select("conv_id", "turn", F.col("ms").cast("long").alias("ms"))


def markup_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = tx.strip_markup(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(plain).cast("long").alias("n_chars"), F.md5(plain).alias("digest"))


def timestamp_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = epoch_ms(F.col("ts")) % 400_000_000
    return table(spark, sf_dir, "events").select("event_id", tx.clock(ms).alias("srt"), tx.clock(ms, ".").alias("vtt"), tx.ass_clock(ms).alias("ass"))


def timestamp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered times read back, and some that are no times."""
    r = timestamp_render(spark, sf_dir)
    odd = F.concat(F.lit("99:"), F.substring("srt", 4, 9))
    return r.select("event_id", tx.parse_clock(F.col("srt")).alias("from_srt"), tx.parse_clock(F.col("ass")).alias("from_ass"), tx.parse_clock(F.substring("vtt", 4, 9)).alias("short"), tx.parse_clock(F.concat(F.lit("7:"), odd)).alias("bad"))


def run_lengths(items: Column) -> Column:
    """Longest run of equal items, all in the row."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"].eqNullSafe(x), acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    return F.aggregate(items, start, step, lambda acc: acc["most"])


def severe_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with 12 tokens or more of which 8 in a row are equal, or 12 and 60 % in all; nothing is shuffled."""
    words = table(spark, sf_dir, "documents").select("doc_id", tx.tokens(col()).alias("t")).where(F.size("t") > 0)
    doc = words.select(
        "doc_id", run_lengths(F.col("t")).cast("long").alias("longest_run"), run_lengths(F.array_sort("t")).cast("long").alias("peak"), F.size("t").cast("long").alias("n_tokens"),
    )
    severe = (F.col("n_tokens") >= 12) & ((F.col("longest_run") >= 8) | ((F.col("peak") >= 12) & (F.col("peak") >= 0.6 * F.col("n_tokens"))))
    return doc.withColumn("severe", severe)


def word_explode_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each turn with times in proportion to their length, a unit for each four characters begun."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(tx.pieces(col())).alias("i", "word"))
    units = words.withColumn("units", F.ceil(F.length("word") / 4))
    turn = Window.partitionBy("conv_id", "turn")
    each = F.floor(F.lit(10_000) * F.col("units") / F.sum("units").over(turn))
    timed = units.withColumn("ms", each)
    upto = turn.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return timed.select("conv_id", "turn", F.col("i").cast("long").alias("i"), "word", (F.sum("ms").over(upto) - F.col("ms")).alias("start_ms"), F.sum("ms").over(upto).alias("end_ms"))


def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers that a document names twice or more, regardless of case, in the form met first."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.identifiers(col())).alias("i", "form"))
    grouped = found.groupBy("doc_id", F.lower("form").alias("mention")).agg(F.min_by("form", "i").alias("form"), F.count(F.lit(1)).alias("n"))
    return grouped.where("n >= 2")


def unique_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-token runs that occur once in a document, counted; nothing is shuffled."""
    t = table(spark, sf_dir, "documents").select("doc_id", tx.tokens(col()).alias("t")).where(F.size("t") >= 3)
    runs = F.transform(F.sequence(F.lit(0), F.size("t") - 3), lambda i: F.concat_ws(" ", F.get("t", i), F.get("t", i + 1), F.get("t", i + 2)))
    ordered = t.select("doc_id", F.array_sort(runs).alias("r"))
    alone = F.filter("r", lambda x, i: ~F.coalesce(F.get("r", i - 1) == x, F.lit(False)) & ~F.coalesce(F.get("r", i + 1) == x, F.lit(False)))
    return ordered.select("doc_id", F.size(alone).cast("long").alias("unique_runs"), F.size(F.array_distinct("r")).cast("long").alias("distinct_runs"))


QUERIES = {
    f.__name__: f
    for f in (
        word_count, script_flags, token_features, note_and_leak_flags, filler_filter, markup_strip, timestamp_render, timestamp_parse,
        severe_repetition, word_explode_timing, entity_mentions, unique_anchors,
    )
}

_SPLIT = r"list_filter(string_split_regex({}, '[ \t\n\r\f\v]+'), lambda x: x <> '')"
_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_STRIP = r"trim(regexp_replace(regexp_replace(html, '<[^<>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))"
_MS = "((epoch_us(ts) // 1000) % 400000000)"
_CLOCK = "lpad(CAST(ms // 3600000 AS VARCHAR), CAST(greatest(2, length(CAST(ms // 3600000 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0')"
_ASS = "CAST(ms // 3600000 AS VARCHAR) || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms % 1000 // 10 AS VARCHAR), 2, '0')"
_SCRIPTS = "concat_ws(','," + ",".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in tx.SCRIPTS.items()) + ")"
_FILLERS = ", ".join(f"'{f}'" for f in tx.FILLERS)
_BARE = "trim(lower(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', '', 'g')), '" + tx.AROUND.replace("'", "''") + "')"
_ANY = lambda f, xs: "(" + " OR ".join(f"{f}(bare, '{x}')" for x in xs) + ")"
NOTE_SQL = f"(bare IN ({', '.join(repr(x) for x in ('', *tx.NOTES))}) OR {_ANY('starts_with', tx.HELD_THERE)} AND {_ANY('suffix', tx.CUE_BEFORE)} OR {_ANY('starts_with', tx.CUE_BEFORE)} AND {_ANY('suffix', tx.HELD_THERE)})"
_SPACED = f"regexp_replace(text, '{tx.UNSPACED}', ' ', 'g')"

ORACLES = {
    "word_count": f"""SELECT doc_id, CAST(len(regexp_extract_all(text, '{tx.UNSPACED}')) + len({_SPLIT.format(_SPACED)}) AS BIGINT) AS words,
  CAST(len(regexp_extract_all(text, '{tx.UNSPACED}')) + len(list_filter({_SPLIT.format(_SPACED)}, lambda x: regexp_matches(x, '{tx.WORDY}'))) AS BIGINT) AS units FROM documents""",
    "script_flags": f"""SELECT doc_id, {_SCRIPTS} AS scripts,
  length(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', '', 'g')) > 0 AND len(regexp_extract_all(text, '{tx.UNSPACED}')) > 0.5 * length(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', '', 'g')) AS unspaced,
  NOT regexp_matches(text, '{tx.WORDY}') AS only_punctuation FROM documents""",
    "token_features": rf"""SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({_TOKENS})) AS BIGINT) AS n_distinct,
  CAST(len(regexp_extract_all(text, '{tx.NUMBER}')) AS BIGINT) AS n_numbers, CAST(len(regexp_extract_all(text, '{tx.IDENTIFIER}')) AS BIGINT) AS n_identifiers,
  regexp_matches(trim(text), '[.!?。！？]["''”’)\]]*$') AND NOT regexp_matches(trim(text), '(\.\.|…)["''”’)\]]*$') AS ends_sentence FROM documents""",
    "note_and_leak_flags": f"""WITH c AS (SELECT conv_id, turn, {_BARE} AS bare, regexp_replace(lower(text), '[ \\t\\r\\n]+', '', 'g') AS low FROM conversations)
SELECT conv_id, turn, {NOTE_SQL} AS note, {' OR '.join(f"contains(low, '{x}')" for x in tx.LEAKS)} AS leak FROM c""",
    "filler_filter": rf"""WITH c AS (SELECT *, length(text) * 40 AS ms, regexp_replace(lower(trim(text)), '[.,!?。，！？]+$', '') AS bare FROM conversations)
SELECT conv_id, turn, CAST(ms AS BIGINT) AS ms FROM c WHERE NOT (ms < 500 AND (length(bare) < 3 OR bare IN ({_FILLERS})))""",
    "markup_strip": f"SELECT page_id, CAST(length({_STRIP}) AS BIGINT) AS n_chars, md5({_STRIP}) AS digest FROM pages",
    "timestamp_render": f"""WITH e AS (SELECT event_id, {_MS} AS ms FROM events)
SELECT event_id, {_CLOCK} || ',' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS srt, {_CLOCK} || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS vtt, {_ASS} AS ass FROM e""",
    "timestamp_parse": f"""WITH e AS (SELECT event_id, {_MS} AS ms FROM events), r AS (SELECT *, {_CLOCK} || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS vtt FROM e),
s AS (SELECT *, substr(vtt, 4, 9) AS sh FROM r)
SELECT event_id, ms AS from_srt, ms // 10 * 10 AS from_ass,
  CASE WHEN regexp_matches(sh, '^[0-9]{{2}}:[0-9]{{2}}\\.[0-9]{{3}}$') THEN CAST(substr(sh, 1, 2) AS BIGINT) * 60000 + CAST(substr(sh, 4, 2) AS BIGINT) * 1000 + CAST(substr(sh, 7, 3) AS BIGINT) END AS short,
  CAST(NULL AS BIGINT) AS bad FROM s""",
    "severe_repetition": f"""WITH w AS (SELECT doc_id, unnest({_TOKENS}) AS w, generate_subscripts({_TOKENS}, 1) AS i FROM documents),
r AS (SELECT doc_id, w, i - row_number() OVER (PARTITION BY doc_id, w ORDER BY i) AS island FROM w),
k AS (SELECT doc_id, w, island, count(*) AS run FROM r GROUP BY ALL),
p AS (SELECT doc_id, w, max(run) AS run, sum(run) AS n FROM k GROUP BY ALL),
d AS (SELECT doc_id, max(run) AS longest_run, CAST(max(n) AS BIGINT) AS peak, CAST(sum(n) AS BIGINT) AS n_tokens FROM p GROUP BY doc_id)
SELECT *, n_tokens >= 12 AND (longest_run >= 8 OR (peak >= 12 AND peak >= 0.6 * n_tokens)) AS severe FROM d""",
    "word_explode_timing": f"""WITH w AS (SELECT conv_id, turn, unnest({_SPLIT.format('text')}) AS word, generate_subscripts({_SPLIT.format('text')}, 1) - 1 AS i FROM conversations),
u AS (SELECT *, (length(word) + 3) // 4 AS units FROM w),
m AS (SELECT *, 10000 * units // CAST(sum(units) OVER (PARTITION BY conv_id, turn) AS BIGINT) AS ms FROM u)
SELECT conv_id, turn, CAST(i AS BIGINT) AS i, word, CAST(sum(ms) OVER x - ms AS BIGINT) AS start_ms, CAST(sum(ms) OVER x AS BIGINT) AS end_ms FROM m WINDOW x AS (PARTITION BY conv_id, turn ORDER BY i ROWS UNBOUNDED PRECEDING)""",
    "entity_mentions": f"""WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '{tx.IDENTIFIER}')) AS form, generate_subscripts(regexp_extract_all(text, '{tx.IDENTIFIER}'), 1) AS i FROM documents)
SELECT doc_id, lower(form) AS mention, arg_min(form, i) AS form, count(*) AS n FROM e GROUP BY doc_id, lower(form) HAVING count(*) >= 2""",
    "unique_anchors": f"""WITH t AS (SELECT doc_id, {_TOKENS} AS t FROM documents), g AS (SELECT doc_id, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] AS g FROM t, unnest(range(1, len(t) - 1)) x(i) WHERE len(t) >= 3),
c AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY ALL)
SELECT doc_id, count(*) FILTER (n = 1) AS unique_runs, count(*) AS distinct_runs FROM c GROUP BY doc_id""",
}
