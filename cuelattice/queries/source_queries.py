"""Readers and writers: conversations rendered as subtitle files, and what comes back when these are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.queries.interval_queries import TURNS_SQL, turns
from cuelattice.session import table
from cuelattice.sources import subtitles as sub
from cuelattice.sources import writers as wr


def shown_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as cues of up to two seconds; every third has two lines, every fourth a translation."""
    text = F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "<>{}[]\\", ""), r"[ \t\r\n]+", " "))
    start = F.col("turn").cast("long") * 3000
    c = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("long").alias("idx"), start.alias("start_ms"),
        (start + F.least(F.lit(2000), F.length(text) * 40 + 100)).alias("end_ms"), text.alias("text"), F.col("role").alias("speaker"),
    ).where("text <> ''")
    return c.withColumns({
        "text": F.when(F.col("idx") % 3 == 2, F.concat("text", F.lit("\nand a line"))).otherwise(F.col("text")),
        "translated": F.when(F.col("idx") % 4 == 0, F.concat(F.lit("字幕"), F.col("idx"))),
    })


def read_back(cues: DataFrame) -> DataFrame:
    return cues.select("doc_id", "idx", "start_ms", "end_ms", F.md5("text").alias("text"), F.coalesce("translated", F.lit("")).alias("translated"), F.coalesce("speaker", F.lit("")).alias("speaker"))


def round_trip(extension: str, **options: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read_back(sub.PARSERS[extension](wr.FORMATS[extension](shown_cues(spark, sf_dir), **options)))

    return query


def rendered(extension: str, **options: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return wr.FORMATS[extension](shown_cues(spark, sf_dir), **options).select("doc_id", F.md5("content").alias("digest"))

    return query


def rttm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).where("end_ms > start_ms AND event_type IS NOT NULL")
    named = t.select(F.concat(F.lit("rec"), "user_id").alias("recording_id"), (F.col("start_ms") % 100_000_000).alias("start_ms"), (F.col("start_ms") % 100_000_000 + F.col("end_ms") - F.col("start_ms")).alias("end_ms"), F.col("event_type").alias("speaker"))
    return sub.parse_rttm(wr.rttm_lines(named))


QUERIES = {
    "srt_round_trip": round_trip("srt"), "vtt_round_trip": round_trip("vtt", layout="original_on_top"), "ass_round_trip": round_trip("ass"), "json_round_trip": round_trip("json"),
    "rttm_round_trip": rttm_round_trip, "srt_text": rendered("srt"), "srt_dashes": rendered("srt", layout="only_original", speakers="dash"), "vtt_text": rendered("vtt"),
    "txt_text": rendered("txt", layout="translation_on_top"), "ass_text": rendered("ass"),
}

_S = r"""b AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn AS BIGINT) AS idx, turn * 3000 AS s, role AS sp, trim(regexp_replace(translate(coalesce(text, ''), '<>{}[]\', ''), '[ \t\r\n]+', ' ', 'g')) AS t FROM conversations),
c AS (SELECT doc_id, idx, sp, s, s + least(2000, length(t) * 40 + 100) AS e, CASE WHEN idx % 3 = 2 THEN t || chr(10) || 'and a line' ELSE t END AS t, CASE WHEN idx % 4 = 0 THEN '字幕' || idx ELSE '' END AS tr FROM b WHERE t <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM c)"""
_BACK = "SELECT doc_id, n - 1 AS idx, CAST(s AS BIGINT) AS start_ms, CAST(e AS BIGINT) AS end_ms, md5(t) AS text, tr AS translated, {} AS speaker FROM n"
_TIME = lambda x, m: f"(lpad(CAST({x} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({x} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({x} // 1000 % 60 AS VARCHAR), 2, '0') || '{m}' || lpad(CAST({x} % 1000 AS VARCHAR), 3, '0'))"
_ASS = lambda x: f"(CAST({x} // 3600000 AS VARCHAR) || ':' || lpad(CAST({x} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({x} // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST({x} % 1000 // 10 AS VARCHAR), 2, '0'))"
_BLOCK = lambda m, body: f"n || chr(10) || {_TIME('s', m)} || ' --> ' || {_TIME('e', m)} || chr(10) || {body}"
_ALL = lambda part, between, head="''": f"WITH {_S}, p AS (SELECT doc_id, idx, {part} AS part FROM n) SELECT doc_id, md5({head} || string_agg(part, {between} ORDER BY idx) || chr(10)) AS digest FROM p GROUP BY doc_id"
_UPPER = "CASE WHEN tr <> '' THEN t || chr(10) || tr ELSE t END"
_LOWER = "CASE WHEN tr <> '' THEN tr || chr(10) || t ELSE t END"
_LABELLED = f"CASE WHEN coalesce(sp, '') <> '' THEN '[' || sp || '] ' || replace({_UPPER}, chr(10), chr(10) || '[' || sp || '] ') ELSE {_UPPER} END"
_DASHED = "array_to_string(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN trim(x) = '' OR starts_with(ltrim(x), '- ') THEN x ELSE '- ' || x END), chr(10))"
_DIALOGUE = lambda style, body: f"'Dialogue: 0,' || {_ASS('s')} || ',' || {_ASS('e')} || ',{style},,0,0,0,,' || replace({body}, chr(10), '\\N')"
_HEAD = "'" + wr.ASS_HEAD.replace("'", "''") + "'"
ORACLES = {
    "srt_round_trip": f"WITH {_S} {_BACK.format('coalesce(sp, chr(39) || chr(39))')}",
    "vtt_round_trip": f"WITH {_S} {_BACK.format(chr(39) * 2)}",
    "ass_round_trip": f"WITH {_S} {_BACK.format(chr(39) * 2)}",
    "json_round_trip": f"WITH {_S} {_BACK.format(chr(39) * 2)}",
    "rttm_round_trip": f"""WITH {TURNS_SQL} SELECT 'rec' || user_id AS recording_id, start_ms % 100000000 AS start_ms, start_ms % 100000000 + end_ms - start_ms AS end_ms, event_type AS speaker FROM turns WHERE end_ms > start_ms AND event_type IS NOT NULL""",
    "srt_text": _ALL(_BLOCK(",", _LABELLED), "chr(10) || chr(10)"),
    "srt_dashes": _ALL(_BLOCK(",", _DASHED), "chr(10) || chr(10)"),
    "vtt_text": _ALL(_BLOCK(".", _LOWER), "chr(10) || chr(10)", "'WEBVTT' || chr(10) || chr(10)"),
    "txt_text": _ALL(_LOWER, "chr(10)"),
    "ass_text": _ALL(f"CASE WHEN tr <> '' THEN {_DIALOGUE('Secondary', 't')} || chr(10) || {_DIALOGUE('Default', 'tr')} ELSE {_DIALOGUE('Default', 't')} END", "chr(10)", _HEAD),
}
