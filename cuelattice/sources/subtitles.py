"""Readers of timed text: SRT, WebVTT, ASS, JSON and RTTM as rows of cues.

All take a frame with one file a row (``doc_id``, ``content``) and give ``doc_id, idx, start_ms, end_ms, text,
translated, speaker``, with ``idx`` in file order. Blocks without a valid time line are left out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelattice.functions import text as tx

TIME = r"(?:[0-9]+:)?[0-5]?[0-9]:[0-5]?[0-9][.,][0-9]{1,3}"
CUE_LINE = rf"^\s*({TIME})\s*-->\s*({TIME})"
SPEAKER = r"^\[([^\[\]\n]{1,40})\]\s*"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` as (doc_id, extension, content): UTF-8 with or without its mark, else GBK."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    as_utf8 = F.col("content").cast("string")
    text = F.coalesce(as_utf8_or_null(as_utf8), gbk(F.when(as_utf8_or_null(as_utf8).isNull(), F.col("content"))))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return raw.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("extension"), F.regexp_replace(text, "^﻿", "").alias("content"))


def as_utf8_or_null(text: Column) -> Column:
    return F.when(F.is_valid_utf8(text), text)


def gbk(content: Column) -> Column:
    """Content decoded as GBK, which Spark's own decoder leaves out."""

    @F.pandas_udf("string")
    def decoded(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else bytes(x).decode("gbk", "replace")).astype(object)

    return decoded(content)


def lines_of(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")


def bilingual(df: DataFrame, body: Column) -> DataFrame:
    """text, translated and speaker from a cue's lines: the second line is the translation if its script differs.

    The first line's label is taken off every line that has it.
    """
    speaker = F.regexp_extract(body, SPEAKER, 1)
    own = lambda x: F.when((speaker != "") & (F.regexp_extract(x, SPEAKER, 1) == speaker), F.regexp_replace(x, SPEAKER, "")).otherwise(x)
    rest = F.filter(F.transform(F.split(body, "\n"), own), lambda x: F.trim(x) != "")
    family = lambda x: F.when(x.rlike(tx.SCRIPTS["kana"]), "kana").when(x.rlike(tx.SCRIPTS["hangul"]), "hangul").when(x.rlike(tx.SCRIPTS["han"]), "han").otherwise("latin")
    first = F.get(rest, 0)
    same = F.filter(rest, lambda x: family(x) == family(first))
    other = F.filter(rest, lambda x: family(x) != family(first))
    return df.withColumns({
        "speaker": F.when(speaker != "", speaker), "text": F.array_join(same, "\n"),
        "translated": F.when(F.size(other) > 0, F.array_join(other, "\n")),
    })


def blocks(files: DataFrame) -> DataFrame:
    """Blank-line separated blocks with a time line: doc_id, at, start_ms, end_ms, body."""
    whole = F.split(F.regexp_replace("content", r"\r\n?", "\n"), r"\n[ \t]*\n\s*")
    each = files.select("doc_id", F.posexplode(whole).alias("at", "block"))
    lines = F.split(F.trim("block"), "\n")
    line = F.when(F.get(lines, 0).rlike(CUE_LINE), 0).when(F.get(lines, 1).rlike(CUE_LINE), 1)
    timed = each.withColumns({"lines": lines, "line": line}).where("line IS NOT NULL")
    stamp = lambda i: tx.parse_clock(F.regexp_extract(F.get("lines", F.col("line")), CUE_LINE, i))
    body = F.array_join(F.slice("lines", F.col("line") + 2, F.size("lines")), "\n")
    return timed.select("doc_id", "at", stamp(1).alias("start_ms"), stamp(2).alias("end_ms"), body.alias("body")).where("start_ms IS NOT NULL AND end_ms IS NOT NULL AND body <> ''")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)).cast("long") - 1
    return df.select("doc_id", idx.alias("idx"), "start_ms", "end_ms", "text", "translated", "speaker")


def parse_srt(files: DataFrame) -> DataFrame:
    cues = blocks(files)
    return numbered(bilingual(cues, F.col("body")), "at")


def parse_vtt(files: DataFrame) -> DataFrame:
    """As SRT, without tags; head, note and style blocks have no time line."""
    cues = blocks(files).withColumn("body", F.regexp_replace("body", r"<[^<>]*>", ""))
    return numbered(bilingual(cues.where("trim(body) <> ''"), F.col("body")), "at")


def parse_ass(files: DataFrame) -> DataFrame:
    """Dialogue rows; rows of two styles at the same times pair up, two by two, as text and translation."""
    rows = files.select("doc_id", F.posexplode(lines_of(F.col("content"))).alias("at", "line")).where(F.col("line").startswith("Dialogue:"))
    part = F.split(F.substring(F.col("line"), 10, 1 << 20), ",", 10)
    body = F.regexp_replace(F.regexp_replace(F.get(part, 9), r"\{[^{}]*\}", ""), r"\\[Nn]", "\n")
    cues = rows.select("doc_id", "at", tx.parse_clock(F.get(part, 1)).alias("start_ms"), tx.parse_clock(F.get(part, 2)).alias("end_ms"), F.trim(F.get(part, 3)).alias("style"), F.trim(body).alias("body")).where("start_ms IS NOT NULL AND end_ms IS NOT NULL AND body <> ''")
    order = Window.partitionBy("doc_id", "start_ms", "end_ms", "style").orderBy("at")
    paired = cues.withColumn("nth", F.row_number().over(order)).groupBy("doc_id", "start_ms", "end_ms", "nth").agg(
        F.min("at").alias("at"), F.max(F.when(F.col("style") != "Secondary", F.col("body"))).alias("main"), F.max(F.when(F.col("style") == "Secondary", F.col("body"))).alias("second")
    )
    alone = F.coalesce("main", "second")
    return numbered(paired.withColumns({"text": F.coalesce("second", "main"), "translated": F.when(F.col("second").isNotNull(), F.col("main")), "speaker": F.lit(None).cast("string")}).where(alone.isNotNull()), "at")


def parse_json(files: DataFrame) -> DataFrame:
    """An object of numbered cues, in order of their numbers."""
    cue = "struct<original_subtitle:string,translated_subtitle:string,start_time:long,end_time:long,speaker_id:string>"
    each = files.select("doc_id", F.explode(F.from_json("content", f"map<string,{cue}>")).alias("key", "c"))
    named = each.select("doc_id", F.col("key").try_cast("long").alias("at"), F.col("c.start_time").alias("start_ms"), F.col("c.end_time").alias("end_ms"), F.col("c.original_subtitle").alias("text"), F.when(F.col("c.translated_subtitle") != "", F.col("c.translated_subtitle")).alias("translated"), F.when(F.col("c.speaker_id") != "", F.col("c.speaker_id")).alias("speaker"))
    return numbered(named.where("at IS NOT NULL AND start_ms IS NOT NULL"), "at")


def parse_rttm(lines: DataFrame) -> DataFrame:
    """SPEAKER rows (column ``value``) as turns: recording_id, start_ms, end_ms, speaker."""
    p = F.split(F.trim("value"), r"\s+")
    ms = lambda i: F.bround(F.get(p, i).try_cast("double") * 1000).cast("long")
    turns = lines.where((F.get(p, 0) == "SPEAKER") & (F.size(p) >= 8))
    return turns.select(F.get(p, 1).alias("recording_id"), ms(3).alias("start_ms"), (ms(3) + ms(4)).alias("end_ms"), F.get(p, 7).alias("speaker")).where("end_ms > start_ms")


PARSERS = {"srt": parse_srt, "vtt": parse_vtt, "ass": parse_ass, "json": parse_json}


def read_cues(spark: SparkSession, path: str) -> DataFrame:
    """Cues of all subtitle files under ``path``, each by its extension."""
    files = read_files(spark, path)
    out = None
    for extension, parse in PARSERS.items():
        part = parse(files.where(F.col("extension") == extension))
        out = part if out is None else out.unionByName(part)
    return out
