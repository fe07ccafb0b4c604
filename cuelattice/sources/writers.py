"""Writers of cues: SRT, WebVTT, ASS, text, JSON and RTTM, one rendered file a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelattice.functions import text as tx
from cuelattice.operators.folds import monotone, per_document

LAYOUTS = ("original_on_top", "translation_on_top", "only_original", "only_translation")
ASS_HEAD = (
    "[Script Info]\nScriptType: v4.00+\nPlayResX: 1920\nPlayResY: 1080\n\n[V4+ Styles]\n"
    "Format: Name, Fontname, Fontsize, PrimaryColour, Alignment\nStyle: Default,Arial,54,&H00FFFFFF,2\nStyle: Secondary,Arial,40,&H00FFFFFF,2\n\n"
    "[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
)


def shown(layout: str) -> Column:
    """A cue's text in a layout; a missing translation leaves the original."""
    original, other = F.coalesce("text", F.lit("")), F.coalesce("translated", F.lit(""))
    if layout == "only_original":
        return original
    if layout == "only_translation":
        return F.when(other != "", other).otherwise(original)
    pair = (original, other) if layout == "original_on_top" else (other, original)
    return F.when(other != "", F.concat(pair[0], F.lit("\n"), pair[1])).otherwise(original)


def with_speaker(text: Column, style: str) -> Column:
    """Every line with the speaker's label, with a dash, or as it is."""
    if style == "none":
        return text
    has = F.coalesce("speaker", F.lit("")) != ""
    label = F.concat(F.lit("["), F.col("speaker"), F.lit("] "))
    dashed = lambda line: F.when((F.trim(line) == "") | F.ltrim(line).startswith("- "), line).otherwise(F.concat(F.lit("- "), line))
    labelled = lambda line: F.when(has & (F.trim(line) != ""), F.concat(label, line)).otherwise(line)
    return F.array_join(F.transform(F.split(text, "\n"), dashed if style == "dash" else labelled), "\n")


def joined(df: DataFrame, part: Column, between: str, head: str = "", tail: str = "\n") -> DataFrame:
    """(doc_id, content): each document's parts in the order of idx."""
    listed = F.array_sort(F.collect_list(F.struct("idx", part.alias("part"))))
    body = F.array_join(F.transform(listed, lambda x: x["part"]), between)
    return df.groupBy("doc_id").agg(F.concat(F.lit(head), body, F.lit(tail)).alias("content"))


def ranked(cues: DataFrame) -> DataFrame:
    from pyspark.sql.window import Window

    return cues.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("idx")))


def to_srt(cues: DataFrame, layout: str = "original_on_top", speakers: str = "label") -> DataFrame:
    times = F.concat(tx.clock(F.col("start_ms")), F.lit(" --> "), tx.clock(F.col("end_ms")))
    return joined(ranked(cues), F.concat_ws("\n", F.col("n").cast("string"), times, with_speaker(shown(layout), speakers)), "\n\n")


def to_vtt(cues: DataFrame, layout: str = "translation_on_top") -> DataFrame:
    times = F.concat(tx.clock(F.col("start_ms"), "."), F.lit(" --> "), tx.clock(F.col("end_ms"), "."))
    return joined(ranked(cues), F.concat_ws("\n", F.col("n").cast("string"), times, shown(layout)), "\n\n", "WEBVTT\n\n")


def to_txt(cues: DataFrame, layout: str = "original_on_top") -> DataFrame:
    return joined(cues, shown(layout), "\n")


def to_ass(cues: DataFrame, layout: str = "translation_on_top") -> DataFrame:
    """A row a cue, or two for both languages: the lower one in style Secondary."""
    upper = F.col("translated") if layout == "translation_on_top" else F.col("text")
    lower = F.col("text") if layout == "translation_on_top" else F.col("translated")
    row = lambda style, text: F.concat(F.lit("Dialogue: 0,"), tx.ass_clock(F.col("start_ms")), F.lit(","), tx.ass_clock(F.col("end_ms")), F.lit(f",{style},,0,0,0,,"), F.regexp_replace(text, "\n", r"\\N"))
    both = (F.coalesce("translated", F.lit("")) != "") & F.lit(not layout.startswith("only"))
    return joined(cues, F.when(both, F.concat(row("Secondary", lower), F.lit("\n"), row("Default", upper))).otherwise(row("Default", shown(layout))), "\n", ASS_HEAD)


def to_json(cues: DataFrame) -> DataFrame:
    """An object of cues numbered from 1."""
    cue = F.struct(F.col("start_ms").alias("start_time"), F.col("end_ms").alias("end_time"), F.coalesce("text", F.lit("")).alias("original_subtitle"), F.coalesce("translated", F.lit("")).alias("translated_subtitle"))
    listed = F.array_sort(F.collect_list(F.struct("n", cue.alias("cue"))))
    whole = F.map_from_entries(F.transform(listed, lambda x: F.struct(x["n"].cast("string"), x["cue"])))
    return ranked(cues).groupBy("doc_id").agg(F.to_json(whole).alias("content"))


def rttm_lines(turns: DataFrame) -> DataFrame:
    """(recording_id, value): SPEAKER rows in order of recording, start and end."""
    seconds = lambda c: F.format_string("%.3f", c / 1000)
    value = F.concat(F.lit("SPEAKER "), F.col("recording_id"), F.lit(" 1 "), seconds(F.col("start_ms")), F.lit(" "), seconds(F.col("end_ms") - F.col("start_ms")), F.lit(" <NA> <NA> "), F.col("speaker"), F.lit(" <NA> <NA>"))
    return turns.orderBy("recording_id", "start_ms", "end_ms").select("recording_id", value.alias("value"))


FORMATS = {"srt": to_srt, "vtt": to_vtt, "txt": to_txt, "ass": to_ass, "json": to_json}


def save(cues: DataFrame, path: str, extension: str, **options: str) -> None:
    """One folder a document, its rendered file inside; cues that overlap are cut apart before."""
    FORMATS[extension](per_document(cues, monotone, ("translated", "speaker")), **options).write.partitionBy("doc_id").text(path)
