"""Words with their times: WebVTT with inline time tags, and read cues told apart into words and sentences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelattice.operators.cues import word_level

CLOCK = r"([0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3})"
SPAN, TIMED = rf"^{CLOCK}\s*-->\s*{CLOCK}", rf"<{CLOCK}>([^<]*)"
#: A line with a marked word; plain lines of a block repeat the text of the block before.
MARKED = "(?s)<c>.*</c>"


def exact_ms(clock: Column) -> Column:
    """Milliseconds of HH:MM:SS.mmm; minutes and seconds above 59 count as they are."""
    at = lambda i, n: F.substring(clock, i, n).try_cast("long")
    return (at(1, 2) * 3600 + at(4, 2) * 60 + at(7, 2)) * 1000 + at(10, 3)


def parse_timed_vtt(files: DataFrame) -> DataFrame:
    """(doc_id, idx, start_ms, end_ms, text): the words of files (doc_id, content) with inline time tags.

    Blocks are parted by empty lines; a line of blanks is part of its block. Of a block that begins with its times, the
    first line with a marked word counts, so that rolling lines aren't read again. Its words last from
    their tag to the next, the first one from the block's start and the last one to its end; other tags end a word, and
    what stands between them and the next time is left out, as are tags without a word. Null and empty contents have no words.
    """
    content = F.regexp_replace("content", r"\r\n?", "\n")
    each = files.select("doc_id", F.posexplode(F.split(content, r"\n\n+")).alias("at", "block"))
    lines = F.split(F.regexp_replace("block", r"^\s+|\s+$", ""), "\n")
    marked = F.get(F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: x.rlike(MARKED)), 0)
    blocks = each.where(marked.isNotNull() & F.get(lines, 0).rlike(SPAN))
    tag = lambda i: F.concat(F.lit("<"), F.regexp_extract(F.get(lines, 0), SPAN, i), F.lit(">"))
    line = blocks.select("doc_id", "at", F.concat(tag(1), F.regexp_replace(marked, "</?c>", ""), tag(2)).alias("line"))
    found = line.select("doc_id", "at", *[F.regexp_extract_all("line", F.lit(TIMED), i).alias(c) for i, c in ((1, "times"), (2, "said"))])
    word = lambda w, i: F.struct(
        i.alias("nth"), F.regexp_replace(w, r"^\s+|\s+$", "").alias("text"), exact_ms(F.get("times", i)).alias("start_ms"), exact_ms(F.get("times", i + 1)).alias("end_ms")
    )
    words = line_words(found, word)
    order = Window.partitionBy("doc_id").orderBy("at", "nth")
    return words.select("doc_id", (F.row_number().over(order).cast("long") - 1).alias("idx"), "start_ms", "end_ms", "text")


def line_words(found: DataFrame, word) -> DataFrame:
    """A row for each word that is followed by a time."""
    timed = F.filter(F.transform("said", word), lambda w: (w["text"] != "") & w["end_ms"].isNotNull())
    return found.select("doc_id", "at", F.inline(timed))


def imported(cues: DataFrame, keys: Sequence[str], share: float = 0.8) -> DataFrame:
    """``cues`` (keys, start_ms, end_ms, text, and speaker, language and words if there are) as a file's reader gives them.

    Adds granularity, timing_source (imported) and words: where ``share`` of a key's cues are single words, all its cues are words, and a
    cue without words is its own one word; else they are sentences. Null keys are one document; a null text is no word.
    """
    counted = word_level(cues, keys, share).select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], F.col("word_level").alias("_single"))
    told = cues.join(counted, [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)])
    or_null = lambda c: (F.col(c) if c in cues.columns else F.lit(None).cast("string")).alias(c)
    own = F.array(F.struct("text", "start_ms", "end_ms", or_null("speaker"), or_null("language"), F.lit("imported").alias("timing_source")))
    words = F.when(F.col("_single"), own)
    if "words" in cues.columns:
        words = F.when(F.size("words") > 0, F.col("words")).otherwise(words)
    made = told.withColumns({"words": words, "granularity": F.when(F.col("_single"), "word").otherwise("sentence"), "timing_source": F.lit("imported")})
    return made.drop("_single", *[f"_key_{i}" for i in range(len(keys))])
