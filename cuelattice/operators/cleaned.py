"""Which spoken words the words of a cleaned cue are, so that their times can be kept.

A cue's shown text is mapped only if it is its spoken words less hesitations and doubled words. Words are compared by
their letters and digits. Checks run in order, and the first that fails is the cue's ``error``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelattice.functions.text import pieces
from cuelattice.operators.edits import script

#: The letters and digits of a word, hesitations that may be deleted, and the source of guessed times.
WORD, HESITATIONS, GUESSED = r"[a-z0-9]+(?:['’][a-z]+)?", ("uh", "um", "uh um", "you know", "i mean"), "estimated"
#: A word that is taken for another after a certain word, unless a certain word follows.
HEARD, MEANT, AFTER, UNLESS = "sixth", "six", "flat", "gear"


def bare(word: Column) -> Column:
    return F.replace(F.array_join(F.regexp_extract_all(F.lower(word), F.lit(WORD), 0), ""), F.lit("’"), F.lit("'"))


def bare_words(words: Column) -> Column:
    plain = F.transform(words, lambda w: bare(F.coalesce(w, F.lit(""))))
    misheard = lambda w, i: (w == HEARD) & F.get(plain, i - 1).eqNullSafe(F.lit(AFTER)) & ~F.get(plain, i + 1).eqNullSafe(F.lit(UNLESS))
    return F.transform(plain, lambda w, i: F.when(misheard(w, i), MEANT).otherwise(w))


def mapped_words(cues: DataFrame, keys: Sequence[str], text: str = "text", words: str = "words", speaker: str = "speaker") -> DataFrame:
    """(keys, error, kept, deleted): places of the spoken words that are shown, in order, and of those left out.

    ``words`` is an array of structs of text, start_ms, end_ms, speaker and timing. Where ``error`` isn't null, both lists are empty.
    Null texts and lists are empty, a null time is unreliable, and null or empty speakers are unknown. Lists are columns of a row, and nothing is shuffled.
    """
    given = cues.select(
        *keys, F.coalesce(F.col(words), F.array().cast(cues.schema[words].dataType)).alias("_w"),
        pieces(F.coalesce(F.col(text), F.lit(""))).alias("_shown"), F.nullif(F.col(speaker), F.lit("")).alias("_who"),
    )
    told = given.withColumns({"_a": bare_words(F.col("_w.text")), "_b": bare_words(F.col("_shown"))})
    w = F.col("_w")
    unreliable = F.exists("_a", lambda k: k == "") | F.exists(w, lambda x: F.coalesce(x["end_ms"] <= x["start_ms"], F.lit(True)) | F.coalesce(x["timing"] == GUESSED, F.lit(False)))
    late = F.zip_with(F.col("_w.end_ms"), F.slice(F.col("_w.start_ms"), F.lit(2), F.size(w)), lambda e, s: F.coalesce(e > s, F.lit(False)))
    voices = F.array_distinct(F.filter(F.col("_w.speaker"), lambda s: s.isNotNull() & (s != "")))
    mixed = (F.size(voices) > 1) | ((F.size(voices) == 1) & F.coalesce(~F.array_contains(voices, F.col("_who")), F.lit(False)))
    early = (
        F.when((F.size(w) == 0) | (F.size("_shown") == 0), "missing words").when(unreliable, "unreliable word timing")
        .when(F.exists(late, lambda x: x), "overlapping words").when(mixed, "mixed speaker evidence").when(F.exists("_b", lambda k: k == ""), "unmapped punctuation token")
    )
    checked = told.withColumn("_early", early)
    runs = checked.withColumn("_runs", script(F.when(F.col("_early").isNull(), F.col("_a")), F.when(F.col("_early").isNull(), F.col("_b"))))
    a = F.col("_a")

    def fault(r: Column) -> Column:
        gone = F.slice(a, r["a0"] + 1, r["a1"] - r["a0"])
        doubled = (r["a1"] - r["a0"] == 1) & (F.get(a, r["a0"] - 1).eqNullSafe(F.get(a, r["a0"])) | F.get(a, r["a1"]).eqNullSafe(F.get(a, r["a0"])))
        refused = F.when(~(F.array_join(gone, " ").isin(*HESITATIONS) | doubled), "unsupported deletion")
        return F.when(r["op"] == "delete", refused).when(r["op"] != "equal", "unsupported source replacement")

    error = F.coalesce("_early", F.get(F.filter(F.transform("_runs", fault), lambda e: e.isNotNull()), F.lit(0)))
    places = lambda op: F.flatten(F.transform(F.filter("_runs", lambda r: r["op"] == op), lambda r: F.sequence(r["a0"], r["a1"] - 1)))
    none = F.array().cast("array<int>")
    done = runs.withColumn("error", error)
    return done.select(*keys, "error", *[F.when(F.col("error").isNull(), places(op)).otherwise(none).alias(c) for op, c in (("equal", "kept"), ("delete", "deleted"))])
