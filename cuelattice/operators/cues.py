"""Tables of cues: normal form, groups, edits against another version, and what a reviewer counts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelattice.functions import text as tx
from cuelattice.operators import intervals as iv


def normal_form(cues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cues with a visible text in order of start, numbered from 0; equal starts keep their order by idx."""
    order = Window.partitionBy(*keys).orderBy("start_ms", "idx")
    return cues.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("idx", F.row_number().over(order).cast("long") - 1)


def word_level(cues: DataFrame, keys: Sequence[str], share: float = 0.8) -> DataFrame:
    """Cues of each key, those that are single words, and whether these are ``share`` of all or more."""
    counts = cues.groupBy(*keys).agg(F.count(F.lit(1)).alias("cues"), F.count_if(tx.is_word_level(F.col("text"))).alias("single"))
    return counts.withColumn("word_level", F.col("single") >= share * F.col("cues"))


def clipped(cues: DataFrame, media_ms: Column) -> DataFrame:
    """Cues that begin within the media, cut at its end; all as they are where its length is null or not above 0."""
    unknown = media_ms.isNull() | (media_ms <= 0)
    inside = (F.col("start_ms") < media_ms) & (F.least(F.col("end_ms"), media_ms) > F.col("start_ms"))
    return cues.where(unknown | inside).withColumn("end_ms", F.when(unknown, F.col("end_ms")).otherwise(F.least("end_ms", media_ms)))


def time_groups(cues: DataFrame, keys: Sequence[str], order: Sequence[str], gap_ms: int, labels: Sequence[str] = (), most: int = 0) -> DataFrame:
    """Groups of cues with a new one after a gap of over ``gap_ms`` and where one of ``labels`` changes from the last known one; null labels never do.

    Returns keys, group, start_ms, end_ms, members. With ``most``, groups of more cues are cut into even parts of that many at most.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    known = w.rowsBetween(Window.unboundedPreceding, -1)
    changed = [F.coalesce(F.last(c, ignorenulls=True).over(known) != F.col(c), F.lit(False)) for c in labels]
    new = F.lag("end_ms").over(w).isNull() | (F.col("start_ms") - F.lag("end_ms").over(w) > gap_ms)
    for c in changed:
        new = new | c
    numbered = cues.withColumn("_new", new.cast("int")).withColumn("group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    by = [*keys, "group"]
    if most:
        inner = Window.partitionBy(*by)
        n = F.count(F.lit(1)).over(inner)
        nth = F.row_number().over(inner.orderBy(*order)) - 1
        numbered = numbered.withColumn("part", F.floor(nth * F.ceil(n / most) / n))
        by = [*by, "part"]
    return numbered.groupBy(*by).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("members"))


def relabelled(before: DataFrame, after: DataFrame, keys: Sequence[str], order: str, label: str, context: int = 3) -> DataFrame:
    """Cues whose label changed, with the texts of ``context`` cues on either side; keys whose cues differ otherwise are left out."""
    old = before.select(*keys, order, F.col(label).alias("from"), F.col("text").alias("_text"), F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"))
    both = old.join(after.withColumn("_in", F.lit(True)), [*keys, order], "full_outer")
    same = F.coalesce((F.col("_text") == F.col("text")) & (F.col("_s") == F.col("start_ms")) & (F.col("_e") == F.col("end_ms")), F.lit(False))
    whole = both.withColumn("_same", F.min(same).over(Window.partitionBy(*keys)))
    around = Window.partitionBy(*keys).orderBy(order).rowsBetween(-context, context)
    known = lambda c: F.coalesce(F.col(c), F.lit("unassigned"))
    told = whole.withColumn("context", F.array_join(F.collect_list("text").over(around), " "))
    return told.where(F.col("_same") & (known("from") != known(label))).select(*keys, order, "start_ms", known("from").alias("from"), known(label).alias("to"), "context")


def gold_comparison(machine: DataFrame, gold: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Per key: whether both have as many cues, the places of changed texts, and the shares of changed and equal ones."""
    place = lambda d, n: d.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).select(*keys, "_at", F.col("text").alias(n))
    both = place(machine, "mine").withColumn("_m", F.lit(1)).join(place(gold, "theirs").withColumn("_g", F.lit(1)), [*keys, "_at"], "full_outer")
    changed = ~F.col("mine").eqNullSafe(F.col("theirs"))
    per = both.groupBy(*keys).agg(
        F.count("_m").alias("cues"), (F.count("_m") == F.count("_g")).alias("comparable"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(changed, F.col("_at")))), lambda x: x.cast("string")), ",").alias("changed_cues"), F.count_if(changed).alias("n"),
    )
    only = lambda c: F.when(F.col("comparable"), c)
    return per.select(
        *keys, "comparable", F.coalesce(only(F.col("changed_cues")), F.lit("")).alias("changed_cues"),
        only(F.round(F.col("n") / F.col("cues"), 4)).alias("changed_rate"), only(F.round(1 - F.col("n") / F.col("cues"), 4)).alias("exact_match_rate"),
    )


def spoken_words(cues: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Words of each key and label, one a cue at least; cues without a label are unassigned."""
    words = F.greatest(F.lit(1), F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[A-Za-z0-9']+")))
    return cues.groupBy(*keys, F.coalesce(F.col(label), F.lit("unassigned")).alias(label)).agg(F.sum(words).alias("words"))


def simultaneous(words: DataFrame, turns: DataFrame, keys: Sequence[str], row: str, label: str, width_ms: int = 60_000) -> DataFrame:
    """Rows whose middle falls into turns of several labels, with their number.

    A turn is dealt out to each stretch of ``width_ms`` that it reaches, so that should be about as long as turns are.
    """
    middle = words.withColumn("mid", F.floor((F.col("start_ms") + F.col("end_ms")) / 2).cast("long"))
    at = middle.withColumns({"start_ms": F.col("mid"), "end_ms": F.col("mid") + 1})
    met = iv.overlap_pairs(at.select(*keys, row, "start_ms", "end_ms"), turns.select(*keys, label, "start_ms", "end_ms"), keys, width_ms)
    return met.groupBy(*keys, row).agg(F.count_distinct(label).alias("speakers")).where("speakers > 1")


def part_of_words(lengths: Column, parts: Column, length: Column) -> Column:
    """The part, of ``parts`` even ones of a text of ``length``, in which the middle of each word lies; words are one character apart."""
    @F.arrow_udf("array<long>")
    def part(n: pa.Array, parts: pa.Array, length: pa.Array) -> pa.Array:
        sizes, offsets = n.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(n), 0).to_numpy(zero_copy_only=False))]
        ends = np.r_[0, np.cumsum(sizes + 1)]
        row = np.repeat(np.arange(len(n)), np.diff(offsets))
        middles = ends[:-1] - ends[offsets[:-1]][row] + sizes / 2
        known = lambda c: pc.fill_null(c, 1).to_numpy(zero_copy_only=False).astype(np.int64)[row]
        at = np.floor(middles * known(parts) / known(length)).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(at))

    return part(lengths, parts, length)


def split_evenly(cues: DataFrame, keys: Sequence[str], most_latin: int = 70, most_unspaced: int = 25) -> DataFrame:
    """Cues with a text in one language only and over its limit of characters, as even parts at word borders.

    A text needs as many parts as limits fit into it. A word goes to the part in which its middle lies, parts
    share the cue's time alike, and parts without a word are left out. Other cues stay. Words of a cue are gone
    through once, and a cue's parts are made with their own words only.
    """
    text = F.trim("text")
    alone = F.trim(F.coalesce("translated", F.lit(""))) == ""
    most = F.when(tx.mainly_unspaced(text), most_unspaced).otherwise(most_latin)
    needed = F.when(alone, F.greatest(F.lit(1), F.ceil(F.length(text) / most))).otherwise(1).cast("long")
    sized = cues.where(F.col("text") != "").withColumns({"_parts": needed, "_words": tx.pieces(text), "_length": F.greatest(F.lit(1), F.length(text))})
    placed = sized.withColumn("_in", F.when(F.col("_parts") > 1, part_of_words(F.transform("_words", F.length), F.col("_parts"), F.col("_length"))))
    # Parts don't decrease from word to word, and words hold no line feed: it stands before the first word of each part.
    begun = F.transform("_words", lambda w, i: F.concat(F.when(i == 0, "").when(F.get("_in", i) == F.get("_in", i - 1), " ").otherwise("\n"), w))
    cut = F.arrays_zip(F.array_distinct("_in").alias("part"), F.split(F.array_join(begun, ""), "\n").alias("text"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("part"), F.col("text")))
    each = placed.withColumn("_each", F.explode(F.when(F.col("_parts") == 1, whole).otherwise(cut))).where(F.col("_each.part") < F.col("_parts"))
    span, part = (F.col("end_ms") - F.col("start_ms")) / F.col("_parts"), F.col("_each.part")
    return each.select(*keys, part.alias("part"), F.floor(F.col("start_ms") + part * span).cast("long").alias("start_ms"), F.floor(F.col("start_ms") + (part + 1) * span).cast("long").alias("end_ms"), F.col("_each.text").alias("text"))


def sweep(frames: DataFrame, keys: Sequence[str], grid: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Speech of each key under every setting of ``grid`` (silence_ms, least_ms, pad_ms): ranges, covered time, share, gaps a minute.

    Frames (start_ms, end_ms) join over gaps of under silence_ms, ranges shorter than least_ms go, and the rest grow
    by pad_ms at both ends. The settings are a column, so that the whole grid is one job.
    """
    settings = F.array(*[F.struct(F.lit(s).alias("silence_ms"), F.lit(m).alias("least_ms"), F.lit(p).alias("pad_ms")) for s, m, p in grid])
    names = ["silence_ms", "least_ms", "pad_ms"]
    each = frames.withColumn("_g", F.explode(settings)).select(*keys, "_g.*", "start_ms", "end_ms")
    w = Window.partitionBy(*keys, *names).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start_ms") - reach >= F.col("silence_ms")), 1).otherwise(0)
    runs = each.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = runs.groupBy(*keys, *names, "_run").agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e")).where(F.col("e") - F.col("s") >= F.col("least_ms"))
    total = frames.groupBy(*keys).agg((F.max("end_ms") - F.min("start_ms")).alias("total"))
    found = ranges.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("ranges"), F.sum(F.col("e") - F.col("s") + 2 * F.col("pad_ms")).alias("covered_ms"))
    joined = found.join(total, list(keys))
    return joined.select(
        *keys, *names, "ranges", "covered_ms", F.round(100 * F.least(F.lit(1.0), F.col("covered_ms") / F.col("total")), 6).alias("coverage_pct"),
        F.round((F.col("ranges") - 1) * 60000 / F.col("total"), 6).alias("gaps_a_minute"),
    )


def disagreement(before: DataFrame, after: DataFrame, keys: Sequence[str], row: str, label: str, window_ms: int, limit: int = 20) -> DataFrame:
    """The ``limit`` windows of each key with the greatest share of labelled time on which two versions' labels differ."""
    both = before.select(*keys, row, "start_ms", "end_ms", F.col(label).alias("_old")).join(after.select(*keys, row, F.col(label).alias("_new")), [*keys, row])
    windows = F.sequence(F.floor(F.col("start_ms") / window_ms), F.floor((F.col("end_ms") - 1) / window_ms))
    cut = both.where("end_ms > start_ms").withColumn("window", F.explode(windows))
    shared = F.least("end_ms", (F.col("window") + 1) * window_ms) - F.greatest("start_ms", F.col("window") * window_ms)
    sums = cut.groupBy(*keys, "window").agg(F.sum(shared).alias("labelled_ms"), F.sum(F.when(~F.col("_old").eqNullSafe(F.col("_new")), shared).otherwise(0)).alias("differing_ms"))
    rated = sums.withColumn("share", F.round(F.col("differing_ms") / F.col("labelled_ms"), 6)).where("differing_ms > 0")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("share"), F.desc("differing_ms"), "window"))
    return rated.withColumn("rank", nth).where(F.col("rank") <= limit)


def merged_snapshots(rows: DataFrame, keys: Sequence[str], task: str, state: str, sums: Sequence[str]) -> DataFrame:
    """Snapshots of many tasks as one a key: sums, tasks, tasks given twice, and their state if all share it, else ``mixed``."""
    tasks = rows.groupBy(*keys, task).agg(F.count(F.lit(1)).alias("_n"), F.min(state).alias("_low"), F.max(state).alias("_high"), *[F.sum(c).alias(c) for c in sums])
    low, high = F.min("_low"), F.max("_high")
    return tasks.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("_n") > 1).alias("repeated_tasks"),
        F.when(low == high, low).otherwise("mixed").alias(state),
    )


def attempts(requests: DataFrame, keys: Sequence[str], task: str, order: Sequence[str], failed: Column) -> DataFrame:
    """Attempts of tasks in order: a task's requests until one succeeds, those after failures are retries.

    Returns keys, tasks, attempts, retries, failures, tasks that never succeeded, and the most attempts of a task.
    """
    w = Window.partitionBy(*keys, task).orderBy(*order)
    told = requests.withColumns({"_failed": failed, "_nth": F.row_number().over(w)}).withColumn("_retry", F.coalesce(F.lag("_failed").over(w), F.lit(False)))
    per_task = told.groupBy(*keys, task).agg(F.count(F.lit(1)).alias("n"), F.count_if("_retry").alias("retries"), F.count_if("_failed").alias("failures"))
    return per_task.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tasks"), F.sum("n").alias("attempts"), F.sum("retries").alias("retries"), F.sum("failures").alias("failures"),
        F.count_if(F.col("failures") == F.col("n")).alias("lost_tasks"), F.max("n").alias("most_attempts"),
    )


def mention_contexts(cues: DataFrame, keys: Sequence[str], order: str, reach: int = 1) -> DataFrame:
    """Identifiers that a key's cues name twice or more, with the texts around the first one."""
    w = Window.partitionBy(*keys).orderBy(order)
    told = cues.withColumn("context", F.array_join(F.collect_list("text").over(w.rowsBetween(-reach, reach)), " "))
    each = told.select(*keys, order, "context", F.explode(tx.identifiers(F.col("text"))).alias("form"))
    return each.groupBy(*keys, F.lower("form").alias("mention")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_at"), F.min_by("context", order).alias("context")).where("n >= 2")


def manifest_problems(samples: DataFrame, splits: Sequence[str], paths: Sequence[str]) -> DataFrame:
    """(sample_id, problem): ids given twice, unknown splits, missing paths, and files that several samples use."""
    checks = [F.when(~F.coalesce(F.col("split").isin(*splits), F.lit(False)), F.lit("unknown split"))]
    checks += [F.when(F.trim(F.coalesce(F.col(p), F.lit(""))) == "", F.lit(f"no {p}")) for p in paths]
    own = samples.select("sample_id", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("problem"))
    twice = samples.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sample_id", F.lit("repeated id").alias("problem"))
    files = samples.select("sample_id", F.explode(F.array(*paths)).alias("file")).where("file <> ''")
    shared = files.groupBy("file").agg(F.count_distinct("sample_id").alias("n")).where("n > 1").select("file")
    also = files.join(shared, "file").select("sample_id", F.lit("shared file").alias("problem"))
    return own.union(twice).union(also).distinct()
