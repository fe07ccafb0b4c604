"""Names that may be misheard forms of a document's acronyms.

The distinct names and acronyms of a document meet in one join, in which bit masks of their letters rule out nearly all pairs exactly:
two words as alike as asked share at least some number of letters. Texts and mentions don't take part in it, and only what is
left is compared letter by letter, so what moves is a row a distinct word and a row an alike pair.
"""

from __future__ import annotations

import difflib
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What acronyms and names look like, and words that start sentences and aren't names.
ACRONYM, NAME = r"\b[A-Z][A-Z0-9&-]{2,9}\b", r"\b[A-Z][A-Za-z0-9&-]{1,11}\b"
OPENERS = ("actually", "as", "although", "because", "however", "maybe", "okay", "otherwise", "really", "today")
#: How alike a name is to its acronym, and how much more than to the next one.
ALIKE, AHEAD = 0.72, 0.08


def compact(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def letters(word: Column) -> Column:
    """Masks of the letters and digits that ``word`` has at all and twice or more, and the number of its others that they don't tell."""
    code = lambda i: F.ascii(F.substring(word, i, F.lit(1)))
    bits = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.when(code(i) >= 97, code(i) - 97).otherwise(code(i) - 22)))
    start = F.struct(F.lit(0).cast("long").alias("once"), F.lit(0).cast("long").alias("twice"))
    step = lambda acc, b: F.struct(acc["once"].bitwiseOR(b).alias("once"), acc["twice"].bitwiseOR(acc["once"].bitwiseAND(b)).alias("twice"))
    told = lambda acc: F.struct(acc["once"], acc["twice"], (F.length(word) - F.bit_count(acc["once"]) - F.bit_count(acc["twice"])).alias("more"), F.length(word).alias("n"))
    return F.aggregate(bits, start, step, told)


def may_be_alike(a: str, b: str, alike: float) -> Column:
    """Whether two words may be as alike, told by the columns ``a`` and ``b`` of ``letters``; never false for words that are."""
    both = lambda f: F.bit_count(F.col(f"{a}.{f}").bitwiseAND(F.col(f"{b}.{f}")))
    return both("once") + both("twice") + F.least(f"{a}.more", f"{b}.more") >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (alike / 2) - 1e-9


def in_order(a: str, b: str) -> int:
    """Length of the longest common subsequence, a column of bits at a time; no matching blocks are longer together."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    v = full = (1 << len(a)) - 1
    for c in b:
        u = v & masks.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


@lru_cache(1 << 16)
def ratio_of(a: str, b: str, low: float) -> float:
    """Likeness of two words; 0 where it is under ``low`` for certain."""
    if 2 * in_order(a, b) < low * (len(a) + len(b)):
        return 0.0
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def likeness(heard: Column, meant: Column, low: float) -> Column:
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio_of(x, y, low) for x, y in zip(a, b, strict=True)])

    return ratio(heard, meant)


def misheard_names(segments: DataFrame, keys: Sequence[str], order: str, text: str) -> DataFrame:
    """(keys, at, heard, canonical, canonical_count, similarity): names that are much like one acronym of their document.

    ``at`` is the order of the segment with the first mention. An acronym that comes once is only set against names in capitals or with
    an ampersand, and names that are acronyms themselves, twice or more, are left alone. All such names are given. Null texts
    have none, null keys are one document, and of segments of equal order the lesser text is first.
    """
    spaced = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    same_order = Window.partitionBy(*keys, "_o").orderBy("_t")
    ranked = segments.select(*keys, F.col(order).alias("_o"), spaced.alias("_t")).withColumn("_nth", F.dense_rank().over(same_order))
    found = lambda pattern, meant: F.transform(F.regexp_extract_all("_t", F.lit(pattern), 0), lambda n, i: F.struct(F.lit(meant).alias("_is_meant"), n.alias("_n"), i.alias("_p")))
    words = ranked.select(*keys, "_o", "_nth", F.explode(F.concat(found(ACRONYM, True), found(NAME, False))).alias("_w")).select(*keys, "_o", "_nth", "_w.*").withColumn("_c", compact(F.col("_n")))
    words = words.where(F.when(F.col("_is_meant"), F.length("_c") >= 3).otherwise((F.length("_c") >= 2) & ~F.lower("_n").isin(*OPENERS)))
    distinct = words.groupBy(*keys, "_c", "_is_meant", "_n").agg(F.min(F.struct("_o", "_nth", "_p")).alias("_first"), F.count(F.lit(1)).alias("_count"))
    loud = (F.upper("_n") == F.col("_n")) | F.contains("_n", F.lit("&"))
    meant, heard = lambda c: F.when(F.col("_is_meant"), c), lambda c: F.when(~F.col("_is_meant"), c)
    forms = distinct.groupBy(*keys, "_c").agg(
        F.min(meant(F.struct("_first", "_n"))).alias("_meant"), F.sum(meant(F.col("_count"))).alias("canonical_count"),
        F.collect_list(heard(F.struct(F.col("_n").alias("heard"), loud.alias("loud"), F.col("_first").alias("first")))).alias("_forms"), F.max(heard(loud)).alias("_loud"),
    ).withColumn("_letters", letters(F.col("_c")))
    names = forms.where((F.size("_forms") > 0) & (F.coalesce("canonical_count", F.lit(0)) < 2)).select(*keys, F.col("_c").alias("_heard"), "_forms", "_loud", F.col("_letters").alias("_a"))
    told = forms.where(F.col("_meant").isNotNull()).select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], F.col("_c").alias("_told"), F.col("_meant._n").alias("canonical"), "canonical_count", F.col("_letters").alias("_b"))
    of_document = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]
    low = ALIKE - AHEAD - 1e-9
    pairs = names.join(told, [*of_document, (F.col("_heard") != F.col("_told")) & ((F.col("canonical_count") >= 2) | F.col("_loud")) & may_be_alike("_a", "_b", low)])
    scored = pairs.select(*keys, "_forms", "canonical", "canonical_count", likeness(F.col("_heard"), F.col("_told"), low).alias("_s")).where(F.col("_s") >= low)
    each = scored.select(*keys, F.explode("_forms").alias("_f"), "canonical", "canonical_count", "_s").where((F.col("canonical_count") >= 2) | F.col("_f.loud"))
    each = each.select(*keys, "_f.heard", F.col("_f.first").alias("_first"), "canonical", "canonical_count", "_s")
    w = Window.partitionBy(*keys, "heard").orderBy(F.desc("_s"), F.desc("canonical"))
    ranked_pairs = each.withColumns({"_rank": F.row_number().over(w), "_next": F.lead("_s").over(w)})
    best = ranked_pairs.where((F.col("_rank") == 1) & (F.col("_s") >= ALIKE) & (F.col("_next").isNull() | (F.col("_s") - F.col("_next") >= AHEAD)))
    one = best.groupBy(*keys, F.lower("heard").alias("_h"), F.lower("canonical").alias("_c")).agg(F.min_by(F.struct("_first", "heard", "canonical", "canonical_count", "_s"), "_first").alias("_b"))
    return one.select(*keys, F.col("_b._first._o").alias("at"), "_b.heard", "_b.canonical", "_b.canonical_count", F.round("_b._s", 3).alias("similarity"))
