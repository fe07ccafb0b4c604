"""Quality rules by cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, runs of white space as one space, none at the ends) and hashed. For each
host, the documents that have a line are counted. A line is frequent if more than ``min_docs`` documents of
its host have it, however large the host is. Frequent lines are removed; a document that loses more than
``most_lost`` of its words is depleted and rejected, as are those that fail the base rules.

Null texts have no words and fail. A null host is a host of its own. Every row is a document, whatever its
id; repeated rows count as often as they stand, and a line with just ``min_docs`` documents isn't frequent. Very long
texts are read whole. Kept columns keep their names, and a result whose name one of them has gets underscores
before it; other columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.llm.common import free_name, staged, table

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[ \t-\r]+"
SYMBOLS = "#*$%&|<>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def has_word(text: Column) -> Column:
    return F.translate(text, SPACES, "") != ""


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACE_RUN, " "))


def repeated_words(words: Column, n: int = 3) -> Column:
    """Words that lie in an n-word window found more than once."""

    def covered(windows: Column) -> Column:
        def positions(found: Column) -> Column:
            same = lambda a, k: F.coalesce(F.get(found, k)["h"] == a["h"], F.lit(False))
            repeated = F.filter(found, lambda a, k: same(a, k - 1) | same(a, k + 1))
            return F.sort_array(F.transform(repeated, lambda a: a["i"]))

        at = let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), positions)
        start = F.struct(F.lit(-n).alias("last"), F.lit(0).cast("long").alias("words"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["words"] + F.least(F.lit(n), i - acc["last"])).alias("words"))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(F.aggregate(at, start, step, lambda acc: acc["words"]))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))

    return let(words, lambda w: F.when(F.size(w) > n, let(windows(w), covered)).otherwise(F.lit(0).cast("long")))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(text: Column) -> list[Column]:
    """Base counts of a text, and its lines with words as (hash, words)."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), has_word)
    counts = (
        F.size(words_of(whole)).cast("long"),
        F.length(F.translate(whole, SPACES, "")).cast("long"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        repeated_words(words_of(whole)),
    )
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(normalised(x)).alias("h"), F.size(words_of(x)).alias("n")))
    return [*[c.alias(name) for c, name in zip(counts, BASE, strict=True)], hashed.alias("lines")]


def judge(
    docs: DataFrame, text: str = "text", host: str = "source", keep: tuple[str, ...] = ("doc_id",),
    min_docs: int = 20, most_lost: float = 0.5, clean_text: bool = False,
) -> DataFrame:
    """The ``keep`` columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_words, base_failed, kept.

    ``clean_text`` adds the text without its frequent lines.
    """
    kept = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    given = docs.select(*kept, F.col(text).alias("text"), F.col(host).alias("host"))
    whole = given.select(F.monotonically_increasing_id().alias("row"), *[c for c in given.columns if c != "text" or clean_text], *measured(F.col("text")))
    rows = staged(whole, "line-rules")
    counted = (
        rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
        .groupBy("host", "h").agg(F.count(F.lit(1)).alias("with_line")).where(F.col("with_line") > min_docs)
    )
    frequent = staged(counted.select("host", "h"), "frequent-lines")
    met = rows.select("row", "host", F.explode("lines").alias("x")).select("row", "host", F.col("x.h").alias("h"), F.col("x.n").alias("n"))
    lost = (
        met.alias("m").join(frequent.alias("f"), (F.col("m.h") == F.col("f.h")) & F.col("m.host").eqNullSafe(F.col("f.host")))
        .groupBy("row").agg(F.sum("n").alias("lost"), *([F.collect_set("m.h").alias("gone")] if clean_text else []))
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = rows.join(lost, "row", "left").withColumn("lost", F.coalesce("lost", F.lit(0)).cast("long"))
    left = out.select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)])
    results = {c: F.col(c) for c in BASE} | {"lost_words": F.col("lost"), "base_failed": failed, "kept": ~failed & (F.col("lost") <= most_lost * F.col("n_words"))}
    if clean_text:
        gone = F.coalesce("gone", F.array().cast("array<bigint>"))
        lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: ~F.array_contains(gone, F.xxhash64(normalised(x))))
        results["clean_text"] = F.array_join(lines, "\n")
    return out.select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], *[c.alias(free_name(left, name)) for name, c in results.items()])


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document; the source is the host."""
    return judge(table(spark, sf_dir, "documents"))


QUERIES = {"op7_line_rules": op7_line_rules}
ORACLES = {
    "op7_line_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(string_split_regex(t, '[ \t-\r]+'), lambda x: x <> '') AS ws FROM d),
l AS (SELECT r, source, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT r, source, line, trim(regexp_replace(lower(line), '[ \t-\r]+', ' ', 'g')) AS norm,
         len(list_filter(string_split_regex(line, '[ \t-\r]+'), lambda x: x <> '')) AS n
       FROM l WHERE regexp_matches(line, '[^ \t-\r]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw GROUP BY r),
freq AS (SELECT source, norm FROM lw GROUP BY source, norm HAVING count(DISTINCT r) > 20),
lost AS (SELECT r, sum(n) AS lost_words FROM lw JOIN freq ON lw.norm = freq.norm AND lw.source IS NOT DISTINCT FROM freq.source GROUP BY r),
pos AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM w, unnest(range(1, len(ws) - 1)) u(i) WHERE len(ws) > 3),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM pos) WHERE k > 1),
cov AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM rep, unnest(range(0, 3)) u(j) GROUP BY r),
s AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[ \t-\r]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(lost_words, 0) AS BIGINT) AS lost_words
      FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN cov USING (r) LEFT JOIN lost USING (r))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_words <= 0.5 * n_words AS kept
FROM s""",
}
