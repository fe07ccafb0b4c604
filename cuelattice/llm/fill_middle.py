"""Fill-in-the-middle by a two-pass streaming matcher.

A text is a run of units (matches of a pattern, left to right; lines by default). The first pass counts them; two
ranks between 0 and their number are drawn from the row's key; the second pass advances one lazy iterator of matches
to the lower rank, then to the higher one, and notes where these units end. Neither pass keeps a unit, so a text needs
its own room and that of one match, however many units it has. The parts are then cut and joined in the JVM.

A text is plain (left as it is) if it is empty, if it contains a marker, or if the rate of the transformation leaves it
out; else its form is ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle). Characters are code points.
Null texts are empty, thus plain, with 0 units. A null key hashes as the empty text. Very long texts are read whole.
Each row is transformed on its own, also if it repeats; equal keys and texts give equal outputs. Kept columns keep
their names, and a result whose name one of them has gets underscores before it. An empty table gives no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.llm.common import free_name, table

LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUTS = pa.struct([("n", pa.int64()), ("first", pa.int64()), ("second", pa.int64())])


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers: the first groups of the hexadecimal SHA-256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def cuts(text: str, unit: re.Pattern[str], draw_a: int, draw_b: int) -> tuple[int, int, int]:
    """Units of a text, and where the units of the lower and the higher rank end (0 where a rank is 0)."""
    n = sum(1 for _ in unit.finditer(text))
    low, high = sorted((draw_a % (n + 1), draw_b % (n + 1)))
    matches, ends = unit.finditer(text), []
    rank = end = 0
    for wanted in (low, high):
        while rank < wanted:
            end = next(matches).end()
            rank += 1
        ends.append(end)
    return n, ends[0], ends[1]


def matcher(pattern: str) -> Column:
    """An Arrow function of (text, draw, draw) that gives ``cuts`` a row."""
    unit = re.compile(pattern)

    @F.arrow_udf("struct<n:long,first:long,second:long>")
    def found(texts: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        rows = (cuts(t.as_py() or "", unit, x, y) for t, x, y in zip(texts, a.to_pylist(), b.to_pylist(), strict=True))
        return pa.array([dict(zip(("n", "first", "second"), r, strict=True)) for r in rows], CUTS)

    return found


def transform(
    docs: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), pattern: str = LINES,
    rate: int = 100, spm_rate: int = 50, seed: int = 7,
) -> DataFrame:
    """The ``keep`` columns with n, form, prefix_chars, middle_chars and output; rates in per cent.

    ``pattern`` is to match neither the empty text nor leave a character out, so that units make up the text.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    a, b, c, d = draws(F.col(key), seed)
    kept = [F.col(k).alias(f"keep_{i}") for i, k in enumerate(keep)]
    marked = whole.contains(PREFIX) | whole.contains(SUFFIX) | whole.contains(MIDDLE)
    plain = (whole == "") | marked | (F.pmod(c, F.lit(100)) >= rate)
    form = F.when(plain, "plain").when(F.pmod(d, F.lit(100)) < spm_rate, "spm").otherwise("psm")
    rows = docs.select(*kept, whole.alias("text"), form.alias("form"), matcher(pattern)(whole, a, b).alias("cut"))
    first, second = F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    body = F.col("text")
    prefix, middle, suffix = F.substring(body, F.lit(1), first), F.substring(body, first + 1, second - first), F.substring(body, second + 1, F.length(body))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(body)
    )
    cut = F.col("form") != "plain"
    results = {
        "n": F.col("cut.n"), "form": F.col("form"), "prefix_chars": F.when(cut, F.col("cut.first")),
        "middle_chars": F.when(cut, F.col("cut.second") - F.col("cut.first")), "output": output,
    }
    left = docs.select(*keep)
    return rows.select(*[F.col(f"keep_{i}").alias(k) for i, k in enumerate(keep)], *[v.alias(free_name(left, name)) for name, v in results.items()])


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: markers are in no text that was cut, so each is found at its only place."""
    middle = F.substring_index(output, MIDDLE, -1)
    before = F.substring_index(output, MIDDLE, 1)

    def between(first: str, second: str) -> tuple[Column, Column]:
        return F.substring(F.substring_index(before, second, 1), len(first) + 1, 2**31 - 1), F.substring_index(before, second, -1)

    (prefix, suffix), (late, early) = between(PREFIX, SUFFIX), between(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(early, middle, late)).otherwise(output)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts every document into lines and transforms it; the outputs' and the restored texts' digests."""
    made = transform(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


QUERIES = {"op13_fill_middle": op13_fill_middle}
ORACLES = {
    "op13_fill_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u,
        CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2,
        CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
r AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM h),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:n], ''), '') AS suf,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
             WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM r)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
         ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p""",
}
