"""Document fingerprints by spot signatures, in DataFrame functions only.

Words are runs of characters other than white space and the marks of ``MARKS``, in lower case. A common word
(``ANCHORS``) is an anchor, and all others are content. An anchor's signature is the anchor with the chain of the
``CHAIN`` content words that follow it, wherever other anchors stand between them; near the end of a text chains are
shorter. So that texts without common words have signatures too, the start of a text is an anchor without a word, and
after ``GAP`` content words without an anchor each content word starts a chain of its own until the next anchor. A
document is the set of its signatures, and its fingerprint is the SHA-256 of the set in order.

The likeness of two sets is their Jaccard similarity. Sets are partitioned by length: class k holds the lengths from
(1 / least)^k to below (1 / least)^(k + 1). Two sets whose classes aren't the same or neighbours, or whose lengths
bound the similarity below ``least`` (shorter / longer), are not intersected, and their likeness is 0. Two sets with
nothing in them are alike (1).

``next`` order is that of ids, null ids last, rows of one id in order of a hash of their texts. Documents are dealt
out by ranges of ids that follow the quantiles of the ids, and rows of an id that fills several ranges by the hash, so
a range is bounded and no order is made in a single task; texts are shuffled once. The last row of a range meets the first
of the next range, of which there is one row a range, and the last of all meets the first of all.

Null texts are empty; empty texts and texts without a word have no signature and share the fingerprint of the empty
set. Equal texts have equal fingerprints. Very long texts are read whole. Repeated rows are documents of their own;
of equal rows any may come first, which changes no result. Kept columns keep their names, and a result whose name
one of them has gets underscores before it. A single document is its own next. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelattice.llm.common import free_name, table, text_size
from cuelattice.llm.line_rules import let

#: Frequent function words of English, French, German, Spanish, Italian and Portuguese: fixed values.
ANCHORS = (
    "a an and are as at be been but by can for from had has have he her his i if in is it its not of on or she that the their there they this to was we were which "
    "will with would you "
    "au aux avec ce cette dans de des du elle en est et il ils je la le les mais ne nous on ou par pas pour qui que sa se ses son sont sur un une vous "
    "als am an auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht sich sie sind und von war wie wir zu zum zur "
    "al como con del e el él ella entre era es ha hay la las lo los más me mi muy no o para pero por se si sin su sus también una uno y ya "
    "che chi da dal della delle di gli ho il le nel non per più questo sono una "
    "ao com da das do dos ele ela em era eu foi isso mas na nas nos não os ou pela pelo quando são seu sua um uma"
).split()
MARKS = ".,;:!?\"'()[]{}<>«»„“”‘’…¡¿"
SPACES = " \t\n\x0b\f\r"
CHAIN, GAP = 3, 8
#: Sets of lengths between which the similarity can't reach this are not intersected.
LEAST = 0.1
#: Ranges of ids, each cut further so that it has about ``RANGE_BYTES`` of text.
RANGES, RANGE_BYTES = 512, 64 << 20


def spot_words(text: Column) -> Column:
    cleaned = F.translate(F.lower(text), MARKS + SPACES, " " * len(MARKS + SPACES))
    return F.filter(F.split(cleaned, " "), lambda w: w != "")


def signatures(text: Column, anchors: tuple[str, ...] = tuple(ANCHORS), chain: int = CHAIN, gap: int = GAP) -> Column:
    """The distinct signatures of a text, in order."""
    common = sorted(set(anchors))

    def spans(words: Column, places: Column, content: Column) -> Column:
        """Signatures of each anchor's span; ``places``: (word, index of the next content word), the text's start first."""
        signature = lambda word, at: F.concat_ws(" ", word, *[F.get(content, at + k) for k in range(chain)])

        def of(place: Column, i: Column) -> Column:
            head = F.array(signature(place["word"], place["at"]))
            end = F.coalesce(F.get(places, i + 1)["at"], F.size(content))
            rest = F.transform(F.sequence(place["at"] + gap, end - 1), lambda j: signature(F.lit(None).cast("string"), j))
            return F.when(end - place["at"] > gap, F.concat(head, rest)).otherwise(head)

        return F.filter(F.flatten(F.transform(places, of)), lambda s: s != "")

    def of_words(words: Column) -> Column:
        at = F.filter(F.transform(words, lambda w, i: F.when(w.isin(common), F.struct(w.alias("word"), i.alias("i")))), lambda x: x.isNotNull())
        start = F.array(F.struct(F.lit(None).cast("string").alias("word"), F.lit(0).alias("at")))
        places = F.concat(start, F.transform(at, lambda x, k: F.struct(x["word"].alias("word"), (x["i"] - k).alias("at"))))
        content = F.filter(words, lambda w: ~w.isin(common))
        return let(places, lambda p: let(content, lambda c: spans(words, p, c)))

    return F.array_sort(F.array_distinct(let(spot_words(text), of_words)))


def fingerprint(found: Column) -> Column:
    return F.sha2(F.array_join(found, "\n").cast("binary"), 256)


def length_class(n: Column, least: float = LEAST) -> Column:
    """The partition of sets of ``n`` signatures; 0 for the empty set too."""
    return F.floor(F.log(F.greatest(n, F.lit(1))) / F.log(F.lit(1 / least)))


def likeness(a: Column, b: Column, least: float = LEAST) -> Column:
    """Jaccard similarity of two arrays of distinct values; 0 where their lengths alone prove that it is below ``least``."""
    n, m = F.size(a), F.size(b)
    apart = F.abs(length_class(n, least) - length_class(m, least)) > 1
    bounded = F.least(n, m) < least * F.greatest(n, m)
    shared = F.size(F.array_intersect(a, b))
    similarity = F.when((n == 0) | (m == 0), 0.0).otherwise(let(shared, lambda s: s / (n + m - s)))
    return F.when((n == 0) & (m == 0), 1.0).when(apart | bounded, 0.0).otherwise(similarity)


def count_below(bounds: list[int], value: Column, inclusive: bool) -> Column:
    """How many of the sorted ``bounds`` are below ``value`` (or equal to it): a binary search in steps of powers of two."""
    array = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # folded once; not an expression a bound
    fits = lambda x: (x <= value) if inclusive else (x < value)
    steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(fits(F.get(array, at + step - 1)), F.lit(False)), at + step).otherwise(at))


def ranged(rows: DataFrame, size: int, ranges: int = RANGES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``rows`` (id, h and others) with ``range``, a struct that rises with (id, h), null ids last.

    The id's quantiles bound ``ranges`` ranges; each is cut into equal stretches of ids where texts of ``size`` bytes in
    all would make it larger than ``range_bytes``. An id that fills several ranges is dealt out among them by its hash.
    """
    bounds = rows.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 16 * ranges).alias("q")).first().q or [0]
    low, high, span = count_below(bounds, F.col("id"), False), count_below(bounds, F.col("id"), True), F.col("high") - F.col("low")
    share = F.shiftrightunsigned(F.col("h"), 12) / F.lit(float(1 << 52))  # 0 to below 1, and rises with the unsigned hash
    edge = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    first, after = F.get(edge, F.col("high") - 1), F.get(edge, F.col("high"))
    cuts = max(1, -(-size // (ranges * range_bytes)))
    within = F.when(after > first, F.least(F.floor((F.col("id") - first) / (after - first).cast("double") * cuts), F.lit(cuts - 1))).otherwise(0)
    most = F.lit(len(bounds) + 1)
    coarse = F.when(F.col("id").isNull(), most + F.floor(share * ranges)).when(span > 1, F.col("low") + 1 + F.floor(share * (span - 1))).otherwise(F.col("high"))
    fine = F.when(F.col("id").isNull() | (span > 1), 0).otherwise(F.coalesce(within, F.lit(0)))
    placed = rows.withColumns({"low": low, "high": high})
    return placed.withColumn("range", F.struct(coarse.cast("int").alias("coarse"), fine.cast("int").alias("fine"))).drop("low", "high")


def range_starts(rows: DataFrame) -> DataFrame:
    """For each range, the text of the first row of the next one (of the first range for the last); keys are looked up first, then texts."""
    least = F.min(F.struct(F.col("id").isNull().alias("absent"), "id", F.shiftrightunsigned("h", 12).alias("high_bits"), "h"))
    firsts = rows.groupBy("range").agg(least.alias("least"))
    around = Window.partitionBy(F.lit(0)).orderBy("range")  # a row a range, and ranges hold RANGE_BYTES of text
    after = F.coalesce(F.lead("least").over(around), F.first("least").over(around))
    keys = firsts.select("range", after.alias("after")).select("range", F.col("after.id").alias("of"), F.col("after.h").alias("hash"))
    texts = rows.select("id", "h", "text").join(keys, F.col("of").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h")))
    return texts.groupBy("range").agg(F.first("text").alias("text"))


def with_edits(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), part: int = 4, least: float = LEAST) -> DataFrame:
    """The ``keep`` columns with n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, signatures.

    A document is compared with its edited text, in which the next document's start replaces the last 1 / ``part``, and
    with that next document.
    """
    kept = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    whole = F.coalesce(F.col(text), F.lit(""))
    given = docs.select(*kept, F.col(doc_id).cast("long").alias("id"), F.xxhash64(whole).alias("h"), whole.alias("text"))
    rows = ranged(given, text_size(docs, text))
    order = [F.col("id").asc_nulls_last(), F.shiftrightunsigned("h", 12), "h"]
    following = Window.partitionBy("range").orderBy(*order)
    dealt = rows.repartition("range").sortWithinPartitions("range", *order)
    found = dealt.withColumn("signatures", signatures(F.col("text")))
    nexts = found.withColumns({"next": F.lead(F.struct("text", "signatures")).over(following)})
    starts = range_starts(rows).select("range", F.struct("text", signatures(F.col("text")).alias("signatures")).alias("start"))
    ends = nexts.join(starts, "range", "left").withColumn("next", F.coalesce("next", "start"))
    n = F.length("text")
    cut = F.floor(n / part).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    made = ends.withColumns({"n": n.cast("long"), "edited": edited})
    both = made.withColumn("edited_signatures", signatures(F.col("edited")))
    results = {
        "n_chars": F.col("n"), "edited_sha256": F.sha2(F.col("edited").cast("binary"), 256), "fingerprint": fingerprint(F.col("signatures")),
        "edited_fingerprint": fingerprint(F.col("edited_signatures")), "near_edited": likeness(F.col("signatures"), F.col("edited_signatures"), least),
        "near_next": likeness(F.col("signatures"), F.col("next.signatures"), least), "signatures": F.col("signatures"),
    }
    left = docs.select(*keep)
    named = both.select(*[f"keep_{i}" for i in range(len(keep))], *[v.alias(f"out_{i}") for i, v in enumerate(results.values())])
    names = [*[(f"keep_{i}", c) for i, c in enumerate(keep)], *[(f"out_{i}", free_name(left, c)) for i, c in enumerate(results)]]
    return named.select(*[F.col(inner).alias(outer) for inner, outer in names])


def op11_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return with_edits(table(spark, sf_dir, "documents")).drop("signatures")


QUERIES = {"op11_spot_signatures": op11_spot_signatures}
_ANCHOR_LIST = ", ".join(f"'{w}'" for w in sorted(set(ANCHORS)))
_MARKS = (MARKS + SPACES).replace("'", "''")
ORACLES = {
    "op11_spot_signatures": f"""
WITH o AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id NULLS LAST) AS r, count(*) OVER () AS n FROM documents),
e AS (SELECT a.doc_id, a.r, b.r AS next_r, a.t, left(a.t, length(a.t) - length(a.t) // 4) || left(b.t, length(a.t) // 4) AS edited
  FROM o a JOIN o b ON b.r = a.r % a.n + 1),
texts AS (SELECT r, 0 AS kind, t FROM e UNION ALL SELECT r, 1, edited FROM e),
w AS (SELECT r, kind, list_filter(string_split(translate(lower(t), '{_MARKS}', repeat(' ', {len(MARKS + SPACES)})), ' '), lambda x: x <> '') AS ws FROM texts),
p AS (SELECT r, kind, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
q AS (SELECT *, word IN ({_ANCHOR_LIST}) AS anchor FROM p),
c AS (SELECT *, CAST(sum(CASE WHEN anchor THEN 0 ELSE 1 END) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS upto FROM q),
g AS (SELECT r, kind, list(word ORDER BY i) FILTER (NOT anchor) AS content FROM c GROUP BY r, kind),
k AS (SELECT r, kind, word, anchor, upto + CASE WHEN anchor THEN 1 ELSE 0 END AS pos,
        upto - coalesce(max(CASE WHEN anchor THEN upto END) OVER (PARTITION BY r, kind ORDER BY i), 0) AS since FROM c),
s AS (SELECT DISTINCT k.r, k.kind, concat_ws(' ', CASE WHEN anchor THEN word END, content[pos], content[pos + 1], content[pos + 2]) AS s
  FROM k JOIN g USING (r, kind) WHERE anchor OR since > 8
  UNION SELECT r, kind, concat_ws(' ', content[1], content[2], content[3]) FROM g WHERE len(content) > 0),
l AS (SELECT r, kind, list(s ORDER BY s) AS sigs FROM s GROUP BY r, kind),
f AS (SELECT e.*, coalesce(x.sigs, []) AS a, coalesce(y.sigs, []) AS b, coalesce(z.sigs, []) AS c FROM e
  LEFT JOIN l x ON x.r = e.r AND x.kind = 0 LEFT JOIN l y ON y.r = e.r AND y.kind = 1 LEFT JOIN l z ON z.r = e.next_r AND z.kind = 0),
m AS (SELECT *, len(list_intersect(a, b)) AS ab, len(list_intersect(a, c)) AS ac FROM f)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256,
  sha256(array_to_string(a, chr(10))) AS fingerprint, sha256(array_to_string(b, chr(10))) AS edited_fingerprint,
  CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE WHEN least(len(a), len(b)) < {LEAST}::DOUBLE * greatest(len(a), len(b)) THEN 0.0 ELSE ab::DOUBLE / (len(a) + len(b) - ab) END AS near_edited,
  CASE WHEN len(a) + len(c) = 0 THEN 1.0::DOUBLE WHEN least(len(a), len(c)) < {LEAST}::DOUBLE * greatest(len(a), len(c)) THEN 0.0 ELSE ac::DOUBLE / (len(a) + len(c) - ac) END AS near_next
FROM m""",
}
