"""Corpus metrics, log roll-ups and comparisons of two versions of a table."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COUNTERS = ("duration_ms", "tokens", "prompt_tokens", "cached_tokens")


def group_id(task: Column, file_name: Column, timestamp: Column) -> Column:
    """The task's id, or a digest of file name and minute for entries without one."""
    task = F.trim(F.coalesce(task, F.lit("")))
    identity = F.concat_ws("\x1f", F.trim(F.coalesce(file_name, F.lit(""))), F.substring(F.coalesce(timestamp, F.lit("")), 1, 16))
    return F.when(task != "", task).otherwise(F.concat(F.lit("legacy:"), F.substring(F.sha2(identity, 256), 1, 20)))


def first_seen(value: Column, order: Column) -> Column:
    """Aggregate: distinct non-empty values in the order in which they first occur."""
    pairs = F.array_sort(F.collect_set(F.when(value != "", F.struct(order.alias("o"), value.alias("v")))))
    return F.array_distinct(F.transform(pairs, lambda p: p["v"]))


def task_rollup(requests: DataFrame, keys: Sequence[str] = ("group_id",)) -> DataFrame:
    """Requests, errors, sums, span, stages and models, and cached share of the prompt for each group."""
    firsts = requests.groupBy(*keys, "stage", "model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_error").alias("errors"), F.min("seq").alias("seq"),
        F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at"), *[F.sum(c).alias(c) for c in COUNTERS],
    )
    grouped = firsts.groupBy(*keys).agg(
        F.sum("n").alias("request_count"), F.sum("errors").alias("error_count"), *[F.sum(c).alias(c) for c in COUNTERS],
        F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"),
        F.array_join(first_seen(F.col("stage"), F.col("seq")), ",").alias("stages"), F.array_join(first_seen(F.col("model"), F.col("seq")), ",").alias("models"),
    )
    share = F.when(F.col("prompt_tokens") > 0, F.bround(F.col("cached_tokens") / F.col("prompt_tokens"), 4)).otherwise(0.0)
    return grouped.withColumn("cache_hit_rate", share)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def rows_compared(before: DataFrame, after: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row for each difference: keys, column (null for a whole row), kind (missing, extra, changed), before, after."""
    b = before.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("in_b"))
    a = after.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(True).alias("in_a"))
    both = b.join(a, list(keys), "full_outer")
    whole = F.array(F.struct(F.lit(None).cast("string").alias("column"), F.when(F.col("in_a").isNull(), "missing").otherwise("extra").alias("kind"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after")))
    each = F.array(*[
        F.struct(F.lit(c).alias("column"), F.when(~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}")), "changed").alias("kind"), F.col(f"b_{c}").cast("string").alias("before"), F.col(f"a_{c}").cast("string").alias("after"))
        for c in columns
    ])
    diffs = F.when(F.col("in_a").isNull() | F.col("in_b").isNull(), whole).otherwise(F.filter(each, lambda d: d["kind"].isNotNull()))
    return both.select(*keys, F.explode(diffs).alias("d")).select(*keys, "d.*")


def metric_gates(legacy: DataFrame, candidate: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Per key and metric: both values, delta, ratio (0 for 0/0, -1 for x/0), and whether the candidate is no worse."""
    stacked = lambda d, n: d.select(key, F.explode(F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*[F.col(m).cast("double") for m in metrics]))).alias("metric", n))
    both = stacked(legacy, "legacy").join(stacked(candidate, "candidate"), [key, "metric"], "full_outer").fillna(0.0, ["legacy", "candidate"])
    old, new = F.col("legacy"), F.col("candidate")
    ratio = F.when((old == 0) & (new == 0), 0.0).when(old == 0, -1.0).otherwise(F.round(new / old, 6))
    return both.withColumns({"delta": F.round(new - old, 6), "ratio": ratio, "passed": new <= old})


def weighted_and_macro(df: DataFrame, keys: Sequence[str], errors: str, total: str) -> DataFrame:
    """Error rate over all rows of a group, and the mean of the rows' own rates."""
    return df.groupBy(*keys).agg(
        F.round(F.try_divide(F.sum(errors), F.sum(total)), 8).alias("weighted_rate"), F.round(F.avg(F.try_divide(F.col(errors), F.col(total))), 8).alias("macro_rate"), F.count(F.lit(1)).alias("n")
    )


def longest_claim(edited: list[str], other: list[str], own: list[str], least: int, most: int) -> int:
    """Length, of ``least`` to ``most``, of the longest run of ``edited`` tokens that ``other`` has and ``own`` lacks; 0 for none.

    A run that goes on is only looked for where its beginning was found, and each length goes through the tokens once.
    """
    runs = lambda tokens, starts, n: {tuple(tokens[i : i + n]) for i in starts if i + n <= len(tokens)}
    mine, theirs, found = range(len(edited)), range(len(other)), 0
    for n in range(least, most + 1):
        shared = runs(edited, mine, n) & runs(other, theirs, n)
        if not shared:
            break
        mine, theirs = ([i for i in at if tuple(tokens[i : i + n]) in shared] for tokens, at in ((edited, mine), (other, theirs)))
        if shared - runs(own, range(len(own)), n):
            found = n
    return found


def neighbour_claims(df: DataFrame, keys: Sequence[str], order: str, before: str, after: str, least: int = 4, most: int = 12) -> DataFrame:
    """Rows whose edited tokens hold a run of a neighbour's original tokens that their own original lacks.

    ``before`` and ``after`` are token arrays; the longest such run has ``least`` to ``most`` tokens. Rows that weren't edited
    claim nothing and aren't searched.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    sides = df.withColumns({"_prev": F.lag(before).over(w), "_next": F.lead(before).over(w)})

    @F.arrow_udf("struct<from_previous:int,from_next:int>")
    def claims(edited: pa.Array, own: pa.Array, previous: pa.Array, following: pa.Array) -> pa.Array:
        e, o, p, f = (c.to_pylist() for c in (edited, own, previous, following))
        longest = lambda other: pa.array([longest_claim(a or [], x or [], b or [], least, most) for a, b, x in zip(e, o, other, strict=True)], pa.int32())
        return pa.StructArray.from_arrays([longest(p), longest(f)], ["from_previous", "from_next"])

    found = sides.where(~F.col(after).eqNullSafe(F.col(before))).withColumn("_claims", claims(after, before, "_prev", "_next"))
    return found.where("_claims.from_previous > 0 OR _claims.from_next > 0").select(*df.columns, "_claims.*")


def best_diagonal(left: DataFrame, right: DataFrame, keys: Sequence[str], token: str, position: str, least: int = 2) -> DataFrame:
    """The shift at which two token sequences agree best, of those with ``least`` equal tokens or more.

    Sequences are laid over each other by i = 1 .. n_left + n_right tokens from the left's end; a shift
    scores its equal tokens over i plus i / 10000, and the least i wins ties. Only equal tokens are joined,
    so that shifts without any cost nothing.
    """
    n_left = left.groupBy(*keys).agg((F.max(position) + 1).alias("n_left"))
    pairs = left.select(*keys, token, F.col(position).alias("p")).join(right.select(*keys, token, F.col(position).alias("q")), [*keys, token])
    shifted = pairs.join(n_left, list(keys)).select(*keys, (F.col("n_left") - F.col("p") + F.col("q")).cast("long").alias("shift"))
    scored = shifted.groupBy(*keys, "shift").agg(F.count(F.lit(1)).alias("matches")).where(F.col("matches") >= least)
    score = F.round(F.col("matches") / F.col("shift") + F.col("shift") / 10000, 9)
    best = F.max(F.struct(score.alias("score"), (-F.col("shift")).alias("s"), "matches"))
    return scored.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.s")).alias("shift"), F.col("b.matches").alias("matches"), F.col("b.score").alias("score"))


def centroid_margins(df: DataFrame, label: str, vector: str, row: str, block: int = 256) -> DataFrame:
    """Cosine similarity of each vector to its own label's mean direction and to the best other one.

    The mean directions are dealt into blocks of about ``block`` labels, and each vector meets every block once; one
    block is broadcast, more are joined by their number.
    """
    unit = F.transform(vector, lambda x: x / F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, y: a + y * y)))
    rows = df.select(row, F.col(label).alias("label"), unit.alias("u"))
    sums = rows.select("label", F.posexplode("u").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    listed = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, z: s + z)
    centres = listed.select(F.col("label").alias("centre"), F.transform("c", lambda x: x / F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, y: a + y * y))).alias("c"))
    blocks = -(-rows.select("label").distinct().count() // block)
    dealt = centres.groupBy(F.pmod(F.xxhash64("centre"), F.lit(max(1, blocks))).alias("block")).agg(F.collect_list(F.struct("centre", "c")).alias("some"))
    spread = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, blocks - 1)).cast("long"))))
    met = spread.join(F.broadcast(dealt) if blocks == 1 else dealt, "block")
    sims = F.transform("some", lambda s: F.struct(s["centre"].alias("centre"), dot(F.col("u"), s["c"]).alias("sim")))
    scored = met.select(row, "label", sims.alias("sims"))
    own = F.get(F.filter("sims", lambda s: s["centre"] == F.col("label")), 0)["sim"]
    other = F.array_max(F.transform(F.filter("sims", lambda s: s["centre"] != F.col("label")), lambda s: s["sim"]))
    best = scored.select(row, "label", own.alias("own"), other.alias("other"))
    if blocks > 1:
        best = best.groupBy(row, "label").agg(F.max("own").alias("own"), F.max("other").alias("other"))
    return best.select(row, "label", F.round("own", 4).alias("own"), F.round("other", 4).alias("other"))
