"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint has a bit where over half of its shingles' hashes have one. Two documents link where
their fingerprints differ in at most ``radius`` bits, and a component is all that links reach.

Distinct fingerprints are compared once. The 64 bits are cut into blocks; two fingerprints within the radius
agree on all but ``radius`` blocks, so they meet under at least one choice of the other blocks as key. Those
that share a key are compared as bit planes: plane k holds bit k of every fingerprint, 64 to a word, and a
carry-save counter adds the differing planes for 64 fingerprints at a time; words whose fingerprints all
exceed the radius are left off. Within a key, only the links of each group to its least member are passed
on, which joins the same fingerprints. A key with many fingerprints is dealt out as pairs of slices.

Null texts and texts without a word have fingerprint zero. Every row is a document; rows with a null id get a
component but don't name one, unless no row of it has an id. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.llm.common import column, free_name, sliced, staged, table, text_bytes
from cuelattice.llm.components import components

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Fingerprints of a key that are compared at once; larger keys are dealt out as pairs of slices.
SLICE = 1024
LAYERS = 8


def hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each word shingle of a text (UTF-8), repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(h: np.ndarray) -> int:
    """Majority bits of the hashes; ties give 0."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        bits = np.unpackbits(h[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint16)
    return sum(1 << k for k in np.flatnonzero(2 * ones > len(h)).tolist())


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of each document; ``fp`` is the fingerprint as a signed long."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            fps = np.array([fingerprint(hashes(t, shingle, seed)) for t in text_bytes(column(batch, "text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(prints, "doc_id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row k holds bit k of every fingerprint, 64 to a word; the last word's rest is unset."""
    n = -len(fps) % 64
    bits = np.unpackbits(np.concatenate([fps, np.zeros(n, np.uint64)]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").copy().view("<u8")


def within(queries: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """Bit matrix: for each query, the fingerprints at ``radius`` or fewer differing bits, 64 to a word."""
    sliced_, words = planes(fps), -(-len(fps) // 64)
    depth = int(radius).bit_length()
    query, word = (x.ravel() for x in np.mgrid[0 : len(queries), 0:words])
    count = np.zeros((depth, len(query)), np.uint64)
    over = np.zeros(len(query), np.uint64)
    for k in range(64):
        carry = sliced_[k, word] ^ np.where(queries[query] >> np.uint64(k) & np.uint64(1), FULL, np.uint64(0))
        for level in count:
            carry, level[:] = level & carry, level ^ carry
        over |= carry
        if k % LAYERS == LAYERS - 1:
            exceeded = over | beyond(count, radius)
            live = exceeded != FULL
            if not live.all():
                query, word, count, over = query[live], word[live], count[:, live], over[live]
                if not len(query):
                    break
    out = np.zeros((len(queries), words), np.uint64)
    out[query, word] = ~(over | beyond(count, radius))
    if len(fps) % 64:
        out[:, -1] &= np.uint64((1 << len(fps) % 64) - 1)
    return out


def beyond(count: np.ndarray, radius: int) -> np.ndarray:
    """Where the counters (planes of a number, lowest first) exceed ``radius``."""
    more, equal = np.zeros(count.shape[1], np.uint64), np.full(count.shape[1], FULL)
    for level in range(len(count) - 1, -1, -1):
        if radius >> level & 1:
            equal &= count[level]
        else:
            more |= equal & count[level]
            equal &= ~count[level]
    return more


def links(fps: np.ndarray, sides: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join the same of ``fps`` as all pairs within the radius; sides 1 and 2 are compared across."""
    fps, first = np.unique(fps, return_index=True)
    sides = sides[first]
    left, right = (fps, fps) if not sides.any() else (fps[sides == 1], fps[sides == 2])
    if len(left) == 0 or len(right) == 0 or (left is right and len(left) < 2):
        return []
    near = within(left, right, radius)
    met = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, : len(right)].astype(bool)
    rows, cols = met.sum(axis=1) > (left is right), met.sum(axis=0) > (left is right)
    met, left, right = met[rows][:, cols], left[rows], right[cols]
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    least, least_right = left.copy(), right.copy()
    while len(left):
        best = np.minimum(least, np.where(met, least_right[None, :], top).min(axis=1))
        best_right = np.minimum(least_right, np.where(met, best[:, None], top).min(axis=0))
        if (best == least).all() and (best_right == least_right).all():
            break
        least, least_right = best, best_right
    pairs = np.stack([np.concatenate([least, least_right]), np.concatenate([left, right])], axis=1)
    return list(map(tuple, np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0).tolist()))


def compared(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links within each group of rows that are in order of (key, low, high)."""
    held: list[np.ndarray] = []

    def found(rows: np.ndarray) -> pa.RecordBatch:
        change = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
        bounds = np.concatenate([[0], change, [len(rows)]])
        large = np.flatnonzero(np.diff(bounds) > 1)
        pairs = [p for a, b in zip(bounds[large].tolist(), bounds[large + 1].tolist(), strict=True) for p in links(rows[a:b, 4].view(np.uint64), rows[a:b, 3], radius)]
        flat = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
        rows = np.ascontiguousarray(np.concatenate(held))
        last = int(np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1)).max(initial=-1)) + 1
        if last:
            yield found(rows[:last])
        held = [rows[last:]]
    if held and len(held[0]):
        yield found(held[0])


def block_keys(radius: int, blocks: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number, its bit ranges as (shift, width)) of each choice of blocks that must agree."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    ranges = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return list(enumerate([list(c) for c in combinations(ranges, blocks - radius)]))


def candidate_rows(fps: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(key, low, high, side, fp): rows to be compared meet under (key, low, high)."""
    keys = []
    for number, ranges in block_keys(radius, blocks):
        key, at = F.lit(number).cast("long"), 0
        for shift, width in ranges:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << width) - 1)))
            at += width
        keys.append(key)
    return dealt_rows(fps.select("fp", F.explode(F.array(*keys)).alias("key")))


def dealt_rows(rows: DataFrame) -> DataFrame:
    """(key, low, high, side, fp) of rows (fp, key), large keys as pairs of slices."""
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SLICE)
    dealt = rows.join(staged(large, "large-keys"), "key", "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / SLICE), F.lit(1)).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    each = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    return each.select("key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), side.alias("side"), "fp")


def link_edges(fps: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that join what links join."""
    return compared_rows(candidate_rows(fps, radius, blocks), radius)


def compared_rows(rows: DataFrame, radius: int) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = ["key", "low", "high"]
    return rows.repartition(parts, *group).sortWithinPartitions(*group).mapInArrow(lambda it: compared(it, radius), "a long, b long")


def fingerprint_components(distinct: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(fp, least, component_id) of distinct fingerprints (fp, least): the component's least of ``least``."""
    found = components(link_edges(distinct.select("fp"), radius, blocks))
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = staged(named.groupBy("component").agg(F.min("least").alias("component_id")), "component-ids")
    return staged(named.join(ids, "component").select("fp", "least", "component_id"), "fingerprint-components")


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, blocks: int = 5) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable) of each document (doc_id, text)."""
    prints = staged(fingerprints(docs, shingle), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    by_fp = fingerprint_components(distinct, radius, blocks).select("fp", "component_id")
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, radius: int = 3, shingle: int = 3, blocks: int = 5) -> DataFrame:
    """``docs`` (doc_id, text and any others) with one row of each component: that of its least id, null ids last."""
    row, fp = free_name(docs, "row"), free_name(docs, "fp")

    @F.arrow_udf("long")
    def printed(texts: pa.Array) -> pa.Array:
        fps = np.array([fingerprint(hashes(t, shingle, 42)) for t in text_bytes(texts)], np.uint64)
        return pa.array(fps.view(np.int64))

    rows = staged(docs.withColumns({fp: printed(F.col("text")), row: F.monotonically_increasing_id()}), "numbered-documents")
    mine = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    distinct = staged(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(mine).alias("least")), "distinct-fingerprints")
    kept = fingerprint_components(distinct, radius, blocks).where("least = component_id").select(F.col("least.row").alias("kept_row"))
    gone = rows.select(row).join(kept, F.col(row) == F.col("kept_row"), "left_anti").withColumnRenamed(row, "gone_row")
    return rows.join(staged(gone, "near-duplicates"), F.col(row) == F.col("gone_row"), "left_anti").drop(row, fp)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
ORACLES: dict[str, str] = {}
