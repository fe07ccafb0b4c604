"""Benchmark decontamination by SimHash of item-sized windows.

A benchmark item and windows of a document that are as long as it are fingerprinted by the majority bits of
their word shingles' hashes, each weighted by its repeats. The fingerprints' bits are cut into ``radius`` + 1
blocks; two fingerprints within the radius agree on one of them, so a look-up by block finds them all. Candidates
within the radius are verified by the exact similarity of their weighted shingles, the sum of the lesser over
the sum of the greater weights.

Seeds. At so wide a radius blocks alone tell little apart, so they only look at items that a window may match: a
window at the similarity has all but a fifth of an item's shingles, so of any fifth of them and one more it has one.
These seeds are the shingles that are rarest in the benchmark. A filter of bounded size over all seeds picks out the
documents' shingles that may be seeds, a join by hash names their items, and windows with a seed of an
item are looked up among the items of their seeds, ``GROUP`` at most at a time. The filter's false finds drop out in
the join.

At similarity 0.8 fingerprints differ in 9.7 bits on average (deviation 2.9), so a radius of 24 loses about
one in a million windows at the threshold, and fewer beyond.

Words are runs of characters other than white space, with A-Z in lower case; items with fewer words than a
shingle are one shingle. A document with fewer words than an item is one window. Null and empty texts hold
nothing, and items without a word match nothing. Copies of an item are all found, as are its repeats in a document
that don't overlap; of overlapping ones the most similar, then the first. Very long texts are read whole. Equal
texts are searched once. Rows keep all their columns, also those with names that are used here.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelattice.llm.common import column, free_name, sliced, staged, table, text_bytes

SHINGLE, SIMILAR, RADIUS = 5, 0.8, 24
#: Windows that are fingerprinted at once, and items that are held against a document at once.
BLOCK, GROUP = 2048, 256
#: Bits of the seeds' filter: 2 ** 12 a seed, 2 ** FILTER at most (32 MB), in slices of 2 ** 16; two are on for each
#: seed, the first of its hash and those SECOND places on.
FILTER, SECOND = 28, 24
#: Contaminated texts whose keys are broadcast at most (about 64 bytes each); beyond it they are joined by shuffle.
BROADCAST = 1_000_000

ITEMS = "item_id long, digest binary, k int, n_words long, fp long, shingles binary"
SEEDED = "key string, text string, seeds array<struct<k:int,at:long,h:long>>"
HITS = "key string, item long, start long, n_words long, similarity double"


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) | 1


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes."""
    n = len(words) - k + 1
    out = np.zeros(max(0, n), np.uint64)
    for i in range(k if n > 0 else 0):
        out = (out ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def hashes_of(text: bytes) -> np.ndarray:
    """Hash of each word of a text."""
    words = text.lower().split()
    known = {w: word_hash(w) for w in set(words)}
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def bits_of(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)


def packed(ones: np.ndarray, count: int) -> np.ndarray:
    """Fingerprints from the number of hashes with each bit, of ``count`` hashes."""
    return np.packbits(2 * ones > count, axis=1, bitorder="little").copy().view("<u8").ravel()


@dataclass
class Items:
    """Items of one shingle size and length in words, with their fingerprints by block."""

    ids: list[int]
    shingles: list[np.ndarray]
    prints: np.ndarray
    blocks: list[tuple[int, int, np.ndarray, np.ndarray]] = field(default_factory=list)

    def index(self, radius: int) -> None:
        edges = [64 * i // (radius + 1) for i in range(radius + 2)]
        for a, b in zip(edges, edges[1:], strict=False):
            value = self.prints >> np.uint64(a) & np.uint64((1 << (b - a)) - 1)
            order = np.argsort(value, kind="stable")
            self.blocks.append((a, b - a, value[order], order))

    def near(self, prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
        """(window, item) of all fingerprints at ``radius`` or fewer differing bits."""
        met = []
        for shift, width, values, order in self.blocks:
            value = prints >> np.uint64(shift) & np.uint64((1 << width) - 1)
            low, high = np.searchsorted(values, value), np.searchsorted(values, value, "right")
            n = high - low
            window = np.repeat(np.arange(len(prints)), n)
            item = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
            met.append(window * len(order) + item)
        pairs = np.unique(np.concatenate(met))
        window, item = pairs // len(self.ids), pairs % len(self.ids)
        close = np.bitwise_count(prints[window] ^ self.prints[item]) <= radius
        return list(zip(window[close].tolist(), item[close].tolist(), strict=True))


def windows(words: np.ndarray, seeds: np.ndarray, group: Items, k: int, n: int, radius: int, similar: float) -> list[tuple[int, int, int, float]]:
    """(item, start, words, similarity) of verified windows of ``n`` words around the seeds' places in ``words``."""
    n = min(n, len(words))
    width, shingles, best = n - k + 1, shingle_hashes(words, k), []
    marked = np.zeros(len(words) - n + 2, np.int64)
    np.add.at(marked, np.maximum(0, seeds - width + 1), 1)
    np.add.at(marked, np.minimum(len(words) - n, seeds) + 1, -1)
    starts = np.flatnonzero(np.cumsum(marked)[:-1] > 0)
    for part in np.split(starts, np.flatnonzero(np.diff(starts) > width) + 1):
        for i in range(0, len(part), BLOCK):
            s = part[i : i + BLOCK]
            sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits_of(shingles[s[0] : s[-1] + width]), axis=0)])
            prints = packed(sums[s - s[0] + width] - sums[s - s[0]], width)
            for w, item in group.near(prints, radius):
                mine, theirs = Counter(shingles[s[w] : s[w] + width].tolist()), group.shingles[item]
                shared = sum((mine & Counter(theirs.tolist())).values())
                alike = shared / (width + len(theirs) - shared)
                if alike >= similar:
                    best.append((-alike, int(s[w]), item))
    out, taken = [], {}
    for alike, start, item in sorted(best):
        near = taken.setdefault(item, [])
        at = bisect(near, start)
        if all(abs(start - x) >= n for x in near[max(0, at - 1) : at + 1]):
            insort(near, start)
            out.append((group.ids[item], start, n, -alike))
    return out


def searched(text: pa.Table, items: pa.Table, radius: int, similar: float) -> pa.Table:
    """Hits of one document and a group of the items whose seeds it has."""
    row, out = text.to_pylist()[0], []
    words = hashes_of((row["text"] or "").encode("utf-8", "surrogatepass"))
    sizes: dict[tuple[int, int], list[dict]] = {}
    for r in items.to_pylist():
        sizes.setdefault((r["k"], r["n_words"]), []).append(r)
    for (k, n), rows in sorted(sizes.items()):
        group = Items([r["item"] for r in rows], [np.frombuffer(r["shingles"], np.uint64) for r in rows], np.array([r["fp"] for r in rows], np.int64).view(np.uint64))
        group.index(radius)
        out += windows(words, np.unique(np.concatenate([r["ats"] for r in rows])), group, k, n, radius, similar)
    names = [c.split()[0] for c in HITS.split(", ")]
    columns = list(zip(*out, strict=True)) or [()] * 4
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    return pa.Table.from_arrays([pa.array([row["held"]] * len(out), pa.string()), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names)


def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprint and shingles of each item with a word."""
    names = [c.split()[0] for c in ITEMS.split(", ")]
    types = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        out = []
        for item_id, text in zip(column(batch, "item_id").to_pylist(), text_bytes(column(batch, "text")), strict=True):
            words = hashes_of(text)
            if len(words):
                k = min(SHINGLE, len(words))
                h = shingle_hashes(words, k)
                fp = packed(bits_of(h).sum(axis=0, keepdims=True), len(h)).view(np.int64)
                out.append((item_id, xxhash.xxh3_128_digest(b" ".join(text.lower().split())), k, len(words), int(fp[0]), h.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 6, types, strict=True)], names)


def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each item."""
    for batch in batches:
        for item, k, data in zip(*(column(batch, c).to_pylist() for c in ("item", "k", "shingles")), strict=True):
            h = np.frombuffer(data, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), item)), pa.array(np.full(len(h), k, np.int32)), pa.array(h)], ["item", "k", "h"])


def seeds_of(items: DataFrame, similar: float) -> DataFrame:
    """(item, k, h): the rarest shingles of each item, so many that every window at the similarity has one."""
    each = items.mapInArrow(spelled, "item long, k int, h long")
    common = each.groupBy("k", "h").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("n", "h"))
    size = items.select("item", (F.col("n_words") - F.col("k") + 1).alias("size"))
    ranked = each.join(common, ["k", "h"]).join(size, "item").withColumn("rank", rank)
    return ranked.where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * similar - 1e-9) + 1).select("item", "k", "h").distinct()


def seed_filter(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """The filter, and how many bits of a hash choose a place in it. The driver gets 32 MB at most."""
    bits = min(FILTER, max(20, math.ceil(math.log2(max(1, seeds.count()))) + 12))

    def merged(rows: pa.Table) -> pa.Table:
        on = np.zeros(1 << 16, np.uint8)
        on[rows.column("slot").to_numpy() & 0xFFFF] = 1
        return pa.table({"slice": pa.array([rows.column("slice")[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    both = F.array(F.shiftrightunsigned("h", 64 - bits), F.shiftrightunsigned(F.shiftleft("h", SECOND), 64 - bits))
    slots = seeds.select(F.explode(both).alias("slot")).distinct().withColumn("slice", F.shiftright("slot", 16))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in slots.groupBy("slice").applyInArrow(merged, "slice long, bits binary").collect():  # 8 kB each, 4096 at most
        out[r.slice << 13 : (r.slice + 1) << 13] = np.frombuffer(r.bits, np.uint8)
    return out, bits


def is_on(known: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Whether the bits at the given places are on."""
    return (known[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1) > 0


def seeded(docs: DataFrame, text: str, seeds: DataFrame) -> DataFrame:
    """The texts that may hold a seed, once each: key, text, and where which shingle may be one."""
    on, bits = seed_filter(seeds)
    sizes = sorted(r.k for r in seeds.select("k").distinct().collect())  # five at most
    shared = docs.sparkSession.sparkContext.broadcast(on)
    names = ["key", "text", "seeds"]
    kind = pa.list_(pa.struct([("k", pa.int32()), ("at", pa.int64()), ("h", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in sliced(batches, "text"):
            keys, rows, found = [], [], []
            for i, data in enumerate(text_bytes(column(batch, "text"))):
                words, met = hashes_of(data), []
                for k in sizes:
                    h = shingle_hashes(words, k)
                    at = np.flatnonzero(is_on(known, h >> np.uint64(64 - bits)))
                    at = at[is_on(known, h[at] << np.uint64(SECOND) >> np.uint64(64 - bits))]
                    met += [{"k": k, "at": a, "h": x} for a, x in zip(at.tolist(), h[at].view(np.int64).tolist(), strict=True)]
                if met:
                    keys.append(hashlib.md5(data).hexdigest())
                    rows.append(i)
                    found.append(met)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), column(batch, "text").take(pa.array(rows, pa.int64())), pa.array(found, kind)], names)

    every = docs.select(F.col(text).alias("text")).mapInArrow(scan, SEEDED)
    return every.groupBy("key").agg(F.first("text").alias("text"), F.first("seeds").alias("seeds"))


def key_of(text: str) -> Column:
    """The key of a row's text."""
    return F.md5(F.col(text).cast("binary"))


def candidates(texts: DataFrame, seeds: DataFrame) -> DataFrame:
    """(key, item, ats): the places of an item's seeds in a text that has any."""
    met = texts.select("key", F.explode("seeds").alias("s")).select("key", "s.*")
    return met.join(seeds, ["k", "h"]).groupBy("key", "item").agg(F.sort_array(F.collect_list("at")).alias("ats"))


def matches(docs: DataFrame, items: DataFrame, text: str = "text", radius: int = RADIUS, similar: float = SIMILAR) -> DataFrame:
    """(key, item_id, start, n_words, similarity) of each item (item_id, text) found in a text with the key."""
    named = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(prepared, ITEMS)
    named = staged(named, "benchmark-items")
    firsts = named.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("k", "n_words", "fp", "shingles")])
    distinct = staged(firsts.withColumn("item", F.monotonically_increasing_id()), "benchmark-texts")
    seeds = staged(seeds_of(distinct, similar), "benchmark-seeds")
    texts = staged(seeded(docs, text, seeds), "seeded-texts")
    held = candidates(texts, seeds).join(distinct, "item").withColumn("slice", F.floor(F.col("item") / GROUP))
    held = staged(held.select("key", "slice", "item", "k", "n_words", "fp", "shingles", "ats"), "candidate-items")
    groups = held.select(F.col("key").alias("held"), F.col("slice").alias("part")).distinct()
    whole = texts.select("key", "text").join(groups, F.col("key") == F.col("held")).select(F.col("held"), F.col("part"), "text")
    found = whole.groupBy("held", "part").cogroup(held.groupBy("key", "slice")).applyInArrow(lambda t, i: searched(t, i, radius, similar), HITS)
    copies = named.join(distinct.select("digest", "item"), "digest").select("item", "item_id")
    return staged(found.join(copies, "item").select("key", "item_id", "start", "n_words", "similarity"), "benchmark-hits")


def find(docs: DataFrame, items: DataFrame, text: str = "text", to: str = "hits", radius: int = RADIUS, similar: float = SIMILAR) -> DataFrame:
    """``docs`` with a new array of the items (item_id, text) found in each text: item_id, start, n_words, similarity.

    The array is called ``to``, with underscores before it if a column is called so.
    """
    to = free_name(docs, to)
    key = free_name(docs, "key")
    listed = F.array_sort(F.collect_list(F.struct("start", "item_id", "n_words", "similarity")))
    ordered = F.transform(listed, lambda x: F.struct(x["item_id"].alias("item_id"), x["start"].alias("start"), x["n_words"].alias("n_words"), x["similarity"].alias("similarity")))
    hits = matches(docs, items, text, radius, similar).groupBy(F.col("key").alias(key)).agg(ordered.alias(to))
    none = F.array().cast("array<struct<item_id:long,start:long,n_words:long,similarity:double>>")
    return docs.join(hits, key_of(text) == F.col(key), "left").drop(key).withColumn(to, F.coalesce(to, none))


def keep_uncontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no item is found, with their columns."""
    key = free_name(docs, "key")
    bad = staged(matches(docs, items).select(F.col("key").alias(key)).distinct(), "contaminated-texts")
    few = bad.count() <= BROADCAST
    return docs.join(F.broadcast(bad) if few else bad, key_of("text") == F.col(key), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item found in a document: doc_id, item_id, start (words before it), n_words, similarity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = matches(docs, table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", key_of("text").alias("key")).join(hits, "key").drop("key")


QUERIES = {"op2_decontamination": op2_decontamination}
ORACLES: dict[str, str] = {}
