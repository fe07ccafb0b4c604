"""Near copies by exact similarity of word shingles.

A document is the set of its five-word shingles. Two documents link where the shingles they share are at least
``SIMILAR`` of those that either has, and a component is all that links reach.

Documents with the same set are one. Two sets are candidates if they share a MinHash key: each of ``BANDS`` keys is
made of ``ROWS`` least hashes, so a pair at similarity s shares one with probability 1 - (1 - s^ROWS)^BANDS: all but six
of 10,000 pairs at 0.8 and more beyond, and 3 of 100 pairs at 0.4. Candidates are never closed transitively. Before two
sets are compared exactly, their SimHash fingerprints may differ in ``RADIUS`` bits at most (at 0.8 they differ in 9.7 on
average, deviation 2.9), and ``PLANES`` bits of each of their BANDS * ROWS least hashes in ``FLIPPED`` hashes at most (56 on
average, deviation 6.8, so that two of 100,000 pairs are lost; at 0.7 84, at 0.65 98, deviation 8.2). The bits are kept as planes.

SimHash goes first, by the operator of ``simhash``: fingerprints of all sets meet in blocks, those within ``NEAR`` bits
are linked by bit planes, and each component of fingerprints is a key. Pairs at 0.8 are mostly farther apart than any
choice of blocks can tell, and they are found by their MinHash keys. Each key has its least set for a leader. Every set is compared with one of its leaders, SimHash's first, those without a link with two
others, then four, and so on until they have no more; links make components. Then keys that still have sets of
several components are compared whole, fingerprints as bit planes, likely pairs first, and only pairs of different components are
compared exactly, within the task that found them: the sets of such pairs are sent to their key, and only links
that join components leave it. So a group of n alike costs a few n exact comparisons, and texts that merely share a template cost
those of their pairs that estimates can't tell from links, though never a row for each. Keys with many sets are dealt out as
pairs of slices, and sets that many others are compared with are dealt out too.

Words are those of ``simhash``; a text of fewer words than a shingle is one shingle, and null texts and texts
without a word are the empty set. Very long texts are read whole. Of the rows with the least id, the one read first
stays. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelattice.llm import simhash
from cuelattice.llm.common import free_name, staged, text_bytes, union_all
from cuelattice.llm.components import components
from cuelattice.llm.decontamination import shingle_hashes, word_hash

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS, RADIUS, PLANES, FLIPPED = 40, 8, 28, 3, 84
#: Differing bits within which SimHash looks for leaders, and the blocks of its keys.
NEAR, BLOCKS = 3, 5
#: Sets that differ in as few of these hashes are compared first, so that fewer of the rest are of different components.
LIKELY = 60
#: Sets of a key that are compared at once; larger keys are dealt out as pairs of slices.
SLICE = 512
_RNG = np.random.default_rng(20)
FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WORDS = BANDS * ROWS // 64
SKETCH = "struct<digest:long,fp:long,bands:array<long>,bits:array<long>>"
SKETCH_TYPE = pa.struct([("digest", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])
IN_GROUP = "key long, low int, high int, side int, digest long, label long"
MEMBER = "struct<n:long,shingles:binary>"
MEMBER_TYPE = pa.struct([("n", pa.int64()), ("shingles", pa.binary())])


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order."""
    words = text.lower().split()
    known = {w: word_hash(w) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    return np.unique(shingle_hashes(h, min(size, len(h)))) if words else h


def digest_of(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes())


def sketch(found: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Digest, band keys, and the planes of some bits of each least hash, of a set of hashes."""
    least = np.full(BANDS * ROWS, simhash.FULL)
    for i in range(0, len(found), 1024):
        least = np.minimum(least, (found[i : i + 1024, None] * FACTORS).min(axis=0))
    mixed = least.reshape(BANDS, ROWS)
    mixed = (mixed ^ mixed >> np.uint64(29)) * MIX
    mixed ^= mixed >> np.uint64(32)
    planes = (mixed.ravel() >> np.arange(PLANES, dtype=np.uint64)[:, None] & np.uint64(1)).astype(bool)
    return digest_of(found), mixed.sum(axis=1, dtype=np.uint64), np.packbits(planes.ravel(), bitorder="little").view("<u8")


#: The digest of a text without a word.
EMPTY = int(np.array([digest_of(np.array([], np.uint64))], np.uint64).view(np.int64)[0])


def lists(rows: list[np.ndarray], width: int) -> pa.Array:
    flat = np.array(rows, np.uint64).reshape(-1).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(flat))


def sketches(texts: pa.Array) -> pa.Array:
    sets = [shingles(t) for t in text_bytes(texts)]
    made = [sketch(x) for x in sets]
    digests, fps = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in ([m[0] for m in made], [simhash.fingerprint(x) for x in sets]))
    return pa.StructArray.from_arrays([digests, fps, lists([m[1] for m in made], BANDS), lists([m[2] for m in made], PLANES * WORDS)], fields=list(SKETCH_TYPE))


def members_of(texts: pa.Array) -> pa.Array:
    """Size and shingles of each text."""
    sets = [shingles(t) for t in text_bytes(texts)]
    return pa.StructArray.from_arrays([pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], fields=list(MEMBER_TYPE))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of hashes that aren't empty."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return shared / (len(a) + len(b) - shared)


def similarities(left: pa.Array, right: pa.Array) -> pa.Array:
    """Similarity of each two sets of hashes, as the bytes of sorted arrays."""
    sets = ((np.frombuffer(x.as_buffer(), np.uint64) for x in pair) for pair in zip(left, right, strict=True))
    return pa.array([similarity(*pair) for pair in sets], pa.float64())


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each group of two rows and more, of rows in order of (key, low, high), the first three columns."""
    key, held = None, []
    for batch in batches:
        at = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:3]], axis=1)
        starts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist()] if len(at) else []
        for a, b in zip(starts, [*starts[1:], len(at)], strict=True):
            if at[a].tolist() != key:
                yield from joined(held)
                key, held = at[a].tolist(), []
            held.append(batch.slice(a, b - a))
    yield from joined(held)


def joined(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of one group as one batch, if they have two rows."""
    if sum(p.num_rows for p in parts) > 1:
        yield pa.concat_batches(parts)


def met(batches: Iterator[pa.RecordBatch], radius: int, flipped: int, similar: float) -> Iterator[pa.RecordBatch]:
    """Pairs of different components that estimates can't rule out, within each group of rows in order of (key, low, high).

    A pair that shares several keys is made in the least of them only: sets of different components leave every key that
    they share open, so each pair meets there.
    """
    for group in groups(batches):
        key, *_, side, digest, label, n, fp = (c.to_numpy(zero_copy_only=False) for c in group.columns[:8])
        bits, bands = (np.array(c.to_pylist(), np.int64) for c in group.columns[8:10])
        bits, fp = bits.view(np.uint64), fp.astype(np.int64).view(np.uint64)
        across = np.unpackbits(simhash.within(fp, fp, radius).view(np.uint8), axis=1, bitorder="little")[:, : len(fp)].astype(bool)
        across &= (label[:, None] != label) & ((side[:, None] != side) | (side == 0)) & (digest[:, None] < digest)
        i, j = np.nonzero(across)
        differ = np.bitwise_or.reduce((bits[i] ^ bits[j]).reshape(-1, PLANES, WORDS), axis=1)
        fit = (np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= flipped) & (np.minimum(n[i], n[j]) >= similar * np.maximum(n[i], n[j]))
        i, j = i[fit], j[fit]
        fit = ~((bands[i] == bands[j]) & (bands[i] < key[0])).any(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(digest[i[fit]]), pa.array(digest[j[fit]])], ["a", "b"])


def involved(batches: Iterator[pa.RecordBatch], radius: int, flipped: int, similar: float) -> Iterator[pa.RecordBatch]:
    """The rows (key, low, high, side, digest, label) of each group that are in one of its pairs."""
    for group in groups(batches):
        for pairs in met(iter([group]), radius, flipped, similar):
            both = np.union1d(*(c.to_numpy(zero_copy_only=False) for c in pairs.columns))
            yield group.select([0, 1, 2, 3, 4, 5]).filter(pa.array(np.isin(group.column(4).to_numpy(zero_copy_only=False), both)))


def linked(batches: Iterator[pa.RecordBatch], radius: int, flipped: int, similar: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that join what the similar pairs of each group join: fewer than it has rows, whose last column is the shingles.

    A pair is compared if no link before it joins its sets.
    """
    for group in groups(batches):
        digest, shingles_of = group.column(4).to_numpy(zero_copy_only=False), group.column(group.num_columns - 1)
        sets = {d: np.frombuffer(x.as_buffer(), np.uint64) for d, x in zip(digest.tolist(), shingles_of, strict=True)}
        label = dict(zip(digest.tolist(), group.column(5).to_pylist(), strict=True))
        of: dict[int, list[int]] = {}
        for d, x in label.items():
            of.setdefault(x, []).append(d)
        found = []
        for pairs in met(iter([group]), radius, flipped, similar):
            for a, b in zip(*(c.to_pylist() for c in pairs.columns), strict=True):
                if label[a] != label[b] and similarity(sets[a], sets[b]) >= similar:
                    found.append((a, b))
                    less, more = sorted((label[a], label[b]), key=lambda x: len(of[x]))
                    for d in of[less]:
                        label[d] = more
                    of[more] += of.pop(less)
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def dealt(count: str, by: str) -> list[Column]:
    """(mine, parts): the slice of a row of a group of ``count`` rows, told by ``by``, and the number of its slices."""
    parts = F.ceil(F.col(count) / SLICE).cast("int")
    return [F.pmod(F.xxhash64(by), parts).cast("int"), parts]


def by_group(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` in order of (key, low, high), each group in one partition."""
    group = ["key", "low", "high"]
    return rows.repartition(parts, *group).sortWithinPartitions(*group)


def plausible(pairs: DataFrame, members: DataFrame, similar: float) -> DataFrame:
    """Those of ``pairs`` (a, b) that estimates and sizes allow."""
    slim = members.select("digest", "n", "fp", "bits")
    side = lambda s: slim.select(*[F.col(c).alias(s if c == "digest" else f"{c}_{s}") for c in slim.columns])
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    differ = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= RADIUS
    apart = lambda i: F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])
    flips = sum((F.bit_count(reduce(Column.bitwiseOR, (apart(p * WORDS + i) for p in range(PLANES)))) for i in range(WORDS)), F.lit(0)) <= FLIPPED
    return both.where(differ & flips & (F.least("n_a", "n_b") >= similar * F.greatest("n_a", "n_b"))).select("a", "b")


def verified(pairs: DataFrame, members: DataFrame, similar: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar; the shingles of a set that many meet are sent to each slice of these."""
    mine, parts = dealt("met", "b")
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("met"))
    counted = pairs.join(sizes, "a").withColumn("slice", mine)
    firsts = members.join(sizes.select(F.col("a").alias("digest"), parts.alias("parts")), "digest")
    left = firsts.select(F.col("digest").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("slice"), F.col("shingles").alias("left"))
    right = counted.join(members.select(F.col("digest").alias("b"), F.col("shingles").alias("right")), "b")
    both = right.join(left, ["a", "slice"])
    return both.where(F.arrow_udf(similarities, "double")("left", "right") >= similar).select("a", "b")


def simhash_keys(distinct: DataFrame) -> DataFrame:
    """(digest, key, least, in_key): the sets of each component that SimHash's links make, under a key of its own."""
    prints = staged(distinct.groupBy("fp").agg(F.min("digest").alias("least")), "distinct-fingerprints")
    named = staged(distinct.select("digest", "fp").join(simhash.fingerprint_components(prints, NEAR, BLOCKS).select("fp", "component_id"), "fp"), "simhash-components")
    sizes = named.groupBy("component_id").agg(F.count(F.lit(1)).alias("in_key")).where("in_key > 1")
    return named.join(sizes, "component_id").select("digest", F.xxhash64("component_id").alias("key"), F.col("component_id").alias("least"), "in_key")


def links(distinct: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Edges (a, b) between digests of ``distinct`` (digest, row, fp, bands, bits) that join what links join; ``texts``: row, text.

    Shingles are made only of texts that share a key or SimHash's component with another; the empty set links to nothing.
    """
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = distinct.where(F.col("digest") != EMPTY)
    keys = distinct.select("digest", F.explode(F.array_distinct("bands")).alias("key"))
    shared = keys.groupBy("key").agg(F.min("digest").alias("least"), F.count(F.lit(1)).alias("in_key")).where("in_key > 1")
    alike, keyed = simhash_keys(distinct).withColumn("last", F.lit(False)), keys.join(shared, "key").withColumn("last", F.lit(True))
    shared = staged(keyed.unionByName(alike), "shared-keys")
    rows = distinct.join(shared.select("digest").distinct(), "digest").select("digest", "row", "fp", "bits", "bands")
    made = texts.join(rows, "row").select("digest", "fp", "bits", "bands", F.arrow_udf(members_of, MEMBER)("text").alias("made"))
    members = staged(made.select("digest", "fp", "bits", "bands", "made.n", "made.shingles"), "members")

    ranked = F.struct("last", F.xxhash64("least").alias("h"), F.col("least").alias("a"))
    leaders = shared.where("digest <> least").groupBy("digest").agg(F.array_sort(F.collect_set(ranked)).alias("of"))
    alone = staged(leaders.select(F.col("digest").alias("b"), F.array_distinct(F.transform("of", lambda x: x["a"])).alias("of")), "leaders")
    found = []
    for r in range(BANDS.bit_length()):
        stars = alone.select(F.explode(F.slice("of", 1 << r, 1 << r)).alias("a"), "b")
        found.append(staged(verified(staged(plausible(stars, members, similar), "plausible-pairs"), members, similar), "star-links"))
        alone = staged(alone.where(F.size("of") >= 2 << r).join(found[-1].select("b").distinct(), "b", "left_anti"), "leaders")
    for most in (LIKELY, FLIPPED):
        labels = staged(components(union_all(found)).withColumnsRenamed({"node": "digest", "component": "label"}), "link-components")
        named = shared.join(labels, "digest", "left").select("key", "digest", F.coalesce("label", "digest").alias("label"))
        several = named.groupBy("key").agg(F.min("label").alias("low_label"), F.max("label").alias("high_label"), F.count(F.lit(1)).alias("in_key")).where("low_label <> high_label")
        mine, n_slices = dealt("in_key", "digest")
        open_rows = named.join(several, "key").withColumns({"mine": mine, "n_slices": n_slices}).join(members.select("digest", "n", "fp", "bits", "bands"), "digest")
        each = open_rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_slices") - 1)))
        side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
        rows = each.select("key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), side.alias("side"), "digest", "label", "n", "fp", "bits", "bands")
        paired = staged(by_group(rows, parts).mapInArrow(lambda it, most=most: involved(it, RADIUS, most, similar), IN_GROUP), "open-sets")
        whole = by_group(paired.join(members, "digest").select(*paired.columns, "n", "fp", "bits", "bands", "shingles"), parts)
        joining = staged(whole.mapInArrow(lambda it, most=most: linked(it, RADIUS, most, similar), "a long, b long").distinct(), "open-pairs")
        found.append(staged(verified(joining, members, similar), "open-links"))
    return union_all(found)


def keep_first(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``docs`` (doc_id, text and any others) with one row of each component: that of its least id, null ids last."""
    row, sk = free_name(docs, "row"), free_name(docs, "sketch")
    rows = staged(docs.withColumns({sk: F.arrow_udf(sketches, SKETCH)(F.col("text")), row: F.monotonically_increasing_id()}), "numbered-documents")
    mine = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    found = rows.groupBy(F.col(f"{sk}.digest").alias("digest")).agg(F.min(mine).alias("least"), F.first(f"{sk}.fp").alias("fp"), F.first(f"{sk}.bands").alias("bands"), F.first(f"{sk}.bits").alias("bits"))
    distinct = staged(found, "distinct-sets")
    texts = rows.select(F.col(row).alias("row"), "text")
    ends = components(links(distinct.select("digest", F.col("least.row").alias("row"), "fp", "bands", "bits"), texts, similar)).withColumnRenamed("node", "digest")
    named = distinct.select("digest", "least").join(ends, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    kept = named.groupBy("component").agg(F.min("least").alias("least")).select(F.col("least.row").alias("kept_row"))
    gone = rows.select(row).join(kept, F.col(row) == F.col("kept_row"), "left_anti").withColumnRenamed(row, "gone_row")
    return rows.join(staged(gone, "near-duplicates"), F.col(row) == F.col("gone_row"), "left_anti").drop(row, sk)
