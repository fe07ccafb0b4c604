"""Content-addressed store of token ids.

Each document's ids are cut into chunks where a rolling hash of the last ids meets a mask, so that equal
passages give equal chunks wherever they stand. A chunk is stored once under a digest of its bytes. A
document's recipe lists its digests and their Merkle root; the manifest holds, for each range of documents,
their number, their ids and the root of a tree over their recipes, and a last row over all ranges.

Every read recomputes the tree from the recipes and holds it against the manifest, each recipe against its
root, and each chunk against its digest, so that what is damaged, missing or too many anywhere fails the read.

Files under the store's path: ``objects/kind=chunk`` (digest, ids), ``recipes`` in ascending order of
(doc_id, digests) with null ids first, and ``manifest``. All are Parquet, and ids are little-endian unsigned
integers of ``width`` bytes. Buckets and ranges follow the size of the texts, so that a task's share stays the same.

Null texts are empty: they hold the end id alone. Very long texts are encoded whole, one at a time. Each row is a
document of its own, also if its id repeats or is null; of equal ids the one with the lesser digests comes first.
Other columns are not looked at. An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelattice.llm.common import column, fresh_path, sliced, slices_for, table, text_size
from cuelattice.llm.encoding import encoder

#: Ids that the rolling hash sees, and the least, usual and most ids of a chunk.
WINDOW, LEAST, USUAL, MOST = 16, 32, 256, 1024
DIGEST = 16
#: Bytes of chunks that a task gathers before it sends them on, and bytes of text behind a bucket and a range.
GATHERED = 16 << 20
BUCKET, RANGE = 4 << 20, 32 << 20
#: Children of a node of the manifest's tree.
FAN = 1024

PARTS = "kind string, bucket int, doc_id long, n_tokens long, digests binary, lengths binary, data binary, root binary"
OBJECTS = "doc_id long, n_tokens long, digests binary, lengths binary, root binary, digest binary, ids binary, kind string"
RECIPES = "part int, ordinal long, local_start long, doc_id long, n_tokens long, digests binary, lengths binary, root binary"


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over ``leaves``; an odd last node goes up as it is."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def rolling(ids: np.ndarray) -> np.ndarray:
    """Hash of the last WINDOW ids at each place, by doubling the window."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) + np.uint64(1)
        x = (x * np.uint64(0x9E3779B97F4A7C15)) ^ (x * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(29))
        factor, width = np.uint64(0xD6E8FEB86659FD93), 1
        while width < WINDOW:
            x[width:] += x[:-width] * factor
            factor, width = factor * factor, width * 2
    return x


def boundaries(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    wanted = np.flatnonzero((rolling(ids) >> np.uint64(40)) % np.uint64(USUAL) == 0) + 1
    ends, at = [], 0
    for end in wanted.tolist():
        while end - at > MOST:
            at += MOST
            ends.append(at)
        if end - at >= LEAST:
            ends.append(end)
            at = end
    while n - at > MOST:
        at += MOST
        ends.append(at)
    return ends if at == n else [*ends, n]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Recipes of the documents, and each chunk once per task, many of a bucket in one row."""
    enc, pack, names = encoder(path), zstandard.ZstdCompressor(3), PARTS.split(", ")
    end, width = end_id.to_bytes(enc.dtype.itemsize, "little"), enc.dtype.itemsize
    seen: set[bytes] = set()
    held: dict[int, list[tuple[bytes, bytes]]] = {}
    size, turn = 0, TaskContext.get().partitionId() * 7919
    schema = pa.schema([(n.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[n.split()[1]]) for n in names])

    def sent() -> pa.RecordBatch:
        rows = [
            {"kind": "chunk", "bucket": b, "digests": b"".join(d for d, _ in xs), "lengths": np.array([len(x) for _, x in xs], "<u4").tobytes(), "data": pack.compress(b"".join(x for _, x in xs))}
            for b, xs in held.items()
        ]
        held.clear()
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    for batch in sliced(batches, "text", 4 << 20):
        rows = []
        texts = [t or "" for t in column(batch, "text").to_pylist()]
        for doc_id, data in zip(column(batch, "doc_id").to_pylist(), enc.encode(texts), strict=True):
            data += end
            ends = boundaries(np.frombuffer(data, enc.dtype))
            chunks = [data[a * width : b * width] for a, b in zip([0, *ends], ends, strict=False)]
            digests = [digest(c) for c in chunks]
            for d, c in zip(digests, chunks, strict=True):
                if d not in seen:
                    seen.add(d)
                    held.setdefault(int.from_bytes(d[:4], "little") % buckets, []).append((d, c))
                    size += len(c)
            turn += 1  # recipes are dealt out in turn, since copies have equal digests
            rows.append({
                "kind": "recipe", "bucket": turn % buckets, "doc_id": doc_id, "n_tokens": len(data) // width,
                "digests": b"".join(digests), "lengths": np.diff([0, *ends]).astype("<u4").tobytes(), "root": merkle(digests),
            })
        yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if size > GATHERED:
            yield sent()
            size = 0
            if len(seen) > 1 << 20:  # a chunk sent twice is dropped by its bucket
                seen.clear()
    yield sent()


def objects(rows: pa.Table) -> pa.Table:
    """One bucket: its chunks once each, and its recipes as they are."""
    unpack, kept, recipes = zstandard.ZstdDecompressor(), {}, []
    for r in rows.to_pylist():
        if r["kind"] == "recipe":
            recipes.append({k: r[k] for k in ("kind", "doc_id", "n_tokens", "digests", "lengths", "root")})
            continue
        data, at = unpack.decompress(r["data"]), 0
        for i, n in enumerate(np.frombuffer(r["lengths"], "<u4").tolist()):
            kept.setdefault(r["digests"][i * DIGEST : (i + 1) * DIGEST], data[at : at + n])
            at += n
    types = {"kind": pa.string(), "doc_id": pa.int64(), "n_tokens": pa.int64()}
    schema = pa.schema([(n.split()[0], types.get(n.split()[0], pa.binary())) for n in OBJECTS.split(", ")])
    return pa.Table.from_pylist([*recipes, *({"kind": "chunk", "digest": d, "ids": x} for d, x in sorted(kept.items()))], schema=schema)


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of the range, and of the ids and documents before a document in its range."""
    part, start, ordinal = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = column(batch, "n_tokens").to_numpy(zero_copy_only=False)
        before = start + np.cumsum(n) - n
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(ordinal, ordinal + len(n))), pa.array(before.astype(np.int64)), *batch.columns],
            ["part", "ordinal", "local_start", *batch.schema.names],
        )
        start, ordinal = start + int(n.sum()), ordinal + len(n)


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1) -> str:
    """Encodes and stores ``docs`` (doc_id, text) under ``path``, and returns ``path``."""
    spark, size = docs.sparkSession, text_size(docs)
    buckets, ranges = slices_for(docs, size, BUCKET), slices_for(docs, size, RANGE)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: encoded(it, tokenizer_path, end_id, buckets), PARTS)
    (
        rows.repartition(slices_for(docs, size, 4 * BUCKET), "bucket").groupBy("bucket").applyInArrow(objects, OBJECTS)
        .write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/objects")
    )
    order = ["doc_id", "digests"]
    recipes = read_objects(spark, path, "recipe").select("doc_id", "n_tokens", "digests", "lengths", "root")
    (
        recipes.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(placed, RECIPES)
        .write.option("compression", "zstd").parquet(f"{path}/recipes")
    )
    found = recipe_roots(read_recipes(spark, path))
    whole = found.agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.lit(-1).alias("part"), F.col("n").cast("long").alias("n_docs"), F.lit(0).cast("long").alias("n_tokens"), F.lit(range_root(found)).alias("root"))
    found.unionByName(whole).withColumn("width", F.lit(encoder(tokenizer_path).dtype.itemsize)).coalesce(1).write.parquet(f"{path}/manifest")
    return path


def recipe_roots(recipes: DataFrame) -> DataFrame:
    """(part, n_docs, n_tokens, root): the root of a tree of ``FAN`` children a node over each range's recipes.

    Each level is a grouping of at most ``FAN`` rows a group.
    """
    leaf = F.sha2(F.concat_ws("|", "ordinal", "local_start", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "n_tokens", F.hex("root")).cast("binary"), 256)
    level = recipes.select("part", F.col("ordinal").alias("at"), F.col("n_tokens"), F.lit(1).cast("long").alias("n_docs"), leaf.alias("root"))
    most = recipes.agg(F.max("ordinal").alias("n")).first().n or 0
    while True:
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "root"))), lambda x: F.concat_ws(":", x["at"], x["root"])), " ")
        level = level.groupBy("part", F.floor(F.col("at") / FAN).alias("at")).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sha2(children.cast("binary"), 256).alias("root"))
        if most < FAN:
            return level.select("part", "n_docs", "n_tokens", "root")
        most //= FAN


def range_root(ranges: DataFrame) -> str:
    """One hash over the ranges, a row for each of which comes to the driver."""
    rows = sorted((r.part, r.n_docs, r.n_tokens, r.root) for r in ranges.select("part", "n_docs", "n_tokens", "root").collect())
    return hashlib.sha256(repr(rows).encode()).hexdigest()


def verified(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's ranges; raises ``ValueError`` unless these are what the recipes give."""
    written = spark.read.schema("part int, n_docs long, n_tokens long, root string, width int").parquet(f"{path}/manifest")
    ranges, top = written.where("part >= 0"), [r.root for r in written.where("part < 0").collect()]
    if top != [range_root(ranges)]:
        raise ValueError("the manifest is damaged")
    if top != [range_root(recipe_roots(read_recipes(spark, path)))]:
        raise ValueError("the recipes aren't those of the manifest")
    return ranges


def read_objects(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(OBJECTS).parquet(f"{path}/objects").where(F.col("kind") == kind)


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECIPES).parquet(f"{path}/recipes")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The ranges, verified, each with the number of ids before it."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range only
    return verified(spark, path).withColumn("offset", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def zero_operators() -> np.ndarray:
    """Tables that carry a crc32 over 2**k zero bytes: [k, byte of the crc, its value]."""
    table_ = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table_ = np.where(table_ & 1, (table_ >> 1) ^ np.uint32(0xEDB88320), table_ >> 1)
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    columns = (bits >> np.uint32(8)) ^ table_[bits & np.uint32(255)]
    out = np.zeros((48, 4, 256), np.uint32)
    for k in range(48):
        for byte in range(4):
            for bit in range(8):
                held = np.arange(256) >> bit & 1 == 1
                out[k, byte, held] ^= columns[byte * 8 + bit]
        columns = out[k, 0, columns & 255] ^ out[k, 1, columns >> 8 & 255] ^ out[k, 2, columns >> 16 & 255] ^ out[k, 3, columns >> 24]
    return out


def carried(crc: np.ndarray, after: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """What bytes with checksum ``crc`` add to the checksum of a stream in which ``after`` bytes follow."""
    crc = crc.astype(np.uint32)
    for k in range(int(after.max(initial=0)).bit_length()):
        on = np.flatnonzero(after >> k & 1)
        x, t = crc[on], tables[k]
        crc[on] = t[0, x & 255] ^ t[1, x >> 8 & 255] ^ t[2, x >> 16 & 255] ^ t[3, x >> 24]
    return crc


def checked_chunks(spark: SparkSession, path: str, width: int, with_ids: bool = False) -> DataFrame:
    """Each stored chunk's number of ids and crc32 as 32-bit ids, and its ids if asked for.

    A chunk whose bytes don't give its digest fails the job.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, data = column(batch, "digest").to_pylist(), column(batch, "ids").to_pylist()
            for d, x in zip(names, data, strict=True):
                if digest(x) != d:
                    raise ValueError(f"chunk {d.hex()} is damaged")
            crc = [zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4").tobytes()) for x in data]
            made = [column(batch, "digest"), pa.array([len(x) // width for x in data], pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([*made, column(batch, "ids")] if with_ids else made, ["digest", "n_ids", "crc", "ids"][: 3 + with_ids])

    return read_objects(spark, path, "chunk").select("digest", "ids").mapInArrow(check, "digest binary, n_ids long, crc long" + ", ids binary" * with_ids)


def uses(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of each recipe; a recipe whose digests don't give its root fails the job."""
    for batch in batches:
        out: list[tuple[int, int, bytes, int]] = []
        for r in batch.to_pylist():
            ds = [r["digests"][i : i + DIGEST] for i in range(0, len(r["digests"]), DIGEST)]
            if merkle(ds) != r["root"]:
                raise ValueError(f"the recipe of document {r['doc_id']} is damaged")
            ends = np.cumsum(np.frombuffer(r["lengths"], "<u4").astype(np.int64))
            out += zip([r["part"]] * len(ds), [r["ordinal"]] * len(ds), ds, (4 * (ends[-1] - ends)).tolist(), strict=True)
        parts, ordinals, ds, after = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(ordinals, pa.int64()), pa.array(ds, pa.binary()), pa.array(after, pa.int64())], ["part", "ordinal", "digest", "after"])


def read_checksums(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, n_chunks.

    Every chunk is read and checked once; its checksum is carried to its place in each document that uses
    it, so that no ids move. A document whose chunks are not all there fails the job.
    """
    tables = zero_operators()

    @F.pandas_udf("long")
    def shifted(crc, after):
        return crc.__class__(carried(crc.to_numpy(), after.to_numpy(), tables).astype(np.int64))

    summed = (
        read_recipes(spark, path).select("part", "ordinal", "doc_id", "digests", "lengths", "root")
        .mapInArrow(uses, "part int, ordinal long, digest binary, after long")
        .join(checked_chunks(spark, path, width), "digest")
        .groupBy("part", "ordinal")
        .agg(F.bit_xor(shifted("crc", "after")).alias("ids_crc32"), F.sum("n_ids").alias("found"), F.count(F.lit(1)).alias("n_chunks"))
    )
    whole = F.col("found") == F.col("n_tokens")
    return (
        read_recipes(spark, path).select("part", "ordinal", "doc_id", "n_tokens", "local_start")
        .join(summed, ["part", "ordinal"], "left")
        .join(read_manifest(spark, path).select("part", "offset"), "part")
        .select(
            "doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens",
            F.when(whole, F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a document lacks chunks"))).alias("ids_crc32"), "n_chunks",
        )
    )


def read_ids(spark: SparkSession, path: str, width: int) -> DataFrame:
    """The documents with all their ids again: doc_id, start, ids array<int>. What is damaged or missing fails the job."""
    chunk = checked_chunks(spark, path, width, with_ids=True).select("digest", "n_ids", "ids")
    placed_chunks = read_recipes(spark, path).mapInArrow(uses, "part int, ordinal long, digest binary, after long").join(chunk, "digest")
    listed = F.array_sort(F.collect_list(F.struct((-F.col("after")).alias("at"), "ids")))

    @F.pandas_udf("array<int>")
    def joined(xs):
        return xs.map(lambda x: np.frombuffer(b"".join(x), f"<u{width}").astype(np.int32))

    whole = placed_chunks.groupBy("part", "ordinal").agg(F.transform(listed, lambda x: x["ids"]).alias("chunks"), F.sum("n_ids").alias("found"))
    chunks = F.when(F.col("found") == F.col("n_tokens"), F.col("chunks")).otherwise(F.raise_error(F.lit("a document lacks chunks")))
    return (
        read_recipes(spark, path).join(whole, ["part", "ordinal"], "left").join(read_manifest(spark, path).select("part", "offset"), "part")
        .select("doc_id", (F.col("offset") + F.col("local_start")).alias("start"), joined(chunks).alias("ids"))
    )


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores the ids of all documents, and returns what the files hold of each."""
    import public_tokenizers

    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = write_store(table(spark, sf_dir, "documents"), fresh_path(spark, "token-store"), tokenizer)
    return read_checksums(spark, path, encoder(tokenizer).dtype.itemsize)


QUERIES = {"op1_token_store": op1_token_store}
ORACLES: dict[str, str] = {}
