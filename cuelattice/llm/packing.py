"""Packing by powers of two: a document's ids are cut into pieces of binary lengths, longest first.

Each piece is a training sequence of its own, so no sequence crosses documents and none needs padding;
sequences of one length form a bucket, which is a folder of its own. Null texts are empty and hold the end id alone.
Very long texts are encoded whole, one at a time. Each row is a document of its own, also if its text or id
repeats or the id is null; other columns are not looked at. An empty table gives no sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.llm.common import column, fresh_path, sliced, table
from cuelattice.llm.encoding import encoder

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def lengths(n: int, most: int) -> list[int]:
    """Powers of two, at most ``most`` each (a power of two itself), that add up to ``n``, longest first."""
    rest = n % most
    return [most] * (n // most) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, most: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    end = end_id.to_bytes(enc.dtype.itemsize, "little")
    for batch in sliced(batches, "text", 4 << 20):
        doc, start, length, total, ids = [], [], [], [], []
        texts = [t or "" for t in column(batch, "text").to_pylist()]
        for doc_id, data in zip(column(batch, "doc_id").to_pylist(), enc.encode(texts), strict=True):
            wide = np.frombuffer(data + end, enc.dtype).astype("<u4").tobytes()
            at, n = 0, len(wide) // 4
            for k in lengths(n, most):
                doc.append(doc_id)
                start.append(at)
                length.append(k)
                total.append(n)
                ids.append(wide[4 * at : 4 * (at + k)])
                at += k
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, length, total)] + [pa.array(ids, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "ids"])


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, most: int = 2048) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text): doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    ``ids`` are little-endian 32-bit integers; ``length`` is also the bucket. Nothing is shuffled: a
    sequence's number is made of its task's number and its place there.
    """
    if most & (most - 1):
        raise ValueError("most must be a power of two")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: pieces(it, tokenizer_path, end_id, most), PIECES)
    return rows.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def bucketed(packed: DataFrame, path: str, most: int = 2048) -> DataFrame:
    """The pieces as written under ``path``, a folder for each length up to ``most``, and read back.

    A task keeps a file open for each length, so that it need not sort its pieces.
    """
    spark, name = packed.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most.bit_length()))
    try:
        packed.write.option("compression", "snappy").partitionBy("length").parquet(path)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(packed.schema).parquet(path).select(*packed.columns)


def digest_columns(packed: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids in place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 2048 ids, writes their buckets, and returns what these hold."""
    import public_tokenizers

    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return digest_columns(bucketed(packed, fresh_path(spark, "packed")))


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
