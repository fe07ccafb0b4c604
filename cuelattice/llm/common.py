"""What the operators of this package share: tables, written stages, and small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and \\t \\n \\v \\f \\r. ``bytes.split()`` cuts at the same ones.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is named, a temporary one in local mode; on a cluster that fails, since executors wouldn't share it.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not named:
        named = spark.sparkContext.getCheckpointDir() or ""
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cuelattice-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends, and lost executors cost no rework."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``; of a null, that of the empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(modulus)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_size(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts of a column."""
    return df.agg(F.sum(F.octet_length(F.col(text))).alias("n")).first().n or 0


def slices_for(df: DataFrame, amount: int, each: int) -> int:
    """Into how many partitions rows of ``amount`` (bytes or tokens) go at about ``each``; as many as cores at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-amount // each))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def sliced(batches: Iterator[pa.RecordBatch], name: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each slice has about ``most`` bytes of ``name`` (one row at least)."""
    for batch in batches:
        at, size = 0, 0
        for i, n in enumerate(pa.compute.binary_length(column(batch, name)).to_pylist()):
            if size and size + (n or 0) > most:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n or 0
        if batch.num_rows > at:
            yield batch.slice(at)


def bounded_sample(df: DataFrame, id_column: str, keep: Column, most: int) -> DataFrame:
    """At most ``most`` of the rows that ``keep``, those first in the order of a hash of their id."""
    mixed = F.xxhash64(F.col(id_column))
    return df.where(keep).orderBy(mixed, F.col(id_column)).limit(most)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
