"""Vector codes: product quantisation whose assignments are found by exponion search.

Components become integers, floor(``scale`` * x), and vectors are cut into equal parts. Each part position has a codebook
that starts as that part of the vectors with the least ids. A round assigns every part to the nearest entry (squared
distance, ties to the lower index) and moves each entry to the floor of its parts' mean; an unused entry stays. At the
end parts are assigned once more.

The search for a part starts at its previous entry a (0 at first), at squared distance U. An entry that is as near or
nearer lies within 2 * sqrt(U) of a by the triangle inequality, so its squared distance to a is at most 4 * U, which is
an integer test. Each entry keeps the others in order of distance, and the scan of that list stops at the first one
beyond. All distances are exact integers.

A round reads the vectors with their previous codes, writes them with the new ones (a written table, so that lost
executors cost no rework), and sums what it wrote: a task sends a row for each part and entry, and the driver takes one
for each part and entry of all. Nothing else is collected, and vectors are never shuffled.

Vectors that are null, or hold a null or non-finite component, are left out. All others must have the same length, a
multiple of ``parts``, and components small enough that sums of squares fit 64 bits; otherwise an error says so. Rows
with a null id come last in the order of ids; of equal ids the vector that is smaller in lexical order comes first.
Every row is coded on its own, also if it repeats. With fewer rows than entries a codebook has an entry a row. Null labels
are one label. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.llm.common import column, free_name, staged, table

#: Vectors that are assigned at once.
BLOCK = 2048
#: Into how many pieces a label's rows are dealt when they meet its sum.
SALTS = 16


def quantised(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is there, and all of its components are there and finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


class Codebooks:
    """Entries of each part position, and for each entry the others in order of distance."""

    def __init__(self, entries: np.ndarray):
        """``entries``: part, entry, position within the part."""
        self.entries = entries.astype(np.int64)
        apart = self.entries[:, :, None, :] - self.entries[:, None, :, :]
        between = (apart * apart).sum(axis=3)
        self.order = np.argsort(between, axis=2, kind="stable")
        self.far = np.take_along_axis(between, self.order, axis=2)

    def nearest(self, part: int, x: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row of ``x`` and its squared distance; ties to the lower index."""
        entries, order, far = self.entries[part], self.order[part], self.far[part]
        off = x - entries[previous]
        best, index = (off * off).sum(axis=1), previous.astype(np.int64)
        enough = np.empty(len(x), np.int64)
        for a in np.unique(previous).tolist():
            at = previous == a
            enough[at] = np.searchsorted(far[a], 4 * best[at], "right")
        by_scan = np.argsort(-enough, kind="stable")  # those that scan furthest first, so that each step is a prefix
        x, start, best, index = x[by_scan], previous[by_scan], best[by_scan], index[by_scan]
        left = np.cumsum(np.bincount(enough, minlength=len(entries) + 1)[::-1])[::-1]  # rows that scan k or more
        for k in range(len(entries)):
            n = int(left[k + 1])
            if not n:
                break
            other = order[start[:n], k]
            off = x[:n] - entries[other]
            d = np.einsum("ij,ij->i", off, off)
            better = (d < best[:n]) | ((d == best[:n]) & (other < index[:n]))
            best[:n] = np.where(better, d, best[:n])
            index[:n] = np.where(better, other, index[:n])
        back = np.empty_like(by_scan)
        back[by_scan] = np.arange(len(by_scan))
        return index[back], best[back]

    def moved(self, sums: list[tuple[int, int, int, list[int]]]) -> Codebooks:
        """Entries at the floored means of their parts; ``sums``: part, entry, count, sum of each component."""
        entries = self.entries.copy()
        for part, entry, n, total in sums:
            entries[part, entry] = [t // n for t in total]
        return Codebooks(entries)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def blocks(batch: pa.RecordBatch, parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with their vectors as (row, part, position)."""
    for at in range(0, batch.num_rows, BLOCK):
        rows = batch.slice(at, BLOCK)
        yield rows, column(rows, "vector").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows.num_rows, parts, -1)


def assigned(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    """The rows with a new ``code`` (a byte a part) and ``error`` (all parts' squared distances)."""
    parts = len(books.entries)
    for batch in batches:
        for rows, vectors in blocks(batch, parts):
            previous = np.frombuffer(b"".join(column(rows, "code").to_pylist()), np.uint8).reshape(-1, parts)
            codes, error = np.empty_like(previous), np.zeros(len(vectors), np.int64)
            for part in range(parts):
                index, d = books.nearest(part, vectors[:, part], previous[:, part])
                codes[:, part] = index
                error += d
            fresh = {"code": pa.array([c.tobytes() for c in codes], pa.binary()), "error": pa.array(error)}
            yield pa.RecordBatch.from_arrays([fresh.get(name, column(rows, name)) for name in rows.schema.names], rows.schema.names)


def summed(batches: Iterator[pa.RecordBatch], parts: int, entries: int) -> Iterator[pa.RecordBatch]:
    """A task's number and componentwise sum of the parts of each entry in use."""
    counts, sums = np.zeros((parts, entries), np.int64), None
    for batch in batches:
        for rows, vectors in blocks(batch, parts):
            codes = np.frombuffer(b"".join(column(rows, "code").to_pylist()), np.uint8).reshape(-1, parts)
            if sums is None:
                sums = np.zeros((parts, entries, vectors.shape[2]), np.int64)
            for part in range(parts):
                np.add.at(sums[part], codes[:, part], vectors[:, part])
                counts[part] += np.bincount(codes[:, part], minlength=entries)
    if sums is not None:
        part, entry = np.nonzero(counts)
        found = pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), found], ["part", "entry", "n", "total"])


def entry_sums(coded: DataFrame, parts: int, entries: int, width: int) -> list[tuple[int, int, int, list[int]]]:
    """Count and sum of the parts of each entry in use: at most parts * entries rows."""
    each = coded.select("vector", "code").mapInArrow(lambda it: summed(it, parts, entries), "part long, entry long, n long, total array<long>")
    total = F.array(*[F.sum(F.col("total")[i]) for i in range(width)])
    return [tuple(r) for r in each.groupBy("part", "entry").agg(F.sum("n").alias("n"), total.alias("total")).collect()]


def first_entries(rows: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """The codebooks of the vectors with the least ids; None if there is no vector."""
    least = rows.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    return Codebooks(np.array([r.vector for r in least], np.int64).reshape(len(least), parts, -1).transpose(1, 0, 2)) if least else None


def checked_width(rows: DataFrame, parts: int) -> int:
    """The length of all vectors; an error if they differ, can't be cut, or hold components that are too large."""
    got = rows.agg(
        F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most"), F.count(F.lit(1)).alias("n"),
        F.max(F.greatest(F.abs(F.array_max("vector")), F.abs(F.array_min("vector")))).alias("large"),
    ).first()
    if got.n and (got.least != got.most or got.most % parts or not got.most):
        raise ValueError(f"vectors have {got.least} to {got.most} components; all must have the same number, a multiple of {parts}")
    if got.n and max(4 * got.most * (2 * got.large) ** 2, got.n * got.large) >= 2**63:
        raise ValueError(f"a component of {got.large} is too large for exact 64-bit sums")
    return got.most or 0


def encode(
    vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", keep: tuple[str, ...] = ("vec_id",), parts: int = 16, entries: int = 64,
    rounds: int = 2, scale: int = 256,
) -> tuple[DataFrame, Codebooks | None]:
    """The ``keep`` columns of usable vectors with code (a byte a part) and error, and the codebooks that they refer to."""
    if entries > 256:
        raise ValueError("a code is a byte, so a codebook has at most 256 entries")
    kept = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    given = vectors.where(usable(F.col(vector))).select(*kept, F.col(vec_id).alias("id"), quantised(F.col(vector), scale).alias("vector"))
    rows = given.withColumns({"code": F.lit(bytes(parts)), "error": F.lit(0).cast("long")})
    width, books = checked_width(rows, parts) // parts, first_entries(rows, parts, entries)
    if books is not None:
        for _ in range(rounds):
            rows = staged(assign(rows, books), "vector-codes")
            books = books.moved(entry_sums(rows, parts, entries, width))
        rows = assign(rows, books)
    coded = staged(rows.drop("vector", "id"), "final-vector-codes")
    left = vectors.select(*keep)
    names = [F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)]
    return coded.select(*names, *[F.col(c).alias(free_name(left, c)) for c in ("code", "error")]), books


def assign(rows: DataFrame, books: Codebooks) -> DataFrame:
    return rows.mapInArrow(lambda it: assigned(it, books), rows.schema)


def summed_over(rows: DataFrame, label: str, value: str, total: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows of the same label, nulls together; a label's rows are dealt out."""
    absent, label_key = F.col(label).isNull(), F.coalesce(F.col(label).cast("string"), F.lit(""))
    keyed = rows.withColumns({"_no_label": absent, "_label": label_key, "_salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")})
    sums = keyed.groupBy("_no_label", "_label").agg(F.sum(value).alias(total)).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return keyed.join(sums, ["_no_label", "_label", "_salt"]).drop("_no_label", "_label", "_salt")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings, with the errors of each label and the codebooks' digest."""
    coded, books = encode(table(spark, sf_dir, "embeddings"), keep=("vec_id", "label"))
    out = summed_over(coded, "label", "error", "label_error")
    digest = F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256")
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", digest)


def _round(n: int) -> str:
    """SQL of assignment number ``n`` and, but for the last, of the entries that follow from it."""
    return f"""
a{n} AS (SELECT r, p, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (
  SELECT x.r, x.p, c.e, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM x JOIN c{n} c USING (p)) GROUP BY r, p)"""


def _means(n: int) -> str:
    return f"""
s{n} AS (SELECT p, e, i, sum(x.v[i])::BIGINT AS t, count(*) AS k FROM a{n} JOIN x USING (r, p), unnest(range(1, len(x.v) + 1)) u(i) GROUP BY p, e, i),
m{n} AS (SELECT p, e, list((t - ((t % k) + k) % k) // k ORDER BY i) AS v FROM s{n} GROUP BY p, e),
c{n + 1} AS (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN m{n} m USING (p, e))"""


_STEPS = reduce(lambda sql, n: f"{sql},{_round(n)},{_means(n)}", range(2), "")

QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLES = {
    "op12_vector_codes": f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, q) AS r FROM k),
x AS (SELECT r, p, q[p * (len(q) // 16) + 1 : (p + 1) * (len(q) // 16)] AS v FROM n, unnest(range(0, 16)) u(p)),
c0 AS (SELECT p, r - 1 AS e, v FROM x WHERE r <= 64){_STEPS},{_round(2)},
b AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2),
f AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM n JOIN f USING (r), b""",
}
