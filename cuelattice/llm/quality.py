"""Quality by regularised quadratic discriminant analysis over statistics of a document.

Each text gives a short vector of transformed statistics (logarithms of counts, logits of shares). For each
class, the mean and the covariance come from sums over all labelled rows, added up where the rows are; the
covariance is shrunk towards that of both classes and towards the diagonal of the latter. A text's score is the
logistic of half the difference of its Mahalanobis distances, log determinants and priors, with distances by
Cholesky factors that are inverted once. Since the statistics are not normal, it is tempered by a slope, which is
fitted to the labelled rows' margins under the model of the half of the rows that they are not in.

Null texts are empty; an empty text has its own vector and a score. Very long texts are read whole; equal texts have
equal scores. With labels of one class only, or of none, every score is the share of label 1 (0.5 without
labels). Repeated label rows count as often as they stand; rows with a null id teach nothing. Scored rows keep all
their columns; the new one gets underscores before its name if that is taken.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.llm.common import free_name, remainder, staged, table, text_bytes

NAMES = (
    "words", "word_length", "symbols", "upper", "digits", "marks", "distinct", "repeated_pairs", "repeated_lines",
    "line_length", "packed", "bars", "long_words", "top_word",
)
SYMBOLS = re.compile(rb"[#*$%&|<>=@+^~{}\[\]\\]")
MARKS = re.compile(rb"[.,;:!?]")
UPPER, DIGITS, BAR = re.compile(rb"[A-Z]"), re.compile(rb"[0-9]"), re.compile(rb"\|")
PACKED = 1 << 15


def logit(part: float, whole: float) -> float:
    """Log odds of a share, smoothed so that none and all are finite."""
    return math.log((part + 0.5) / (whole - part + 0.5)) if part <= whole else math.log((part + 0.5) / 0.5)


def packed_share(text: bytes) -> float:
    """Mean share that compression leaves of each stretch of the text."""
    left = [len(zlib.compress(text[i : i + PACKED], 1)) for i in range(0, len(text), PACKED)]
    return sum(left) / max(1, len(text))


def statistics(text: bytes) -> list[float]:
    """The vector of one text."""
    words = text.split()
    n, size = len(words), sum(map(len, words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        math.log1p(n),
        math.log((size + 5) / (n + 1)),
        logit(len(SYMBOLS.findall(text)), size),
        logit(len(UPPER.findall(text)), size),
        logit(len(DIGITS.findall(text)), size),
        logit(len(MARKS.findall(text)), size),
        logit(len(counts), n),
        logit(max(0, n - 1 - pairs), max(1, n - 1)),
        logit(len(lines) - len(set(lines)), len(lines)),
        math.log((n + 5) / (len(lines) + 1)),
        math.log(packed_share(text) + 0.05),
        logit(len(BAR.findall(text)), size),
        logit(sum(len(w) > 20 for w in words), n),
        logit(max(counts.values(), default=0), n),
    ]


def with_statistics(docs: DataFrame, text: str, to: str) -> DataFrame:
    @F.arrow_udf("array<double>")
    def vectors(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t) for t in text_bytes(texts)], pa.list_(pa.float64()))

    return docs.withColumn(free_name(docs, to), vectors(F.col(text)))


@dataclass
class Model:
    """Means, Cholesky factors, log determinants and log priors of the two classes."""

    share: float
    means: list[np.ndarray] = field(default_factory=list)
    factors: list[np.ndarray] = field(default_factory=list)
    logs: list[float] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0
    inverses: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.inverses = [lower_inverse(f) for f in self.factors]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 over that of class 0."""
        density = []
        for mean, inverse, log in zip(self.means, self.inverses, self.logs, strict=True):
            z = inverse @ (x - mean).T
            density.append(log - 0.5 * (z * z).sum(axis=0))
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.slope * squeezed(self.margin(x)) + self.shift, -30, 30)))


def lower_inverse(factor: np.ndarray) -> np.ndarray:
    """Inverse of a lower triangular matrix, by forward substitution."""
    out = np.zeros_like(factor)
    for i in range(len(factor)):
        out[i] = -factor[i, :i] @ out[:i] / factor[i, i]
        out[i, i] += 1 / factor[i, i]
    return out


def squeezed(margin: np.ndarray) -> np.ndarray:
    """Signed logarithm: far tails count for little more than near ones."""
    return np.sign(margin) * np.log1p(np.abs(margin))


def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number, sum and sum of outer products of the vectors of each label and half."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for rows in batches:
        for (y, half), some in rows.groupby(["y", "half"]):
            x = np.stack(some["x"].to_numpy())
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            held[int(y), int(half)] = held.get((int(y), int(half)), 0) + x.T @ x
    if held:
        yield pd.DataFrame({"y": [y for y, _ in held], "half": [h for _, h in held], "m": [m.ravel().tolist() for m in held.values()]})


def discriminant(sums: list[np.ndarray], own: float, diagonal: float) -> Model:
    """The model of both labels' sums; a share only, where a label has fewer than two rows."""
    count = [m[0, 0] for m in sums]
    total, size = sum(count), len(sums[0])
    share = count[1] / total if total else 0.5
    if min(count) < 2:
        return Model(share)
    scatter = [m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / n for m, n in zip(sums, count, strict=True)]
    pooled = (scatter[0] + scatter[1]) / total
    means, factors, logs = [], [], []
    for m, n, own_scatter in zip(sums, count, scatter, strict=True):
        weight = own * n / (n + size)
        cov = weight * own_scatter / n + (1 - weight) * pooled
        factors.append(np.linalg.cholesky((1 - diagonal) * cov + diagonal * np.diag(np.diag(pooled) + 1e-6)))
        means.append(m[0, 1:] / n)
        logs.append(-np.log(np.diag(factors[-1])).sum() + math.log(n / total))
    return Model(share, means, factors, logs)


def fit(vectors: DataFrame, labels: DataFrame, label: str = "quality", own: float = 0.9, diagonal: float = 0.02) -> Model:
    """A model from ``vectors`` (doc_id, x) and ``labels`` (doc_id and ``label``, 0 or 1).

    ``own``: weight of a class's own covariance against the pooled one; ``diagonal``: weight of the pooled diagonal.
    """
    pairs = labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("y")).where("label_id IS NOT NULL AND y IN (0, 1)")
    half = F.pmod(F.xxhash64("label_id"), F.lit(2)).cast("int").alias("half")
    rows = staged(vectors.join(pairs, F.col("doc_id") == F.col("label_id")).select("y", half, "x"), "quality-sample")
    size = len(NAMES) + 1
    sums = np.zeros((2, 2, size, size))
    for r in rows.mapInPandas(moments, "y int, half int, m array<double>").collect():  # a small matrix or four a task
        sums[r.half, r.y] += np.array(r.m).reshape(size, size)
    model = discriminant(list(sums.sum(axis=0)), own, diagonal)
    if model.means:
        others = [discriminant(list(sums[1 - h]), own, diagonal) for h in (0, 1)]
        model.slope, model.shift = tempered(rows, [m if m.means else model for m in others])
    return model


def tempered(rows: DataFrame, models: list[Model], bins: int = 400) -> tuple[float, float]:
    """Logistic fit of the labels to the margins under the model of each half, from a histogram of all labelled rows."""

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows_ in batches:
            for half, some in rows_.groupby("half"):
                m = squeezed(models[int(half)].margin(np.stack(some["x"].to_numpy())))
                yield pd.DataFrame({"y": some["y"].to_numpy(), "b": np.clip(np.round(m * 20), -bins, bins).astype(np.int64)})

    found = rows.mapInPandas(binned, "y int, b long").groupBy("y", "b").agg(F.count(F.lit(1)).alias("n")).toPandas()
    x, y, n = found.b.to_numpy() / 20, found.y.to_numpy(float), found.n.to_numpy(float)
    design, w = np.stack([x, np.ones_like(x)], axis=1), np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (n * (y - p)) - 0.1 * (w - [1, 0])
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2), grad)
        w = w + step * min(1, 1 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return max(0.0, float(w[0])), float(w[1])


def scored(vectors: DataFrame, model: Model, x: str = "x", to: str = "score") -> DataFrame:
    """``vectors`` with the probability of label 1 as a new column ``to``."""

    @F.pandas_udf("double")
    def score(xs: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(xs.to_numpy())) if len(xs) else np.zeros(0))

    return vectors.withColumn(free_name(vectors, to), score(F.col(x)))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labelled ones that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    vectors = staged(with_statistics(docs.select("doc_id", "text"), "text", "x").select("doc_id", "x"), "quality-vectors")
    model = fit(vectors, table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2))
    found = scored(vectors, model)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op6_quality": op6_quality}
ORACLES: dict[str, str] = {}
