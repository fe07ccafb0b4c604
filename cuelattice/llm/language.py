"""Language identification with error-correcting output codes.

Every learnt language has a codeword. For each bit, a binary classifier weighs hashed n-grams of a text's
bytes (log odds of languages with a 1 against those with a 0) and its margin is scaled by logistic
regression. A text gets the language whose codeword has the least loss against the margins, each bit weighted
by how well it separates the sample. The score is that language's share under a softmax of the losses; a
text is ambiguous if the share is low or its best codeword fits no better than chance.

The classifiers are fitted on whole texts of a bounded sample: about ``per_language`` rows of each language,
those whose id hashes below the language's threshold. Null texts and texts without a letter (Unicode category L) are
``und`` with score 0 and ambiguous, as are all texts if no language was learnt. Rows with a null language or a null
id teach nothing; repeated rows count as often as they stand. Of languages with equal losses the first in the
alphabet is taken, and such a text is ambiguous. Very long texts are read whole, a part at a time. A model is 2 ** BITS
numbers for each bit of the code, so more than ``most_languages`` languages are an error. Scored rows keep all their
columns; the new one gets underscores before its name if that is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.llm.common import free_name, remainder, staged, table

BITS = 16
SIZES = (2, 3, 4)
UNKNOWN = "und"
LEAST_SHARE = 0.6
CHUNK = 1 << 17
LETTER = regex.compile(r"\p{L}")
ASCII_LETTER = regex.compile(rb"[A-Za-z]")
#: Bytes as the classifiers see them: letters in lower case, bytes of other alphabets as they are, the rest as spaces.
SEEN = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def grams(text: bytes) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text, a part at a time."""
    x = SEEN[np.frombuffer(b" " + text + b" ", np.uint8)]
    x = x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])].astype(np.uint32)
    for at in range(0, len(x), CHUNK):
        y = x[at : at + CHUNK + max(SIZES) - 1]
        code = y
        for n in range(2, max(SIZES) + 1):
            code = (code[: len(y) - n + 1] << np.uint32(8)) | y[n - 1 :]
            # a gram belongs to the part in which it begins
            own = code[:CHUNK]
            yield (own * FACTORS[n - 2]) >> np.uint32(32 - BITS)


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text) or LETTER.search(text.decode("utf-8", "replace")))


def codewords(k: int) -> np.ndarray:
    """One row of -1 and 1 for each language; all useful splits for few languages, else the best of some random codes."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 5:
        splits = np.arange((1 << (k - 1)) - 1)
        return np.stack([np.ones(len(splits), int), *[2 * (splits >> i & 1) - 1 for i in range(k - 1)]])
    rng, width = np.random.default_rng(k), int(np.ceil(10 * np.log2(k)))
    best, apart = np.zeros((0, 0)), -1
    for _ in range(200):
        code = rng.choice([-1, 1], (k, width))
        least = int((code[:, None, :] != code[None, :, :]).sum(axis=2)[~np.eye(k, dtype=bool)].min())
        if least > apart and (np.abs(code.sum(axis=0)) < k).all():
            best, apart = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    slope: np.ndarray
    shift: np.ndarray
    trust: np.ndarray

    def margins(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(self.weights.shape[1]), 0
        for idx in grams(text):
            total += self.weights[idx].sum(axis=0, dtype=np.float32)
            n += len(idx)
        return total / max(1, n)

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Loss of each row of margins against each codeword."""
        agreed = (margins * self.slope + self.shift)[:, None, :] * self.code[None, :, :]
        return (np.logaddexp(0, -agreed) * self.trust).sum(axis=2)

    def decode(self, texts: list[bytes]) -> pd.DataFrame:
        known = np.array([bool(self.languages) and has_letter(t) for t in texts], bool)
        named, score, ambiguous = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.ones(len(texts), bool)
        if known.any():
            loss = self.losses(np.stack([self.margins(t) for t, k in zip(texts, known, strict=True) if k]))
            share = np.exp(loss.min(axis=1, keepdims=True) - loss)
            share = share.max(axis=1) / share.sum(axis=1)
            named[known] = np.array(self.languages, object)[loss.argmin(axis=1)]
            score[known] = share
            ambiguous[known] = (share < LEAST_SHARE) | ((loss.min(axis=1) > np.log(2) * self.trust.sum()) & (len(self.languages) > 1))
        return pd.DataFrame({"lang_pred": pd.Series(named, dtype=object), "score": score, "ambiguous": ambiguous})


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Per language, the sum of its texts' n-gram shares."""
    sums: dict[str, np.ndarray] = {}
    for rows in batches:
        for lang, text in zip(rows["lang"], rows["text"], strict=True):
            n = np.zeros(1 << BITS)
            for idx in grams(text.encode()):
                n += np.bincount(idx, minlength=1 << BITS)
            total = sums.setdefault(lang, np.zeros(1 << BITS))
            total += n / max(1, n.sum())
    if sums:
        yield pd.DataFrame({"lang": pd.Series(list(sums), dtype=object), "shares": pd.Series([x.tobytes() for x in sums.values()], dtype=object)})


def fit(docs: DataFrame, per_language: int = 1000, most_languages: int = 500) -> Model:
    """A model of the languages of ``docs`` (doc_id, text, lang)."""
    rows = docs.select("doc_id", "text", "lang").where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((1 << BITS, 1), np.float32), np.ones(1), np.zeros(1), np.ones(1))
    grain = 1 << 20
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(grain, -(-per_language * grain // n)))])
    sample = staged(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(grain)) < share[F.col("lang")]).select("lang", "text"), "language-sample").repartition(4)
    shares = {lang: np.full(1 << BITS, 1e-9) for lang in languages}
    for r in sample.mapInPandas(counted, "lang string, shares binary").collect():
        shares[r.lang] = shares[r.lang] + np.frombuffer(r.shares)
    dist = np.stack([shares[x] / shares[x].sum() for x in languages])
    code, smooth = codewords(len(languages)), 1e-7
    side = lambda s: np.stack([dist[code[:, b] == s].mean(axis=0) if (code[:, b] == s).any() else np.zeros(1 << BITS) for b in range(code.shape[1])], axis=1)
    weights = np.log((side(1) + smooth) / (side(-1) + smooth)).astype(np.float32)
    width = code.shape[1]
    model = Model(languages, code, weights, np.ones(width), np.zeros(width), np.ones(width))
    if len(languages) == 1:
        return model

    def margins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            yield pd.DataFrame({"lang": some["lang"].astype(object), "m": [model.margins(t.encode()) for t in some["text"]]})

    seen = sample.mapInPandas(margins, "lang string, m array<double>").toPandas()
    x, row = np.stack(seen.m.to_numpy()), seen.lang.map({v: i for i, v in enumerate(languages)}).to_numpy()
    for b in range(width):
        y = code[row, b]
        model.slope[b], model.shift[b] = scaled(x[:, b], y)
        model.trust[b] = max(0.05, 2 * np.mean((x[:, b] * model.slope[b] + model.shift[b]) * y > 0) - 1)
    model.trust /= model.trust.mean()
    return model


def scaled(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Slope and shift of a logistic fit of signs ``y``, both sides weighted alike; the ridge keeps separable sides finite."""
    unit = x.std() or 1.0
    design, w = np.stack([x / unit, np.ones_like(x)], axis=1), np.zeros(2)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (weight * ((y > 0) - p)) - ridge * w
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), grad)
        w = w + step * min(1, 3 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0] / unit), float(w[1])


def identify(docs: DataFrame, model: Model, text: str = "text", to: str = "language") -> DataFrame:
    """``docs`` with a new struct (lang_pred, score, ambiguous)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on the number of languages only

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def decoded(texts: pd.Series) -> pd.DataFrame:
        return shared.value.decode([b"" if t is None else t.encode() for t in texts])

    return docs.withColumn(free_name(docs, to), decoded(F.col(text)))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language a model of the others can tell, with their columns."""
    to = free_name(docs, "language")
    return identify(docs, fit(docs.where(remainder("doc_id", 4) != 2)), to=to).where(~F.col(f"{to}.ambiguous")).drop(to)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(remainder("doc_id", 4) != 2))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "language.lang_pred", "language.score", "language.ambiguous")


QUERIES = {"op4_language": op4_language}
ORACLES: dict[str, str] = {}
