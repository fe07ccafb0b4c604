"""Toxicity by a subsequence string kernel with Nyström landmarks and a linear support vector machine on sentences.

The kernel of two words sums over their common subsequences of ``ORDER`` letters, each weighted by
``DECAY`` to the letters it spans, so a word keeps most of its kernel with an insult when letters are left
out, put in or written apart. Landmarks span the feature space (Nyström): windows of the words that mark toxic
sentences beyond chance, no two of them alike.

The machine is trained on labelled sentences. A sentence has the label of its documents, clean if one is, and
its features are the kernels of its worst word with the landmarks. Which word is worst depends on the machine, so
the two are found in turn, ``rounds`` times: all clean sentences are negative; of a toxic document the
sentences with a margin over 0 are positive, or else its worst one with a margin over -0.5, since the rest of it may
well be clean. A text is judged by
the margins of its two worst words, so that the first is the margin of its worst sentence. These margins are
mapped to probabilities by logistic regression, weighted to the share of each label among all labelled rows.

Training reads whole texts of a bounded sample of labelled documents (``per_class`` of either label at most, the
first in the order of a hash of their ids), every sentence of them and every word of these. The machine's Newton
steps sum over the sentences where they are; the driver gets sums, landmarks and the sample's document margins.

Null and empty texts, and texts without a word of ORDER letters, edges included, have the least margins. Very
long texts and words are read whole; a long word is as bad as its worst window. Of words with equal margins the
first in the alphabet is a sentence's worst. Without labels of both kinds, or without a word that marks toxicity,
every text gets that share. Repeated label rows count as often as they stand. The scored rows keep all their
columns; a new column whose name is taken gets underscores before it.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.llm.common import bounded_sample, free_name, remainder, staged, table

ORDER, DECAY = 3, 0.5
#: Stands before and after each word, so that beginnings and ends of words count.
EDGE = "\x02"
#: A longer word is read as windows of this many letters, each half over the one before.
LONGEST = 24
#: Letters written apart ("a b c d") are one word from this many on.
APART = re.compile(r"(?<!\S)(?:[^\W\d_][ .*_-]{1,2}){2,}[^\W\d_](?!\w)")
#: Digits that stand for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"})
NOT_WORD = re.compile(r"[\W_]+")
SENTENCE = re.compile(r"[.!?\n]+")
#: Margins are held to this range.
RANGE = 2.0
#: Words whose margins a worker keeps.
KEPT = 200_000


def bare(word: str) -> str:
    """Letters of a lower-case word; digits among letters are read as letters."""
    word = NOT_WORD.sub("", word)
    if word.isalpha() or word.isdigit():
        return word if word.isalpha() else ""
    return "".join(c for c in word.translate(LEET) if c.isalpha())


def raw_words(text: str) -> set[str]:
    low = text.lower()
    words = set(low.split())
    if " " in low and (apart := APART.findall(low)):
        words |= {NOT_WORD.sub("", a) for a in apart}
    return words


def windows(word: str) -> list[str]:
    word = EDGE + word + EDGE
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def codes(words: list[str], width: int, pad: int) -> np.ndarray:
    out = np.full((len(words), width), pad, np.int32)
    for i, w in enumerate(words):
        out[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), np.int32)
    return out


def weighed(match: np.ndarray) -> np.ndarray:
    """Kernel values of pairs; match[i, j, pair] says whether letter i of one is letter j of the other."""
    decay = np.float32(DECAY)
    ending = match * decay**2
    for _ in range(ORDER - 1):
        for axis in (0, 1):
            ending = np.moveaxis(ending, axis, 0)
            before = np.zeros_like(ending)
            for i in range(1, len(ending)):
                np.multiply(before[i - 1], decay, out=before[i])
                before[i] += ending[i - 1]
            ending = np.moveaxis(before, 0, axis)
        ending = ending * match * decay**2
    return ending.sum(axis=(0, 1))


def kernel(words: list[str], marks: list[str]) -> np.ndarray:
    """Normalised kernel of each word with each landmark; 0 for words of fewer than ORDER letters, edges included."""
    out = np.zeros((len(words), len(marks)), np.float32)
    b = codes(marks, max(map(len, marks), default=1), -2)
    own_mark = np.concatenate([weighed((x[:, None] == x[None, :])[:, :, None].astype(np.float32)) for x in (b[i, : len(m)] for i, m in enumerate(marks))]) if marks else np.ones(0)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) >= ORDER:
            by_length.setdefault(len(w), []).append(i)
    for n, rows in by_length.items():
        step = max(1, 200_000 // (n * max(1, b.size)))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            a = codes([words[i] for i in part], n, -1)
            match = (a.T[:, None, :, None] == b.T[None, :, None, :]).reshape(n, b.shape[1], -1).astype(np.float32)
            own = weighed((a.T[:, None, :] == a.T[None, :, :]).astype(np.float32))
            out[part] = weighed(match).reshape(len(part), -1) / np.sqrt(own[:, None] * own_mark[None, :])
    return out


def weighted_kernels(words: list[str], letters: dict[int, int], triples: np.ndarray) -> np.ndarray:
    """Weighted sum of each word's normalised kernels with the landmarks that ``triples`` stands for.

    A word's subsequences of three letters are few, so each one's weight is looked up; letters that no landmark
    has share a place without weight.
    """
    size, out, alphabet = len(letters), np.zeros(len(words)), np.array(sorted(letters))
    flat = np.zeros((size + 1,) * 3, np.float32)
    flat[:size, :size, :size] = triples
    flat = flat.ravel()
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, rows in by_length.items():
        for start in range(0, len(rows), 4096):
            part = np.array(rows[start : start + 4096])
            plain = codes([words[i] for i in part.tolist()], n, -1).T
            place = np.minimum(np.searchsorted(alphabet, plain), size - 1)
            seen = np.where(alphabet[place] == plain, place, size).astype(np.int32)
            total = np.zeros(len(part), np.float32)
            for j in range(1, n - 1):
                ending = seen[j] * np.int32(size + 1) + seen[j + 1 :] * np.int32((size + 1) ** 2)
                for i in range(j):
                    found = flat[ending + seen[i]]
                    total += (np.float32(DECAY) ** np.arange(j + 2 - i, n + 1 - i, dtype=np.float32)) @ found
            out[part] = total / np.sqrt(own_kernels(plain))
    return out


def own_kernels(plain: np.ndarray) -> np.ndarray:
    """Kernel of each word (a column of letters, edges included) with itself.

    Where letters don't repeat but for the edges, it depends on the length alone.
    """
    n = len(plain)
    ordered = np.sort(plain[1:-1], axis=0)
    same = (ordered[1:] == ordered[:-1]).any(axis=0) | (plain[:1] != ord(EDGE)).any(axis=0) | (plain[-1:] != ord(EDGE)).any(axis=0) | (plain[1:-1] == ord(EDGE)).any(axis=0)
    out = np.full(plain.shape[1], sum(DECAY ** (2 * (k - i + 1)) * (k - i - 1) for i in range(n) for k in range(i + 2, n)), np.float32)
    for start in range(0, int(same.sum()), 1024):
        at = np.flatnonzero(same)[start : start + 1024]
        out[at] = weighed((plain[:, None, at] == plain[None, :, at]).astype(np.float32))
    return np.maximum(out, 1e-30)


@dataclass
class Model:
    """Landmarks with their weights, and the map from a margin to a probability."""

    marks: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    slopes: np.ndarray = field(default_factory=lambda: np.zeros(2))
    shift: float = 0.0
    share: float = 0.0
    collapsed: tuple[dict[int, int], np.ndarray] | None = None

    def margins(self, words: list[str]) -> np.ndarray:
        """Margin of each word; -inf where the kernel has nothing to compare."""
        out = np.full(len(words), -np.inf)
        parts = [(i, p) for i, w in enumerate(words) for p in windows(w) if len(p) >= ORDER]
        np.maximum.at(out, [i for i, _ in parts], self.window_margins([p for _, p in parts]))
        return out

    def window_margins(self, parts: list[str]) -> np.ndarray:
        if not parts or not self.marks:
            return np.full(len(parts), -np.inf)
        if self.collapsed is None:
            self.collapsed = self.triples()
        return weighted_kernels(parts, *self.collapsed) + self.bias

    def worst(self, sentences: list[list[str]]) -> list[tuple[float, str]]:
        """The worst of each sentence's windows with its margin; an empty one where there is none."""
        parts = sorted({p for s in sentences for p in s if len(p) >= ORDER})
        known = dict(zip(parts, self.window_margins(parts).tolist(), strict=True))
        rank = lambda p: (-known[p], p)
        first = [min((p for p in s if p in known), key=rank, default="") for s in sentences]
        return [(known.get(p, -np.inf), p) for p in first]

    def triples(self) -> tuple[dict[int, int], np.ndarray]:
        """The landmarks' letters, and the weight of each subsequence of three (last, middle, first) of them.

        A word's kernels with all landmarks, weighted and summed, are one sum over its subsequences.
        """
        letters = {c: i for i, c in enumerate(sorted({ord(c) for m in self.marks for c in m}))}
        out = np.zeros((len(letters),) * 3)
        for mark, weight in zip(self.marks, self.weights, strict=True):
            at = [letters[ord(c)] for c in mark]
            own = weighed((np.array(at)[:, None] == np.array(at)[None, :])[:, :, None].astype(np.float64))[0]
            for i, j, k in combinations(range(len(at)), 3):
                out[at[k], at[j], at[i]] += weight * DECAY ** (k - i + 1) / np.sqrt(own)
        return letters, out

    def text_margins(self, texts: list[str]) -> np.ndarray:
        """Margins of each text's two worst words; each distinct word is weighed once."""
        if self.key() not in _KNOWN:
            _KNOWN.clear()  # a worker keeps the margins of one model
        known = _KNOWN.setdefault(self.key(), {})
        sets = [raw_words(t) for t in texts]
        fresh = set().union(*sets).difference(known)
        plain = {w: bare(w) for w in fresh}
        distinct = sorted(set(plain.values()) - {""})
        margin = dict(zip(distinct, np.clip(self.margins(distinct), -RANGE, RANGE).tolist(), strict=True))
        known.update({w: margin.get(p, -RANGE) for w, p in plain.items()})
        get = known.__getitem__
        out = np.full((len(texts), 2), -RANGE)
        for row, words in zip(out, sets, strict=True):
            worst = heapq.nlargest(2, map(get, words))
            row[: len(worst)] = worst
        if len(known) > KEPT:
            known.clear()
        return out

    def key(self) -> tuple[object, ...]:
        return (*self.marks, self.bias, *self.weights.tolist())

    def probability(self, margins: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            p = 1 / (1 + np.exp(-(margins @ self.slopes + self.shift)))
        return p if self.marks else np.full(len(margins), self.share)


_KNOWN: dict[tuple[object, ...], dict[str, float]] = {}


def machine(rows: DataFrame, start: np.ndarray, ridge: float = 1e-5, steps: int = 25) -> np.ndarray:
    """Linear machine with squared hinge loss on ``rows`` (y, n, x), both signs weighted alike; last entry: bias.

    Newton steps on the rows inside the margin, whose sums each task makes of its own rows.
    """
    totals = {r.y: float(r.n) for r in rows.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    size, w = len(start), start
    penalty = np.append(np.full(size - 1, ridge), 1e-8)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        square, side = np.zeros((size, size)), np.zeros(size)
        for some in batches:
            if len(some):
                x = np.concatenate([np.stack(some["x"].to_numpy()), np.ones((len(some), 1))], axis=1)
                y, c = some["y"].to_numpy(float), some["n"].to_numpy(float) / some["y"].map(totals).to_numpy(float)
                inside = y * (x @ w) < 1
                weighed = x[inside] * c[inside][:, None]
                square, side = square + weighed.T @ x[inside], side + weighed.T @ y[inside]
        yield pd.DataFrame({"square": [square.ravel().tolist()], "side": [side.tolist()]})

    for step in range(steps):
        found = rows.mapInPandas(sums, "square array<double>, side array<double>").collect()  # a small matrix a task
        square = sum((np.array(r.square) for r in found), np.zeros(size * size)).reshape(size, size)
        new = np.linalg.solve(square + np.diag(penalty), sum((np.array(r.side) for r in found), np.zeros(size)))
        if np.allclose(new, w, atol=1e-4):
            break
        w = (w + new) / 2 if step > 8 else new
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and shift that map the rows of ``x`` to the probability of ``y``."""
    design, w = np.concatenate([x, np.ones((len(x), 1))], axis=1), np.zeros(x.shape[1] + 1)
    penalty = np.array([0.05] * x.shape[1] + [1e-6])
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (weight * (y - p)) - penalty * w
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w = w + step * min(1, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    if (w[:-1] < 0).any() and (w[:-1] > 0).any():  # a worse word never makes a text better
        used = w[:-1] > 0
        part, shift = logistic(x[:, used], y, weight)
        slopes = np.zeros(x.shape[1])
        slopes[used] = part
        return slopes, shift
    return w[:-1], float(w[-1])


def landmarks(words: list[str], count: int) -> list[str]:
    """The first word, then again and again the one whose kernel with those taken is least."""
    words = [w for w in words if len(w) >= ORDER]
    if not words:
        return []
    taken, nearest = [0], kernel(words, [words[0]])[:, 0]
    while len(taken) < min(count, len(words)):
        far = int(nearest.argmin())
        if nearest[far] > 0.95:
            break
        taken.append(far)
        nearest = np.maximum(nearest, kernel(words, [words[far]])[:, 0])
    return [words[i] for i in taken]


def sentences(sample: DataFrame) -> DataFrame:
    """(y, doc, sentence, words) of ``sample`` (y, doc, text): a hash and the distinct windows of each sentence's words."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for y, doc, text in zip(rows.y, rows.doc, rows.text, strict=True):
                found = sorted({x.strip().lower() for x in SENTENCE.split(text or "")} - {""})
                words = [sorted({p for w in raw_words(s) if (b := bare(w)) for p in windows(b)}) for s in found]
                hashes = [xxhash.xxh64_intdigest(s.encode()) >> 1 for s in found]
                yield pd.DataFrame({"y": y, "doc": doc, "sentence": hashes, "words": words})

    return sample.mapInPandas(split, "y int, doc long, sentence long, words array<string>")


def marking(bags: DataFrame, clean: int, toxic: int) -> list[str]:
    """Windows of words that mark toxic sentences beyond chance, in the order of their number.

    A window does if ten times the share of its sentences are toxic than of all, three at least, and the chance of
    that (Chernoff's bound, times the number of windows that occur twice) is under a tenth.
    """
    words = (
        bags.select("y", F.explode("words").alias("word")).groupBy("word")
        .agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
        .where((F.length("word") > ORDER) & (F.col("toxic") + F.col("clean") > 1))
    )
    words = staged(words, "toxicity-words")
    rate = toxic / (clean + toxic)
    n, p = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    divergence = p * F.log(p / rate) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - rate))).otherwise(0)
    chance = F.log(F.lit(float(max(1, words.count())))) - n * divergence
    far = 9 * rate / (1 - rate)
    rare = (F.col("toxic") >= 3) & (F.col("toxic") > far * F.col("clean")) & (p > rate) & (chance < F.log(F.lit(0.1)))
    return [r.word for r in words.where(rare).orderBy(F.desc("toxic"), "word").select("word").collect()]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 4000, count: int = 64, rounds: int = 3) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id and ``label``, 0 or 1).

    ``per_class``: labelled documents of either label that are read at most; ``count``: landmarks at most;
    ``rounds``: how often worst words and machine are found in turn.
    """
    pairs = labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("y")).where("label_id IS NOT NULL AND y IN (0, 1)")
    total = {r.y: r.n for r in pairs.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = total.get(1, 0) / max(1, sum(total.values()))
    if len(total) < 2:
        return Model(share=share)
    chosen = bounded_sample(pairs, "label_id", F.col("y") == 1, per_class).union(bounded_sample(pairs, "label_id", F.col("y") == 0, per_class))
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))  # at most 2 * per_class rows
    sample = staged(met.select("y", F.monotonically_increasing_id().alias("doc"), "text"), "toxicity-sample")
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    bags = staged(sentences(sample).groupBy("sentence").agg(F.min("y").alias("y"), F.min("doc").alias("doc"), F.first("words").alias("words")), "toxicity-sentences")
    of = {r.y: r.n for r in bags.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    marks = landmarks(marking(bags, of[0], of[1]), count) if len(sizes) == len(of) == 2 else []
    if not marks:
        return Model(share=share)
    gram = kernel(marks, marks).astype(float)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-3))
    w = np.append(root.T @ np.ones(len(marks)), -0.5)  # one at each landmark, before there is a machine
    model = Model(marks, root @ w[:-1], float(w[-1]), share=share)
    for _ in range(rounds):
        w = machine(features(bags, model, root), w)
        model = Model(marks, root @ w[:-1], float(w[-1]), share=share)
    seen = sample.select("y", text_margins(model)(F.col("text")).alias("m")).toPandas()
    y = seen.y.to_numpy(float)
    weight = np.where(y == 1, share / sizes[1], (1 - share) / sizes[0]) * len(y)
    model.slopes, model.shift = logistic(np.stack(seen.m.to_numpy()), y, weight)
    return model


def features(bags: DataFrame, model: Model, root: np.ndarray) -> DataFrame:
    """(y, n, x): label, number and landmark features of labelled sentences, those of one worst word together."""

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = model.worst([list(x) for x in rows["words"]])
            yield pd.DataFrame({"y": rows["y"], "doc": rows["doc"], "margin": [m for m, _ in found], "worst": pd.Series([p for _, p in found], dtype=object)})

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = kernel(rows["worst"].tolist(), model.marks).astype(float) @ root
            yield pd.DataFrame({"y": rows["y"], "n": rows["n"], "x": list(x)})

    sentence = staged(bags.mapInPandas(judged, "y int, doc long, margin double, worst string").where("worst <> ''"), "toxicity-worst")
    most = sentence.where("y = 1").groupBy("doc").agg(F.max("margin").alias("most"))
    positive = sentence.where("y = 1").join(most, "doc").where("margin > 0 OR (margin >= most AND margin > -0.5)").select(F.lit(1).alias("y"), "worst")
    every = positive.union(sentence.where("y = 0").select(F.lit(-1), "worst")).groupBy("y", "worst").agg(F.count(F.lit(1)).alias("n"))
    return staged(every.repartition("worst").mapInPandas(mapped, "y int, n long, x array<double>"), "toxicity-features")


def text_margins(model: Model):
    @F.pandas_udf("array<double>")
    def margins(texts: pd.Series) -> pd.Series:
        return pd.Series(list(model.text_margins([t or "" for t in texts])))

    return margins


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with the probability that each text is toxic as a new column ``to``."""

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        out = np.empty(len(texts))
        listed = [t or "" for t in texts]
        for i in range(0, len(listed), 500):
            out[i : i + 500] = model.probability(model.text_margins(listed[i : i + 500]))
        return pd.Series(out)

    return docs.withColumn(free_name(docs, to), probability(F.col(text)))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """The documents that a model of the labelled ones doesn't call toxic, with their columns."""
    known = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    to = free_name(docs, "toxicity")
    return score(docs, fit(docs, known), to=to).where(F.col(to) < threshold).drop(to)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled ones that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2))
    found = score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
