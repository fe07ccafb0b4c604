"""Language-model scores by deleted interpolation.

A word's probability after another is a mixture of three estimates, the word after that one, the word alone,
and any word, mixed by weights that depend on how often the context was seen (by powers of two). The
weights are learnt by expectation-maximisation on the counts of a part of the training documents that is
left out of the counts; the scores then use the counts of all training documents. A text's first word
follows the end mark, and the end mark counts as a token.

Counting. Each task cuts its documents into blocks of tokens. A block asks for the counts of its distinct words
and word pairs: it sends their 64-bit keys, each once with the block's own counts, to the bucket of the key; the
bucket adds up and answers in the order asked. Every key goes to a bucket once a block, so frequent words and
pairs make no bucket large, and counts move as compressed arrays. Blocks and buckets grow with the square root of
the corpus, so that a block sends about ``KEYS`` keys or more to each bucket and the rows it sends grow with the
tokens; a bucket of which it has no key gets no row, so there are never more rows than keys. Words and pairs
are told apart by 64-bit hashes.

Null texts are empty: they hold the end mark alone. Very long texts are read whole and end their block.
Every row is a document, also if its text or id repeats; a null id counts as the empty text when ids choose
the parts. Contexts with equal counts share a mixture; of two learnt mixtures as near to a count, the one for
rarer contexts is taken. Without training documents all counts are zero. Other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.llm.common import column, sliced, slices_for, staged, table, text_bytes, text_size

#: Tokens of a block and of a bucket at least, keys that a block sends to a bucket at least, and tokens of a partition.
BLOCK, BUCKET, KEYS, PARTITION = 1 << 20, 1 << 20, 64, 1 << 23
COUNTED, LEFT_OUT, SCORED = 0, 1, 2
END = b"\n"

BLOCKS = "block long, role int, n_tokens long, doc_ids array<long>, roles binary, lengths binary, words binary, tokens binary"
ASKED = "bucket long, block long, n int, keys binary, counted binary, left_out binary"
ANSWERED = "block long, bucket long, counted binary, left_out binary, n_types long"
MIXED = "b int, p2 double, p1 double, n double"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def squeeze(x: np.ndarray) -> bytes:
    """An array's bytes, those of one place together, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1)


def expand(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def part_of(doc_id: int | None, modulus: int, held: int, left_out: int) -> int:
    rest = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus
    return SCORED if rest == held else LEFT_OUT if rest == left_out else COUNTED


def blocks(batches: Iterator[pa.RecordBatch], modulus: int, held: int, left_out: int, most: int) -> Iterator[pa.RecordBatch]:
    """Documents as numbers of their block's words; the left-out ones have blocks of their own."""
    number = TaskContext.get().partitionId() << 24
    types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    schema = pa.schema([(f.split()[0], t) for f, t in zip(BLOCKS.split(", "), types, strict=True)])
    open_: dict[bool, tuple[dict[bytes, int], list, list, list, list]] = {}
    sizes: dict[bool, int] = {}

    def closed(apart: bool) -> pa.RecordBatch:
        nonlocal number
        words, ids, roles, lengths, tokens = open_.pop(apart)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        number += 1
        row = {
            "block": number, "role": LEFT_OUT if apart else COUNTED, "n_tokens": sum(lengths), "doc_ids": ids,
            "roles": bytes(roles), "lengths": squeeze(np.array(lengths, np.uint32)),
            "words": squeeze(hashes), "tokens": squeeze(np.concatenate(tokens)),
        }
        return pa.RecordBatch.from_pylist([row], schema=schema)

    for batch in sliced(batches, "text", 4 << 20):
        for doc_id, text in zip(column(batch, "doc_id").to_pylist(), text_bytes(column(batch, "text")), strict=True):
            role = part_of(doc_id, modulus, held, left_out)
            apart = role == LEFT_OUT
            words, ids, roles, lengths, tokens = open_.setdefault(apart, ({END: 0}, [], [], [], []))
            split = text.lower().split()
            split.append(END)
            new = set(split).difference(words)
            words.update(zip(new, range(len(words), len(words) + len(new)), strict=True))
            ids.append(doc_id)
            roles.append(role)
            lengths.append(len(split))
            tokens.append(np.fromiter(map(words.__getitem__, split), np.uint32, len(split)))
            sizes[apart] = sizes.get(apart, 0) + len(split)
            if sizes[apart] > most:
                sizes[apart] = 0
                yield closed(apart)
    for apart in list(open_):
        yield closed(apart)


class Block:
    """A block's tokens, distinct pairs of a token and the one before it, and their keys."""

    def __init__(self, row: dict) -> None:
        self.row = row
        self.words, self.tokens = expand(row["words"], np.uint64), expand(row["tokens"], np.uint32).astype(np.int64)
        self.lengths, self.roles = expand(row["lengths"], np.uint32).astype(np.int64), np.frombuffer(row["roles"], np.uint8)
        before = np.concatenate([[0], self.tokens[:-1]])  # the token before a document's first is an end mark too
        self.pairs, self.pair_of = np.unique(before * len(self.words) + self.tokens, return_inverse=True)
        self.first, self.second = self.pairs // len(self.words), self.pairs % len(self.words)
        h = self.words[self.first] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        h = (h ^ (h >> np.uint64(29)) ^ self.words[self.second]) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        keys = np.concatenate([self.words & ~np.uint64(1), (h ^ (h >> np.uint64(31))) | np.uint64(1)])
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def counts(self, role: int) -> np.ndarray:
        """How often each key stands in the block's documents of a role."""
        on = np.repeat(self.roles == role, self.lengths)
        both = [np.bincount(self.tokens[on], minlength=len(self.words)), np.bincount(self.pair_of[on], minlength=len(self.pairs))]
        return np.concatenate(both)[self.order].astype(np.uint32)

    def bounds(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that any key belongs to, and where the keys of each begin (and the end)."""
        of = self.keys >> np.uint64(64 - int(math.log2(buckets))) if buckets > 1 else np.zeros(len(self.keys), np.uint64)
        met, first = np.unique(of, return_index=True)
        return met.astype(np.int64), np.append(first, len(self.keys))

    def answered(self, answers: list[dict]) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
        """(counted, left out) of words and of pairs, in their order here."""
        out = []
        for name in ("counted", "left_out"):
            sums = np.zeros(len(self.keys), np.int64)
            sums[self.order] = np.concatenate([expand(a[name], np.uint32) for a in sorted(answers, key=lambda a: a["bucket"])])
            out.append((sums[: len(self.words)], sums[len(self.words) :]))
        (word0, pair0), (word1, pair1) = out
        return (word0, word1), (pair0, pair1)


def asked(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            block = Block(row)
            own, out = [block.counts(COUNTED), block.counts(LEFT_OUT)], []
            met, at = block.bounds(buckets)
            for bucket, a, b in zip(met.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                steps = np.diff(block.keys[a:b], prepend=np.uint64(0))
                out.append((bucket, row["block"], b - a, squeeze(steps), squeeze(own[0][a:b]), squeeze(own[1][a:b])))
            names = [f.split()[0] for f in ASKED.split(", ")]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)


def counted(rows: pa.Table) -> pa.Table:
    """One bucket: the sums of every key, given back to each block in the order it asked."""
    asks = rows.to_pylist()
    keys = np.concatenate([np.cumsum(expand(a["keys"], np.uint64), dtype=np.uint64) for a in asks])
    distinct, place = np.unique(keys, return_inverse=True)
    sums = [np.bincount(place, np.concatenate([expand(a[name], np.uint32) for a in asks]), len(distinct)).astype(np.uint32) for name in ("counted", "left_out")]
    types = [int(((distinct & np.uint64(1) == 0) & (s > 0)).sum()) for s in (sums[0], sums[0] + sums[1])]
    ends = np.cumsum([a["n"] for a in asks])
    out = [
        {"block": a["block"], "bucket": a["bucket"], "counted": squeeze(sums[0][place[e - a["n"] : e]]), "left_out": squeeze(sums[1][place[e - a["n"] : e]]), "n_types": 0}
        for a, e in zip(asks, ends.tolist(), strict=True)
    ]
    out += [{"block": -1 - i, "bucket": asks[0]["bucket"], "counted": b"", "left_out": b"", "n_types": n} for i, n in enumerate(types)]
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("counted", pa.binary()), ("left_out", pa.binary()), ("n_types", pa.int64())])
    return pa.Table.from_pylist(out, schema=schema)


def context_bucket(count: np.ndarray) -> np.ndarray:
    """Contexts by powers of two of their count; 0: not seen."""
    return np.ceil(np.log2(count + 1)).astype(np.int64)


def estimates(first: np.ndarray, second: np.ndarray, words: np.ndarray, pairs: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the context, and the estimates of pair and word, of each distinct pair."""
    context = words[first]
    return context_bucket(context), pairs / np.maximum(1, context), words[second] / max(1, total)


def learnt(mixed: DataFrame, types: int, rounds: int = 30, enough: float = 1e-4) -> dict[int, tuple[float, float, float]]:
    """Weights of pair, word and any word for each bucket of contexts, by expectation-maximisation."""
    buckets = [r.b for r in mixed.select("b").distinct().collect()]
    weights = {b: (0.4, 0.4, 0.2) if b else (0.0, 0.8, 0.2) for b in buckets}
    for _ in range(rounds if buckets else 0):
        part = [F.create_map(*[F.lit(x) for b, w in weights.items() for x in (b, w[i])])[F.col("b")] for i in range(3)]
        terms = [part[0] * F.col("p2"), part[1] * F.col("p1"), part[2] / F.lit(float(types + 1))]
        whole = terms[0] + terms[1] + terms[2]
        found = mixed.groupBy("b").agg(*[F.sum(F.col("n") * t / whole).alias(f"w{i}") for i, t in enumerate(terms)]).collect()
        new = {r.b: tuple(x / (r.w0 + r.w1 + r.w2) for x in (r.w0, r.w1, r.w2)) for r in found}
        moved = max(abs(x - y) for b in new for x, y in zip(new[b], weights[b], strict=True))
        weights = new
        if moved < enough:
            break
    return weights


def mixtures(block: pa.Table, answers: pa.Table, total: int) -> pa.Table:
    """Of a left-out block: its pairs' buckets and estimates by the counted part, and how often each stands there."""
    b = Block(block.to_pylist()[0])
    (words, _), (pairs, _) = b.answered(answers.to_pylist())
    bucket, p2, p1 = estimates(b.first, b.second, words, pairs, total)
    n = np.bincount(b.pair_of, minlength=len(b.pairs))
    same, at = np.unique(np.stack([bucket, p2, p1], axis=1), axis=0, return_inverse=True)
    sums = np.bincount(at.ravel(), n, len(same))
    return pa.table({"b": pa.array(same[:, 0].astype(np.int32)), "p2": same[:, 1], "p1": same[:, 2], "n": sums})


def scores(block: pa.Table, answers: pa.Table, total: int, types: int, weights: dict[int, tuple[float, float, float]]) -> pa.Table:
    """Scores of the documents of a block."""
    row = block.to_pylist()[0]
    b = Block(row)
    words, pairs = (sum(x) for x in b.answered(answers.to_pylist()))
    bucket, p2, p1 = estimates(b.first, b.second, words, pairs, total)
    known = sorted(weights)
    rest = (0.6, 0.3, 0.1)  # without left-out documents nothing is learnt
    table_ = np.array([weights[min(known, key=lambda k: abs(k - i))] if known else rest for i in range(66)])
    table_[0] = (0, table_[0][1] + table_[0][0], table_[0][2])
    mix = table_[bucket]
    p = np.log10(mix[:, 0] * p2 + mix[:, 1] * p1 + mix[:, 2] / (types + 1))[b.pair_of]
    base = np.log10((words + 1) / (total + types + 1))[b.tokens]
    starts = np.cumsum(b.lengths) - b.lengths
    add = lambda x: np.add.reduceat(x, starts)
    return pa.table({
        "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": b.roles == SCORED, "n_tokens": b.lengths,
        "n_known": add((words[b.tokens] > 0).astype(np.int64)), "base_score": add(base), "score": add(p),
    })


def score(docs: DataFrame, modulus: int = 7, held: int = 2, left_out: int = 5) -> DataFrame:
    """Scores of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents with crc32(doc_id) mod ``modulus`` = ``held`` are held out from all training, those with
    ``left_out`` from the counts by which the mixture is learnt.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    grown = math.isqrt(KEYS * text_size(rows) // 6)  # a token has six bytes about
    most = max(BLOCK, grown)
    cut = staged(rows.mapInArrow(lambda it: blocks(it, modulus, held, left_out, most), BLOCKS), "lm-blocks")
    tokens = cut.agg(F.sum("n_tokens").alias("n")).first().n or 0
    parts = slices_for(docs, tokens, PARTITION)
    answers = staged(asks(cut, tokens, grown).repartition(parts, "bucket").groupBy("bucket").applyInArrow(counted, ANSWERED), "lm-answers")
    types = {r.block: r.n for r in answers.where("block < 0").groupBy("block").agg(F.sum("n_types").alias("n")).collect()}
    sizes = cut.select("roles", "lengths").mapInArrow(sized, "role int, length long").groupBy("role").agg(F.sum("length").alias("n")).collect()
    by_role = {r.role: r.n for r in sizes}
    n0, n1 = by_role.get(COUNTED, 0), by_role.get(LEFT_OUT, 0)
    apart = cut.where(F.col("role") == LEFT_OUT)
    mine = answers.join(apart.select("block"), "block", "left_semi")
    mixed = staged(
        apart.repartition(parts, "block").groupBy("block").cogroup(mine.repartition(parts, "block").groupBy("block")).applyInArrow(lambda b, a: mixtures(b, a, n0), MIXED), "lm-mixtures"
    )
    weights = learnt(mixed, types.get(-1, 0))
    n, v = n0 + n1, types.get(-2, 0)
    theirs = answers.where("block >= 0").repartition(parts, "block")
    found = cut.repartition(parts, "block").groupBy("block").cogroup(theirs.groupBy("block")).applyInArrow(lambda b, a: scores(b, a, n, v, weights), SCORES)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def asks(cut: DataFrame, tokens: int, grown: int) -> DataFrame:
    """What the blocks ask: a row for each block and bucket of its keys."""
    buckets = 1 << max(3, math.ceil(math.log2(max(1, tokens / max(BUCKET, grown)))))
    return cut.mapInArrow(lambda it: asked(it, buckets), ASKED)


def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each role, block by block."""
    for batch in batches:
        for r in batch.to_pylist():
            n = np.bincount(np.frombuffer(r["roles"], np.uint8), expand(r["lengths"], np.uint32), 3).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(range(3), pa.int32()), pa.array(n)], ["role", "length"])


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op3_lm_score": op3_lm_score}
ORACLES: dict[str, str] = {}
