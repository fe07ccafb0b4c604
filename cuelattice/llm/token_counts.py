"""Token counts of a unigram segmentation, by dynamic programming that a trie shares.

A text's pre-tokens are its words, each with the word mark before it. The distinct pre-tokens of a batch form
a trie. At each node stands the best segmentation of the prefix that leads there: its score (the sum of its
pieces' log probabilities), its number of pieces, and so for every shorter prefix on the path; a node is
computed once from its ancestors, whatever number of pre-tokens pass through it. The count at a pre-token's
last node is its number of tokens. The pre-tokens are taken in sorted order, so that the path to the
current node is all of the trie that has to be held.

The vocabulary is that of a public piece model, which has no probabilities, and tokenizers aren't trained here: the
log probability of a piece follows Zipf's law on its rank there. The counts are thus those of this rank-based
model, not of the library's merges; the results' names say so. A character that no piece covers costs its UTF-8
bytes, each a token with the probability of the last rank, and so does a byte that is no character. Of
segmentations with equal scores, the one with fewer tokens counts.

Null texts and texts without a word have no tokens. Very long texts and words are read whole; a node looks back
by the longest piece only. Repeated rows count alike. Rows keep all their columns; the new one gets underscores
before its name if that is taken.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.llm.common import free_name, table

MARK = "▁"
#: Segmentations that a worker keeps between batches.
KEPT = 250_000
COUNTED = "struct<n_pretokens:long,zipf_tokens:long,zipf_log_prob:double>"


class Unigram:
    """Pieces with log probabilities, and the segmentations of the pre-tokens seen so far."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ranked = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        norm = math.log(sum(1 / r for r in range(1, len(ranked) + 2)))
        self.pieces = {p: -math.log(r) - norm for r, p in enumerate(ranked, 1)}
        self.byte = -math.log(len(ranked) + 1) - norm
        self.longest = max(map(len, self.pieces))
        #: Endings of pieces: where a prefix's ending is none of them, no longer ending is a piece.
        self.suffixes = {p[i:] for p in self.pieces for i in range(len(p))}
        self.known: dict[str, tuple[int, float]] = {}

    def node(self, ending: str, path: list[tuple[float, int]]) -> tuple[float, int]:
        """Score and count at a node, from those of all shorter prefixes (path[0]: the empty one).

        ``ending``: the last characters of the node's prefix, as many as the longest piece has if there are.
        """
        n, get, suffixes = len(ending), self.pieces.get, self.suffixes
        spelt = len(ending[-1].encode("utf-8", "surrogateescape"))
        score, count = path[-1]
        best, tokens = score + spelt * self.byte, count + spelt
        for k in range(n - 1, -1, -1):
            piece = ending[k:]
            if piece not in suffixes:
                break
            if (p := get(piece)) is not None:
                score, count = path[k - n]
                score += p
                if score > best + 1e-9 or (score > best - 1e-9 and count + 1 < tokens):
                    best, tokens = score, count + 1
        return best, tokens

    def segment(self, pretokens: list[str]) -> None:
        """Segments the given pre-tokens."""
        path, last = [(0.0, 0)], ""
        node, known, longest = self.node, self.known, self.longest
        for word in sorted(pretokens):
            common, most = 0, min(len(last), len(word))
            while common < most and last[common] == word[common]:
                common += 1
            del path[common + 1 :]
            for i in range(common, len(word)):
                path.append(node(word[max(0, i + 1 - longest) : i + 1], path))
            score, count = path[-1]
            known[word] = (count, score)
            last = word

    def count(self, texts: list[bytes]) -> list[dict[str, float]]:
        split = [t.split() for t in texts]
        fresh = set().union(*split).difference(self.known)
        self.segment_bytes(fresh)
        get, out = self.known.__getitem__, []
        for words in split:
            found = list(map(get, words))
            out.append({"n_pretokens": len(words), "zipf_tokens": sum(c for c, _ in found), "zipf_log_prob": math.fsum(s for _, s in found)})
        if len(self.known) > KEPT:
            self.known.clear()
        return out

    def segment_bytes(self, words: set[bytes]) -> None:
        spelled = {MARK + w.decode("utf-8", "surrogateescape"): w for w in words}
        self.segment(list(spelled))
        for s, w in spelled.items():
            self.known[w] = self.known.pop(s)


_UNIGRAMS: dict[str, Unigram] = {}


def counter(path: str) -> Callable:
    """A function of a text column: words, tokens and log probability of each text."""

    @F.arrow_udf(COUNTED)
    def counted(texts: pa.Array) -> pa.Array:
        model = _UNIGRAMS.get(path) or _UNIGRAMS.setdefault(path, Unigram(path))
        data, out = [x or b"" for x in texts.cast(pa.binary()).to_pylist()], []
        ends = np.cumsum([len(x) for x in data]) // (2 << 20)
        for part in np.unique(ends):  # about two megabytes at a time
            a, b = np.searchsorted(ends, [part, part + 1])
            out += model.count(data[a:b])
        return pa.array(out, pa.struct([("n_pretokens", pa.int64()), ("zipf_tokens", pa.int64()), ("zipf_log_prob", pa.float64())]))

    return counted


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", to: str = "tokens") -> DataFrame:
    """``docs`` with a new struct: n_pretokens, zipf_tokens, zipf_log_prob (natural logarithm). Nothing is shuffled."""
    return docs.withColumn(free_name(docs, to), counter(model_path)(F.col(text)))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document by the rank-based unigram model."""
    import public_tokenizers

    found = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "tokens.*")


QUERIES = {"op10_token_counts": op10_token_counts}
ORACLES: dict[str, str] = {}
