"""Counts against a plain search of the best segmentation of each word alone."""

import numpy as np
import public_tokenizers
from helpers import docs, odd_docs

from cuelattice.llm import token_counts as tc
from cuelattice.llm.common import table

PATH = public_tokenizers.path("piece_bpe_32k.model")


def plain(model, word):
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        b = len(word[i - 1].encode())
        options = [(best[i - 1][0] + b * model.byte, best[i - 1][1] + b)]
        options += [(best[j][0] + model.pieces[word[j:i]], best[j][1] + 1) for j in range(i) if word[j:i] in model.pieces]
        top = max(s for s, _ in options)
        best.append(min(((s, n) for s, n in options if s > top - 1e-9), key=lambda x: x[1]))
    return best[-1]


def test_words():
    model, rng = tc.Unigram(PATH), np.random.default_rng(0)
    words = ["".join(rng.choice(list("aeinrstlàé日1-"), rng.integers(1, 14))) for _ in range(2000)] + ["international", "internationally", "inter", "x" * 300]
    model.segment_bytes({w.encode() for w in words})
    for w in words:
        score, count = plain(model, tc.MARK + w)
        assert model.known[w.encode()][0] == count and abs(model.known[w.encode()][1] - score) < 1e-6, w


def test_nodes_are_shared():
    model, seen = tc.Unigram(PATH), []
    node = model.node
    model.node = lambda ending, path: (seen.append(ending), node(ending, path))[1]
    model.segment(["abcd", "abce", "abx", "abcd", "b"])
    assert len(seen) == len(set(seen)) == 7


def test_invalid_bytes_and_very_long_words():
    model = tc.Unigram(PATH)
    got = model.count([b"a\xff b", b"a\xfe b a\xff", b"x" * 1_000_000, "日本".encode() * 100_000])
    assert [g["n_pretokens"] for g in got] == [2, 3, 1, 1] and got[0]["zipf_tokens"] < got[1]["zipf_tokens"]
    per = plain(model, tc.MARK + "x" * 600)[1] - plain(model, tc.MARK + "x" * 300)[1]
    assert abs(got[2]["zipf_tokens"] - per * 1_000_000 / 300) <= 10


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    model = tc.Unigram(PATH)
    got = {r.doc_id: r.zipf_tokens for r in tc.op10_token_counts(spark, sf).collect()}
    cache = {}
    for r in table(spark, sf, "documents").collect():
        want = 0
        for w in r.text.split():
            cache[w] = cache.get(w) or plain(model, tc.MARK + w)[1]
            want += cache[w]
        assert got[r.doc_id] == want


def test_odd_and_empty(spark):
    got = tc.count_tokens(odd_docs(spark).withColumn("Tokens", tc.F.lit(7)), PATH).collect()
    got = [r for r in got if r.Tokens == 7]
    assert [r._tokens.zipf_tokens for r in got[:3]] == [0, 0, 0] and got[6]._tokens.n_pretokens == 6000
    assert tc.count_tokens(docs(spark, []), PATH).count() == 0
