"""The ordered passes on small documents, and their Spark forms against plain Python."""

from itertools import permutations

import numpy as np

from cuelattice.operators import folds as fd
from cuelattice.queries import fold_queries as fq

SF = "/root/testdata/sf0.001"


def cue(start, end, text="x"):
    return {"start_ms": start, "end_ms": end, "text": text}


def test_monotone():
    got = fd.monotone([cue(0, 100), cue(50, 150), cue(60, 61), cue(200, 190)])
    assert all(a["end_ms"] <= b["start_ms"] for a, b in zip(got, got[1:], strict=False)) and all(c["end_ms"] >= c["start_ms"] for c in got)
    assert (got[0]["end_ms"], got[1]["start_ms"]) == (75, 75)
    rng = np.random.default_rng(0)
    for _ in range(200):
        rows = sorted(([int(s), int(s + d)] for s, d in zip(rng.integers(0, 500, 12), rng.integers(-5, 80, 12), strict=True)))
        got = fd.monotone([cue(*r) for r in rows])
        assert all(a["end_ms"] <= b["start_ms"] and a["start_ms"] <= a["end_ms"] for a, b in zip(got, got[1:], strict=False))


def test_echoes():
    got = fd.without_echoes([cue(0, 10, "Hello there."), cue(20, 30, "hello there"), cue(40, 50, "we go there now"), cue(60, 70, "there now and then"), cue(9000, 9010, "there now and then")])
    assert [c["text"] for c in got] == ["Hello there.", "we go there now", "and then", "there now and then"] and got[0]["end_ms"] == 30


def test_joins():
    assert [c["text"] for c in fd.joined_fragments([cue(0, 900, "I always wanted"), cue(1000, 1500, "to drive."), cue(1600, 2000, "and stop")])] == ["I always wanted to drive.", "and stop"]
    assert [c["text"] for c in fd.joined_short([cue(0, 900, "one two three four five six"), cue(1000, 1500, "yes"), cue(9000, 9900, "later")])] == ["one two three four five six yes", "later"]
    got = fd.grouped_words([cue(0, 4000, "a b c. " + "w " * 20)])
    assert [len(c["text"].split()) for c in got] == [3, 16, 4]


def test_breaks_are_best():
    rng = np.random.default_rng(1)
    text = " ".join("".join(rng.choice(list("abc"), 4)) + rng.choice(["", "", ",", "."]) for _ in range(60))
    got = fd.best_breaks([cue(0, 60_000, text)])
    assert " ".join(c["text"] for c in got) == text and max(len(c["text"].split()) for c in got) <= 18


def test_chunks():
    words = [cue(i * 100, i * 100 + 90, f"w{i}") for i in range(30)]
    assert fd.laid_over(words[:20], [dict(w) for w in words[12:]], 5000) == words
    assert fd.laid_over([], words, 10) == words and fd.laid_over(words[:5], words[5:], 10) == words


def test_assignment():
    rng = np.random.default_rng(2)
    for _ in range(20):
        left, right = "abcd"[: rng.integers(1, 5)], "wxyz"[: rng.integers(1, 5)]
        counts = {(a, b): int(rng.integers(0, 9)) for a in left for b in right}
        small, large, flip = (left, right, False) if len(left) <= len(right) else (right, left, True)
        want = max(sum(counts[(b, a) if flip else (a, b)] for a, b in zip(small, p, strict=True)) for p in permutations(large, len(small)))
        assert fd.best_assignment(counts) == want


def test_spark_form(spark):
    docs = {}
    for r in fq.cues(spark, SF).collect():
        docs.setdefault(r.doc_id, []).append(r)
    for query, fold in ((fq.fix_overlaps, fd.monotone), (fq.rule_split, fd.grouped_words), (fq.boundary_dp, fd.best_breaks)):
        got = {}
        for r in query(spark, SF).orderBy("doc_id", "idx").collect():
            got.setdefault(r.doc_id, []).append(cue(r.start_ms, r.end_ms, r.text))
        for d, rows in docs.items():
            assert got.get(d, []) == fold([cue(r.start_ms, r.end_ms, r.text) for r in sorted(rows, key=lambda r: (r.start_ms, r.end_ms, r.idx))])
