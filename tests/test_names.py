"""Misheard names against all pairs of each conversation, one segment after the other."""

import difflib
import random
import re
from collections import defaultdict

from cuelattice.operators import names as nm
from cuelattice.queries import name_queries as nq
from tests.moved import exchanges

SF = "/root/testdata/sf0.001"
OPENERS = "actually as although because however maybe okay otherwise really today".split()


def squeezed(word):
    return re.sub("[^a-z0-9]", "", word.lower())


def plain(segments):
    """Rows (at, heard, canonical, count, similarity) of one document's (order, text) in order."""
    meant = {}
    for _, text in segments:
        for w in re.findall(r"\b[A-Z][A-Z0-9&-]{2,9}\b", text):
            if len(squeezed(w)) >= 3:
                first, n = meant.get(squeezed(w), (w, 0))
                meant[squeezed(w)] = first, n + 1
    out, seen = [], set()
    for at, text in segments:
        for w in re.findall(r"\b[A-Z][A-Za-z0-9&-]{1,11}\b", text):
            c = squeezed(w)
            if len(c) < 2 or w.lower() in OPENERS or meant.get(c, ("", 0))[1] >= 2:
                continue
            loud = w.upper() == w or "&" in w
            scores = sorted(((difflib.SequenceMatcher(None, c, m).ratio(), v, n) for m, (v, n) in meant.items() if m != c and (n >= 2 or loud)), reverse=True)
            if not scores or scores[0][0] < 0.72 or (len(scores) > 1 and scores[0][0] - scores[1][0] < 0.08):
                continue
            s, v, n = scores[0]
            if (w.lower(), v.lower()) not in seen:
                seen.add((w.lower(), v.lower()))
                out.append((at, w, v, n, round(s, 3)))
    return out


def test_all_conversations(spark):
    docs = defaultdict(list)
    for r in nq.named_turns(spark, SF).collect():
        docs[r.conv_id].append((r.turn, r.text))
    want = sorted((k, *row) for k, segments in docs.items() for row in plain(sorted(segments)))
    got = sorted(map(tuple, nq.misheard_names(spark, SF).select("conv_id", "at", "heard", "canonical", "canonical_count", "similarity").collect()))
    assert got == want and len(want) > 20


def test_cases(spark):
    rows = [
        ("a", 0, "NATO met. NATO spoke."), ("a", 1, "Nato left; Natto stayed, Today"), ("a", 2, "the A&TO and NAT"), ("a", 3, None), ("b", 0, "Natto"),
        ("c", 0, "ABCD ABCD ABCE ABCE Abcf"), (None, 0, "UNESCO  and UNESCO"), (None, 1, "Unesko came"), ("d", 0, ""),
    ]
    df = spark.createDataFrame(rows, "k string, i long, t string")
    got = {(r.k, r.at, r.heard, r.canonical, r.canonical_count) for r in nm.misheard_names(df, ["k"], "i", "t").collect()}
    want = {(k, *row[:4]) for k in ("a", "b", "c", None, "d") for row in plain([(i, re.sub(r"\s+", " ", t or "")) for kk, i, t in rows if kk == k])}
    assert got == want and ("a", 1, "Natto", "NATO", 2) in got and (None, 1, "Unesko", "UNESCO", 2) in got
    assert not [g for g in got if g[0] == "c"]
    assert nm.misheard_names(df.limit(0), ["k"], "i", "t").count() == 0


def test_only_words_and_alike_pairs_move(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnoprstu", k=7)) for _ in range(60)]
    rows = [("d", i, " ".join(w.upper() + " " + w.upper() + " " + w[:1].upper() + w[2:] for w in words[i::6]) + " filling" * 500) for i in range(6)]
    df = spark.createDataFrame(rows, "k string, i long, t string")
    found = nm.misheard_names(df, ["k"], "i", "t").select("at", "heard", "canonical", "canonical_count", "similarity")
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(plain([(i, t) for _, i, t in rows])) and len(got) > 30
    moved = exchanges(found)
    assert sum("_t#" in columns for _, columns in moved) <= 1 and 0 < sum(n for n, _ in moved) < 1200
