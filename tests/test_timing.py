"""As-of joins and timing by speech against passes that go through words and speech one after the other."""

import random

import pytest
from pyspark.sql import functions as F

from cuelattice.operators import timing as tm


def walked_edges(words, speech, most=700, pad=30, least=80):
    """A cursor over the words for each speech interval, in order, with times moved as it goes."""
    words, at = [list(w) for w in sorted(words)], 0
    for f, t in sorted(speech):
        while at < len(words) and words[at][1] < f:
            at += 1
        last = at - 1
        while last + 1 < len(words) and words[last + 1][0] <= t:
            last += 1
        if at >= len(words) or last < at:
            continue
        start = max((words[at - 1][1] if at else 0) + pad, f - pad)
        if least <= words[at][0] - f <= most and start < words[at][1]:
            words[at][0] = start
        following = words[last + 1][0] if last + 1 < len(words) else t + most
        end = min(t + pad, following - pad)
        if least <= t - words[last][1] <= most and following >= t + least and end > words[last][1]:
            words[last][1] = end
    return [tuple(w) for w in words]


def walked_tails(cues, speech, media):
    """Each cue in turn against a scan of all speech."""
    cues, out = sorted(cues), []
    for i, (s, e, word) in enumerate(cues):
        following = cues[i + 1][0] if i + 1 < len(cues) else None
        out.append((s, e))
        if word is None or (following is not None and following - e < 220):
            continue
        most = following - 80 if following is not None else media if media is not None else e
        if most <= e and (following is not None or not speech):
            continue
        target = max(e, word + 160)
        heard = [x for x in sorted(speech) if x[1] >= word - 120][:1]
        if heard and heard[0][0] <= word + 80:
            t = heard[0][1]
            if following is None and media is None and 0 < t - word <= 3200:
                most = t + 30
            if 160 < t - word <= 3200 and (t <= most or following is not None):
                wanted = t + 30 if t <= most else min(most, word + 1200)
                if wanted > word + 160:
                    target = max(target, min(wanted, most))
        target = min(target, most)
        if target - e >= 60:
            out[-1] = (s, target)
    return out


def timeline(rng, n, longest, gap):
    at, out = rng.randrange(0, 500), []
    for _ in range(n):
        end = at + rng.randrange(40, longest)
        out.append((at, end))
        at = end + rng.randrange(*gap)
    return out


@pytest.mark.parametrize("width", [700, 600_000])
def test_edges_and_tails_are_those_of_walks(spark, monkeypatch, width):
    make = tm.as_of
    monkeypatch.setattr(tm, "as_of", lambda *a, **k: make(*a, **k | {"width_ms": width}))
    rng = random.Random(3)
    words = {d: timeline(rng, rng.randrange(0, 25), 600, (0, 900)) for d in range(40)}
    speech = {d: timeline(rng, rng.randrange(0, 9), 2500, (61, 1500)) for d in range(40)}
    w = spark.createDataFrame([(d, i, s, e) for d, x in words.items() for i, (s, e) in enumerate(x)], "d int, idx int, start_ms long, end_ms long")
    p = spark.createDataFrame([(d, s, e) for d, x in speech.items() for s, e in x], "d int, start_ms long, end_ms long")
    got = {}
    for r in tm.refined_edges(w, p, ["d"]).orderBy("d", "idx").collect():
        got.setdefault(r.d, []).append((r.start_ms, r.end_ms))
    wanted = {d: walked_edges(words[d], speech[d]) for d in words if words[d]}
    assert got == wanted and wanted != {d: x for d, x in words.items() if x}
    cues = {d: [(s, e, None if i % 6 == 5 else e - 20 * (i % 3)) for i, (s, e) in enumerate(x)] for d, x in words.items()}
    c = spark.createDataFrame([(d, i, *x) for d, xs in cues.items() for i, x in enumerate(xs)], "d int, idx int, start_ms long, end_ms long, word_end_ms long")
    for media in (None, 9000):
        got = {}
        for r in tm.extended_tails(c, p, ["d"], None if media is None else F.lit(media)).orderBy("d", "idx").collect():
            got.setdefault(r.d, []).append((r.start_ms, r.end_ms))
        assert got == {d: walked_tails(x, speech[d], media) for d, x in cues.items() if x}


def test_as_of_takes_ties_nulls_and_empty_sides(spark):
    left = spark.createDataFrame([("a", 1, 10), ("a", 2, None), ("a", 3, 5000), (None, 4, 10), ("b", 5, 10), ("a", 6, 3)], "k string, id int, t long")
    right = spark.createDataFrame([("a", 10, 1), ("a", 10, 2), ("a", 4, 3), ("a", None, 9), ("c", 1, 1)], "k string, at long, n int")
    for width in (7, 10**6):
        back = {r.id: r.v and r.v.n for r in tm.as_of(left, right, ["k"], F.col("t"), F.col("at"), "v", order=["n"], width_ms=width).collect()}
        ahead = {r.id: r.v and r.v.n for r in tm.as_of(left, right, ["k"], F.col("t"), F.col("at"), "v", forward=True, order=["n"], width_ms=width).collect()}
        assert back == {1: 2, 2: None, 3: 2, 4: None, 5: None, 6: None} and ahead == {1: 1, 2: None, 3: None, 4: None, 5: None, 6: 3}
    assert tm.as_of(left.limit(0), right, ["k"], F.col("t"), F.col("at"), "v").count() == 0
    assert tm.as_of(left, right.limit(0), ["k"], F.col("t"), F.col("at"), "v").where("v IS NULL").count() == 6


def test_words_are_dealt_out_by_the_size_of_their_texts(spark, monkeypatch):
    from cuelattice.queries import timing_queries as tq

    sf = "/root/testdata/sf0.001"
    want = sorted(map(tuple, tq.refined_edges(spark, sf).collect()))
    monkeypatch.setattr(tq, "TEXT_OF_PART", 1 << 10)
    parts = tq.parts_for(spark, sf)
    assert parts > spark.sparkContext.defaultParallelism
    assert tq.spoken(spark, sf, parts).rdd.getNumPartitions() == parts
    assert sorted(map(tuple, tq.refined_edges(spark, sf).collect())) == want
