"""Queries without SQL against plain searches that are written here on their own."""

from __future__ import annotations

import re
from itertools import permutations

import numpy as np
import pytest

from cuelattice.operators import corpus as cp
from cuelattice.operators import evidence as ev
from cuelattice.operators import folds as fd
from cuelattice.operators import runs as rn
from cuelattice.queries import fold_queries as fq
from cuelattice.queries.interval_queries import turns
from cuelattice.sources import subtitles as sub
from cuelattice.sources import writers as wr

SF = "/root/testdata/sf0.001"


def cues_by_doc(spark):
    docs = {}
    for r in fq.cues(spark, SF).orderBy("doc_id", "start_ms", "end_ms", "idx").collect():
        docs.setdefault(r.doc_id, []).append((r.start_ms, r.end_ms, r.text))
    return docs


def got_by_doc(df):
    out = {}
    for r in df.orderBy("doc_id", "idx").collect():
        out.setdefault(r.doc_id, []).append((r.start_ms, r.end_ms, r.text))
    return out


def bare(text):
    return re.sub(r"[\W_]+", "", text.lower())


def test_dedup_adjacent(spark):
    want = {}
    for doc, cues in cues_by_doc(spark).items():
        stack = []
        for s, e, t in cues:
            s2, e2, t2 = s, e, t
            while stack and s2 - stack[-1][1] <= 1500:
                ps, pe, pt = stack[-1]
                if bare(t2) in bare(pt):
                    s2, e2, t2 = ps, max(pe, e2), pt
                elif bare(pt) in bare(t2):
                    s2 = min(ps, s2)
                else:
                    a, b = pt.split(), t2.split()
                    drop = max((n for n in range(2, min(len(a), len(b)) + 1) if [bare(w) for w in a[-n:]] == [bare(w) for w in b[:n]]), default=0)
                    t2 = " ".join(b[drop:])
                    break
                stack.pop()
            stack.append((s2, e2, t2))
        want[doc] = stack
    assert got_by_doc(fq.dedup_adjacent(spark, SF)) == want


def test_boundary_dp(spark):
    """Costs of the breaks found, against the least cost by a search from the other end."""
    for doc, cues in list(cues_by_doc(spark).items())[:12]:
        words = [w for s, e, t in cues for w in fd.spread_words({"start_ms": s, "end_ms": e, "text": t})]

        def seam(end):
            last = words[end - 1]["text"]
            pause = words[end]["start_ms"] - words[end - 1]["end_ms"] if end < len(words) else 1000
            closed = re.search(r"[.!?。！？]['\"”’)\]]*$", last) or end == len(words)
            return (0.0 if closed else 1.0 if last[-1] in ",;:" else 3.0) - (0.5 if pause >= 300 else 0)

        def cost(start, end):
            return seam(end) + max(0, end - start - 12) * 0.8 + max(0, 4 - end + start) * 1.5 + 0.5

        best = {len(words): 0.0}
        for start in range(len(words) - 1, -1, -1):
            best[start] = min(cost(start, end) + best[end] for end in range(start + 1, min(len(words), start + 18) + 1))
        found = got_by_doc(fq.boundary_dp(spark, SF))[doc] if doc == "0" else [(c["start_ms"], c["end_ms"], c["text"]) for c in fd.best_breaks([{"start_ms": s, "end_ms": e, "text": t} for s, e, t in cues])]
        sizes = [len(t.split()) for _, _, t in found]
        ends = np.cumsum(sizes).tolist()
        assert " ".join(t for _, _, t in found) == " ".join(w["text"] for w in words)
        assert abs(sum(cost(a, b) for a, b in zip([0, *ends], ends, strict=False)) - best[0]) < 1e-9


def merged_by_search(left, right):
    """All shifts of two lists of texts, place by place."""
    best = None
    for i in range(1, len(left) + len(right) + 1):
        pairs = [(a, a - len(left) + i) for a in range(len(left)) if 0 <= a - len(left) + i < len(right)]
        n = sum(left[a] == right[b] for a, b in pairs)
        if n >= 2 and (best is None or n / i + i / 10000 > best[0]):
            best = (n / i + i / 10000, pairs)
    return best[1] if best else []


def test_chunk_merge(spark):
    rng = np.random.default_rng(1)
    for _ in range(300):
        left = [{"start_ms": 10 * i, "end_ms": 10 * i + 30, "text": str(rng.integers(0, 5))} for i in range(rng.integers(1, 9))]
        first = int(rng.integers(0, len(left)))
        right = [{"start_ms": 10 * (first + i), "end_ms": 10 * (first + i) + 30, "text": left[first + i]["text"] if first + i < len(left) and rng.random() < 0.8 else str(rng.integers(0, 5))} for i in range(rng.integers(1, 9))]
        got = fd.laid_over(left, right, 10**6)
        pairs = merged_by_search([c["text"] for c in left], [c["text"] for c in right])
        if left[-1]["end_ms"] <= right[0]["start_ms"]:
            assert got == left + right
        elif pairs:
            a, b = pairs[len(pairs) // 2] if len(pairs) > 1 else pairs[0]
            assert got == left[:a] + right[b:]
        else:
            assert got[-len(right) :] == right and got[: -len(right)] == [c for c in left if c["start_ms"] < right[0]["start_ms"]]
    whole, merged = cues_by_doc(spark), got_by_doc(fq.chunk_merge(spark, SF))
    assert {d: [t for _, _, t in c] for d, c in merged.items()} == {d: [t for _, _, t in c] for d, c in whole.items()}


def longest_blocks(a, b):
    """Characters of the longest common block and, recursively, of what lies before and after it."""
    if not a or not b:
        return 0
    size, i, j = 0, 0, 0
    run = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for x in range(len(a)):
        for y in range(len(b)):
            if a[x] == b[y]:
                run[x + 1][y + 1] = run[x][y] + 1
                n, p, q = run[x + 1][y + 1], x - run[x][y], y - run[x][y]
                if n > size or (n == size and (p, q) < (i, j)):
                    size, i, j = n, p, q
    return size + longest_blocks(a[:i], b[:j]) + longest_blocks(a[i + size :], b[j + size :]) if size else 0


def test_source_similarity(spark):
    c = {(r.doc_id, r.idx): bare(r.text) for r in fq.cues(spark, SF).collect()}
    rows = [r for r in fq.source_similarity(spark, SF).collect()]
    assert len(rows) == sum((d, i - 1) in c for d, i in c)
    small = [r for r in rows if len(c[r.doc_id, r.idx]) * len(c[r.doc_id, r.idx - 1]) < 60_000][:25]
    assert small
    for r in small:
        a, b = c[r.doc_id, r.idx - 1], c[r.doc_id, r.idx]
        assert r.ratio == pytest.approx(2 * longest_blocks(a, b) / (len(a) + len(b)) if a and b else float(a == b))


def test_speaker_error(spark):
    rows, last = {}, {}
    for r in turns(spark, SF).orderBy("user_id", "start_ms", "event_id").collect():
        if r.user_id in last:
            rows.setdefault(r.user_id, []).append((r.event_type, last[r.user_id]))
        last[r.user_id] = r.event_type
    got = {r.user_id: (r.total, r.explained) for r in fq.speaker_error(spark, SF).collect()}
    assert got.keys() == rows.keys()
    for user, pairs in rows.items():
        truth, said = sorted({a for a, _ in pairs}, key=str), sorted({b for _, b in pairs}, key=str)
        wide = truth + [object()] * max(0, len(said) - len(truth))
        assert got[user] == (len(pairs), max(sum(dict(zip(said, p, strict=False))[b] == a for a, b in pairs) for p in permutations(wide, len(said))))


def test_boundary_f1(spark):
    sides = {}
    for r in turns(spark, SF).collect():
        sides.setdefault(r.user_id, ([], []))[r.event_id % 2].append(r.start_ms)
    for r in fq.boundary_f1(spark, SF).collect():
        reference, found = map(sorted, sides[r.key])
        used, hits = [False] * len(found), 0
        for at in reference:
            for i, f in enumerate(found):
                if not used[i] and abs(f - at) <= 3_600_000:
                    used[i], hits = True, hits + 1
                    break
        assert r.hits == hits and r.precision == (hits / len(found) if found else 0) and r.recall == (hits / len(reference) if reference else 0)


def test_hot_keys_give_the_same(spark):
    """One key with nearly all rows: the pieces it is dealt into give what a window over the whole key gives."""
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 50 else f"k{i}", i, int(t), int(t) + 5, int(rng.integers(1, 9))) for i, t in enumerate(np.sort(rng.integers(0, 100_000, 3000)))]
    df = spark.createDataFrame(rows, "key string, id long, start_ms long, end_ms long, v long")
    got = {r.id: (r.window_count, r.window_sum) for r in rn.rolling(df, ["key"], "start_ms", "v", 700).collect()}
    for key, i, t, _, _ in rows[::37]:
        near = [r for r in rows if r[0] == key and t - 700 <= r[2] <= t]
        assert got[i] == (len(near), sum(r[4] for r in near))
    hot = [r for r in rows if r[0] == "hot"]
    placed = {r.idx: r.gap for r in ev.placed(df.where("key = 'hot'"), "key", ["start_ms", "id"], "start_ms", "end_ms", 1000).collect()}
    assert placed == {i: (hot[i + 1][2] - hot[i][3] if i + 1 < len(hot) else None) for i in range(len(hot))}


def test_rolling_counts_are_one_running_sum(spark):
    rng = np.random.default_rng(5)
    times = [0, 0, 700, 701, 1399, 1400, 1401, 2100, 2101, -1, -700, -701, *map(int, rng.integers(-3000, 3000, 300))]
    rows = [(None if i % 7 == 0 else "ab"[i % 2], i, t, None if i % 3 == 0 else int(rng.integers(-9, 9))) for i, t in enumerate(times)]
    found = rn.rolling(spark.createDataFrame(rows, "key string, id long, at long, v long"), ["key"], "at", "v", 700)
    got = {r.id: (r.window_count, r.window_sum) for r in found.collect()}
    for key, i, t, _ in rows:
        near = [r[3] for r in rows if r[0] == key and t - 700 <= r[2] <= t]
        known = [v for v in near if v is not None]
        assert got[i] == (len(near), sum(known) if known else None)
    frames = re.findall(r"specifiedwindowframe\(RangeFrame, ([^,]*),", found._jdf.queryExecution().executedPlan().toString())
    assert frames and set(frames) == {"unboundedpreceding$()"}


def test_centroids_in_blocks_are_the_same(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 7, rng.normal(size=4).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, label long, v array<double>")
    one, many = (sorted(map(tuple, cp.centroid_margins(df, "label", "v", "id", b).collect())) for b in (256, 2))
    assert one == many and len(one) == 120


def test_saved_cues_do_not_overlap(spark, tmp_path):
    cues = spark.createDataFrame([("d", 0, 0, 2500, "a\nb", "x", "S"), ("d", 1, 2000, 4000, "c", None, "T"), ("d", 2, 9000, 9500, "e", None, None)], "doc_id string, idx long, start_ms long, end_ms long, text string, translated string, speaker string")
    wr.save(cues, str(tmp_path / "out"), "srt")
    content = spark.read.text(str(tmp_path / "out"), wholetext=True).selectExpr("'d' AS doc_id", "value AS content")
    back = sub.parse_srt(content).orderBy("idx").collect()
    assert [(r.start_ms, r.end_ms) for r in back] == [(0, 2250), (2250, 4000), (9000, 9500)] and [r.speaker for r in back] == ["S", "T", None]
