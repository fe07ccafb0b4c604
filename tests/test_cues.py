"""Cases of cue tables and text rules that no supplied table holds."""

import random
import time

from pyspark.sql import functions as F

from cuelattice.functions import text as tx
from cuelattice.operators import corpus as cp
from cuelattice.operators import cues as cu
from cuelattice.queries import cue_queries as cq
from tests.moved import exchanges


def test_media_of_unknown_length_cuts_nothing(spark):
    df = spark.createDataFrame([(i, 0, 100, m) for i, m in enumerate((None, 0, -5, 50, 200))] + [(5, 60, 90, 50)], "id int, start_ms long, end_ms long, media long")
    got = {r.id: r.end_ms for r in cu.clipped(df, F.col("media")).collect()}
    assert got == {0: 100, 1: 100, 2: 100, 3: 50, 4: 100}


def test_groups_carry_the_last_known_label(spark):
    rows = [("d", i, 10 * i, 10 * i + 9, label) for i, label in enumerate(("a", None, "b", None, "b", "a"))]
    df = spark.createDataFrame(rows, "doc string, idx int, start_ms long, end_ms long, who string")
    got = cu.time_groups(df, ["doc"], ["idx"], 1000, ["who"]).orderBy("start_ms").collect()
    assert [r.members for r in got] == [2, 3, 1]


def test_addresses_and_notes(spark):
    cases = {
        "www.example.com/about": True, " https://a-b.org / x_y / z! ": True, "Example.COM.": True, "a.b": True, "no address": False, "e.g. this": False,
        "word": False, "a..b": False, "a.b//c": False, "a_b.com": False, "": False,
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want boolean").select("want", tx.is_address(F.col("t")).alias("got"))
    assert all(r.got == r.want for r in df.collect())
    notes = {"(merged with the previous)": True, "Merged into above": True, "merged the previous": True, "merged": False, "同上。": True}
    df = spark.createDataFrame(list(notes.items()), "t string, want boolean").select("want", tx.is_note(F.col("t")).alias("got"))
    assert all(r.got == r.want for r in df.collect())


def test_hours_of_turns_are_dealt_out_by_the_hour(spark):
    found = cq.simultaneous_speech(spark, "/root/testdata/sf0.001")
    found.collect()
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert 0 < sum(n for n, _ in exchanges(found)) < 4 * events


def test_parts_of_long_cues(spark):
    rng = random.Random(7)
    texts = ["", " ", "short  one", "\t" * 90, " ".join("w" * rng.randint(1, 9) for _ in range(60)), "  a" * 70, "x" * 200 + " yy", " ".join("v" * rng.randint(1, 12) for _ in range(60_000))]
    df = spark.createDataFrame([(i, 0, 1000, t, None) for i, t in enumerate([*texts, None])], "id long, start_ms long, end_ms long, text string, translated string")
    began = time.time()
    got = sorted((r.id, r.part, r.start_ms, r.end_ms, r.text) for r in cu.split_evenly(df, ["id"]).collect())
    want = []
    for i, t in enumerate(texts):
        bare = t.strip(" ")
        n, at, parts = max(1, -(-len(bare) // 70)), 0, {}
        for w in bare.split():
            parts.setdefault(int((at + len(w) / 2) * n / max(1, len(bare))), []).append(w)
            at += len(w) + 1
        each = [(p, " ".join(ws)) for p, ws in parts.items() if p < n] if n > 1 else [(0, t)] * (t != "")
        want += [(i, p, int(p * 1000 / n), int((p + 1) * 1000 / n), x) for p, x in each]
    assert [g[::4] + g[1:2] for g in got] == [w[::4] + w[1:2] for w in sorted(want)] and len(got) > 4000
    assert all(abs(g[2] - w[2]) <= 1 and abs(g[3] - w[3]) <= 1 for g, w in zip(got, sorted(want), strict=True)) and time.time() - began < 60


def test_claims_are_the_longest_runs(spark):
    rng = random.Random(8)
    rows = [("d", i, rng.choices("abc", k=rng.randint(0, 40)), rng.choices("abc", k=rng.randint(0, 40))) for i in range(60)] + [("e", 0, ["a"] * 5000, ["a"] * 5000), ("e", 1, ["a"] * 5001, ["a"] * 5000 + ["b"]), ("f", 0, None, None), ("f", 1, ["a"] * 5, None)]
    found = cp.neighbour_claims(spark.createDataFrame(rows, "k string, i long, own array<string>, edited array<string>"), ["k"], "i", "own", "edited")
    got = {(r.k, r.i): (r.from_previous, r.from_next) for r in found.collect()}

    def longest(edited, other, own):
        runs = lambda t, n: {tuple(t[j : j + n]) for j in range(len(t) - n + 1)}
        return max((n for n in range(4, 13) if runs(edited, n) & runs(other, n) - runs(own, n)), default=0)

    own, want = {(k, i): o or [] for k, i, o, _ in rows}, {}
    for k, i, o, e in rows:
        told = tuple(longest(e or [], own.get((k, i + d), []), o or []) for d in (-1, 1))
        want |= {(k, i): told} if any(told) else {}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert got == want and len(want) > 20 and "array_intersect" not in plan
