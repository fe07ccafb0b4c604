"""Boundary rules by example and in both forms, and breaks of regions against a search of all placements."""

import random
from itertools import combinations, pairwise

import pytest
from pyspark.sql import functions as F

from cuelattice.operators import boundaries as bd
from cuelattice.operators.folds import spread_words
from cuelattice.queries import boundary_queries as bq

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "left, right, rules, risk",
    [
        ("We went to the", "old house.", ["function_word"], 36),
        ("We went home.", "The house is old.", [], 0),
        ("We went home", "The house is old.", [], 0),
        ("I think that they", "left early", ["subject"], 30),
        ("it costs 300", "million dollars", ["value_and_multiplier"], 44),
        ("It was in June", "2014, I think", ["month_and_year"], 42),
        ("people such as", "Peter came", ["function_word", "multiword"], 68),
        ("they told each", "other about it", ["function_word", "lexical_unit"], 70),
        ("we talked about", "going away", ["function_word", "gerund"], 72),
        ("we met John", "Smith there", ["name"], 38),
        ("the man,", "who came", [], 0),
        ("the man", "who came", ["relative_clause"], 34),
        ("it is about the", "Same thing", ["function_word"], 32),
        ("", "the house", [], 0),
        ("the", None, [], 0),
    ],
)
def test_rules_in_both_forms(spark, left, right, rules, risk):
    assert [r.name for r in bd.found(left.split(), (right or "").split())] == rules and bd.risk(left.split(), (right or "").split()) == risk
    got = spark.createDataFrame([(left, right)], "a string, b string").select(bd.assessment(F.col("a"), F.col("b")).alias("x")).first().x
    assert (got.reasons, got.risk) == (rules, risk)


def test_both_forms_agree_on_random_words(spark):
    rng = random.Random(6)
    stock = sorted({w for r in bd.RULES for s in (r.tail, r.head) if s for w in s} | {w for r in bd.RULES for s in (r.seam, r.phrase) if s for p in s for w in p.split()})
    word = lambda: (rng.choice([*stock, "12", "1,000", "2015", "Paris", "Berlin", "going", "house"]).title() if rng.random() < 0.2 else rng.choice([*stock, "7", "house"])) + rng.choice(["", "", "", "", ",", ".", ";", "?\""])
    rows = [(" ".join(word() for _ in range(rng.randrange(0, 4))), " ".join(word() for _ in range(rng.randrange(0, 3)))) for _ in range(3000)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", bd.assessment(F.col("a"), F.col("b")).alias("x")).collect()
    assert sum(r.x.risk > 0 for r in got) > 400
    for r in got:
        assert (r.x.reasons, r.x.risk) == ([f.name for f in bd.found(r.a.split(), r.b.split())], bd.risk(r.a.split(), r.b.split()))


def searched(region, origins):
    """The least cost over all placements of as many breaks."""
    best = float("inf")
    for places in combinations(range(1, len(region)), len(origins)):
        parts = [bd.cue_cost(region[a:b]) for a, b in pairwise([0, *places, len(region)])]
        if None not in parts and all(abs(p - o) <= bd.SHIFT for p, o in zip(places, origins, strict=True)):
            best = min(best, sum(parts) + sum(bd.break_cost(region, p, o)[0] for p, o in zip(places, origins, strict=True)))
    return best


def test_region_breaks_cost_least():
    rng = random.Random(9)
    stock = "the a of house went Paris, and because it was. going 12 miles so much".split()
    for _ in range(120):
        cue = {"start_ms": 0, "end_ms": 6000, "text": " ".join(rng.choices(stock, k=rng.randrange(4, 17)))}
        region = spread_words(cue)
        origins = sorted(rng.sample(range(1, len(region)), min(rng.randrange(1, 4), len(region) - 1)))
        places, cost, risk = bd.best_places(region, origins)
        assert abs(cost - searched(region, origins)) < 1e-9 and len(places) == len(origins)
        parts = sum(bd.cue_cost(region[a:b]) for a, b in pairwise([0, *places, len(region)]))
        told = [bd.break_cost(region, p, o) for p, o in zip(places, origins, strict=True)]
        assert abs(parts + sum(c for c, _ in told) - cost) < 1e-9 and sum(d for _, d in told) == risk


def cue(start, end, text, role="a"):
    return {"start_ms": start, "end_ms": end, "text": text, "role": role}


def test_breaks_move_off_phrases_but_not_across_hard_boundaries():
    cues = [cue(0, 2000, "Last year we drove all the way to the"), cue(2000, 4000, "coast. Then the weather turned really bad.")]
    assert [c["text"] for c in bd.rebroken(cues)] == ["Last year we drove all the way to the coast.", "Then the weather turned really bad."]
    for b in (cue(2000, 4000, cues[1]["text"], "b"), cue(9000, 11000, cues[1]["text"])):
        assert bd.rebroken([cues[0], b], "role") == [cues[0], b]
    assert bd.rebroken([]) == [] and bd.rebroken([cue(0, 5, "")]) == [cue(0, 5, "")]
    assert [c["text"] for c in bd.rebroken([cue(0, 1, "the"), cue(1, 2, "")])] == ["the", ""]


def test_query_keeps_words_and_number_of_cues_and_lowers_the_risk(spark):
    def by_doc(df):
        out = {}
        for r in df.orderBy("doc_id", "idx").collect():
            out.setdefault(r.doc_id, []).append(r)
        return out

    before, after = by_doc(bq.sevens(spark, SF)), by_doc(bq.normalized_boundaries(spark, SF))
    total = lambda x: sum(bd.risk(a.text.split(), b.text.split()) for c in x.values() for a, b in pairwise(c) if a.role == b.role and b.start_ms - a.end_ms <= 1800)
    assert before.keys() == after.keys() and total(after) < 0.7 * total(before)
    for doc, cues in before.items():
        assert len(cues) == len(after[doc]) and " ".join(c.text for c in cues).split() == " ".join(c.text for c in after[doc]).split()
        assert all(a.end_ms <= b.start_ms for a, b in pairwise(after[doc]))
