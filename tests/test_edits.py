"""Edit scripts against plain tables of lengths, and the rules on them by example."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelattice.operators import edits as ed
from cuelattice.queries import edit_queries as eq

SF = "/root/testdata/sf0.001"


def longest(a, b):
    """Length of the longest common subsequence by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def holds(a, b, runs):
    """Whether runs are in order, without gaps, of the right kind, and keep as much as can be kept."""
    i = j = kept = 0
    for k, (op, a0, a1, b0, b1) in enumerate(runs):
        assert (a0, b0) == (i, j) and (a1 > a0 or b1 > b0)
        assert op == {(1, 1): "replace", (1, 0): "delete", (0, 1): "insert"}[a1 > a0, b1 > b0] or (op == "equal" and a[a0:a1] == b[b0:b1])
        assert k == 0 or (op == "equal") != (runs[k - 1][0] == "equal")
        kept += (a1 - a0) * (op == "equal")
        i, j = a1, b1
    assert (i, j) == (len(a), len(b)) and kept == longest(a, b)


@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30), st.sampled_from([1, 20, 1 << 26]))
@settings(max_examples=300, deadline=None)
def test_scripts_keep_the_longest_common_subsequence(a, b, cells):
    before, ed.CELLS = ed.CELLS, cells
    try:
        holds(a, b, ed.opcodes(a, b))
    finally:
        ed.CELLS = before


def test_long_lists_are_halved():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 400, 12_000).astype(str).tolist()
    b = [t for t in a if rng.random() > 0.1] + ["x"] * 50
    runs = ed.opcodes(a, b)
    kept = sum(r[2] - r[1] for r in runs if r[0] == "equal")
    assert kept >= len(b) - 50 and runs[-1][0] in ("insert", "replace")


def test_edit_runs_of_turns(spark):
    by = {}
    for r in eq.edit_runs(spark, SF).collect():
        by.setdefault((r.conv_id, r.turn), []).append(r)
    t = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").selectExpr("conv_id", "turn", "text", "lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS n")
    t = t.select("conv_id", "turn", ed.tokens(t.text).alias("a"), ed.tokens(t.n).alias("b")).collect()
    for r in t:
        runs = sorted(by.pop((r.conv_id, r.turn), []), key=lambda x: x.run)
        holds(r.a, r.b, [(x.op, x.a0, x.a1, x.b0, x.b1) for x in runs])
        assert all(x.removed == " ".join(r.a[x.a0 : x.a1]) and x.added == " ".join(r.b[x.b0 : x.b1]) for x in runs)
    assert not by


def line_tables(spark, source, target):
    rows = lambda lines: [("d", i, t) for i, t in enumerate(lines)]
    make = lambda lines: spark.createDataFrame(rows(lines), "doc_id string, idx long, text string")
    return make(source), make(target)


@pytest.mark.parametrize(
    "source, target, expected",
    [
        ("ab b c d e f g h i", "a b c d f g h i", "a b c d d f g h i"),
        ("a b c", "a b c", "a b c"),
        ("a b c", "b c", None),
        ("a b c", "a x y b c", "a b c"),
        ("a b c d", "a p q d", "a p q d"),
        ("a b c d", "a p d", "a p p d"),
        ("a", "z y", "z"),
    ],
)
def test_aligned_lines(spark, source, target, expected):
    got = ed.aligned(*line_tables(spark, source.split(), target.split()), ["doc_id"]).orderBy("place").collect()
    assert [r.source for r in got] == source.split()
    assert [r.target for r in got] == (expected.split() if expected else [None, "b", "c"])


def test_alignment_of_missing_documents_and_null_lines(spark):
    a, b = line_tables(spark, ["x", None, "y"], [])
    got = ed.aligned(a, b, ["doc_id"]).orderBy("place").collect()
    assert [(r.source, r.target, r.filled) for r in got] == [("x", None, True), (None, None, True), ("y", None, True)]
    a, b = line_tables(spark, ["x", None, "y"], ["x", None, "y"])
    assert [(r.target, r.filled) for r in ed.aligned(a, b, ["doc_id"]).orderBy("place").collect()] == [("x", False), (None, False), ("y", False)]
    assert ed.aligned(*line_tables(spark, [], ["x"]), ["doc_id"]).count() == 0


def test_aligned_turns_against_a_plain_walk(spark):
    rows = eq.aligned_turns(spark, SF).collect()
    assert rows and all(r.target == r.source or r.filled or r.target != r.source for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for lines in by.values():
        lines.sort(key=lambda r: r.place)
        assert [r.place for r in lines] == list(range(len(lines)))
        for before, r in zip([None, *lines], lines, strict=False):
            assert not r.filled or r.target == (before.target if before else None)


@pytest.mark.parametrize(
    "original, edited, expected",
    [
        ("We we went home um today", "we went home today", []),
        ("you know it works", "it works", []),
        ("the cats cat sat", "the cat sat", []),
        ("Black berry pie", "Blackberry pie", []),
        ("I have two dogs", "I have 2 dogs", []),
        ("she recieved mail", "she received mail", []),
        ("at the last moment", "in the last moment", []),
        ("at the first moment", "in the first moment", ["replace: at -> in"]),
        ("we went home", "we stayed home", ["replace: went -> stayed"]),
        ("we went home", "we went", ["delete: home -> "]),
        ("we went home", "we all went home", ["insert:  -> all"]),
        ("", "new words", ["insert:  -> new words"]),
        (None, None, []),
    ],
)
def test_lexical_violations(spark, original, edited, expected):
    df = spark.createDataFrame([(1, original, edited)], "id int, a string, b string")
    assert ed.lexical_violations(df, ["id"], "a", "b").first().violations == expected


def test_the_query_finds_the_exchanged_words(spark):
    rows = {(r.conv_id, r.turn): r.violations for r in eq.lexical_violations(spark, SF).collect()}
    long = [r for r in eq.edited_turns(spark, SF).collect() if len(r.text.split()) > 12]
    found = [" other" in rows[r.conv_id, r.turn] for r in long]
    assert long and sum(found) > 0.8 * len(found)  # some words are respelt as "other"
    short = [r for r in eq.edited_turns(spark, SF).collect() if len(r.text.split()) < 5]
    assert all(rows[r.conv_id, r.turn] == "" for r in short)
