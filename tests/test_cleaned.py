"""Mapped words by hand, and over all turns by what a mapping has to hold."""

import re

from cuelattice.operators import cleaned as cl
from cuelattice.queries import cleaned_queries as cq

SF = "/root/testdata/sf0.001"
SCHEMA = "i long, text string, words array<struct<text:string,start_ms:long,end_ms:long,speaker:string,timing:string>>, speaker string"


def spoken(text, who=None, timing="aligned"):
    return [(w, i * 10, i * 10 + 9, who, timing) for i, w in enumerate(text.split())]


def plain(word):
    return "".join(re.findall(r"[a-z0-9]+(?:['’][a-z]+)?", word.lower())).replace("’", "'")


def within(few, many):
    """Whether ``few`` is what is left of ``many`` when some are taken out."""
    rest = iter(many)
    return all(x in rest for x in few)


def test_each_error(spark):
    cases = [
        ("So, go.", spoken("so um go"), None, None, [0, 2], [1]),
        ("the cat", spoken("the the cat"), "A", None, [0, 2], [1]),
        ("we win", spoken("we you know win"), None, None, [0, 3], [1, 2]),
        ("B flat six", spoken("b flat sixth"), None, None, [0, 1, 2], []),
        ("flat sixth gear", spoken("flat sixth gear"), None, None, [0, 1, 2], []),
        ("flat six gear", spoken("flat sixth gear"), None, "unsupported source replacement", [], []),
        ("a c", spoken("a b c"), None, "unsupported deletion", [], []),
        ("a b c", spoken("a c"), None, "unsupported source replacement", [], []),
        ("a -", spoken("a b"), None, "unmapped punctuation token", [], []),
        ("a b", spoken("a -"), None, "unreliable word timing", [], []),
        ("a", spoken("a", timing="estimated"), None, "unreliable word timing", [], []),
        ("a", [("a", 5, 5, None, None)], None, "unreliable word timing", [], []),
        ("a", [("a", None, 5, None, None)], None, "unreliable word timing", [], []),
        ("a b", [("a", 0, 11, None, None), ("b", 10, 20, None, None)], None, "overlapping words", [], []),
        ("a b", [*spoken("a", "A"), ("b", 10, 20, "B", None)], None, "mixed speaker evidence", [], []),
        ("a", spoken("a", "A"), "B", "mixed speaker evidence", [], []),
        ("a", spoken("a", ""), "B", None, [0], []),
        (None, spoken("a"), None, "missing words", [], []),
        ("", spoken("a"), None, "missing words", [], []),
        ("a", None, None, "missing words", [], []),
        ("a", [], None, "missing words", [], []),
    ]
    df = spark.createDataFrame([(i, t, w, who) for i, (t, w, who, *_) in enumerate(cases)], SCHEMA)
    got = cl.mapped_words(df, ["i"]).orderBy("i").collect()
    assert [(r.error, r.kept, r.deleted) for r in got] == [tuple(c[3:]) for c in cases]
    assert cl.mapped_words(df.limit(0), ["i"]).count() == 0


def test_all_turns(spark):
    turns = {(r.conv_id, r.turn): r for r in cq.heard_turns(spark, SF).collect()}
    got = cq.mapped_words(spark, SF).collect()
    assert len(got) == len(turns)
    errors = set()
    for r in got:
        t = turns[r.conv_id, r.turn]
        said, shown = [plain(w.text) for w in t.words], [plain(w) for w in t.text.split()]
        errors.add(r.error)
        if r.error is None:
            kept, deleted = ([int(x) for x in c.split(",") if x] for c in (r.kept, r.deleted))
            assert [said[i] for i in kept] == shown and sorted(kept + deleted) == list(range(len(said)))
            for run in re.findall(r"0+", "".join("0" if i in set(deleted) else "1" for i in range(len(said)))):
                assert len(run) <= 2
        elif r.error == "unsupported deletion":
            assert within(shown, said) or "other" in said
        elif r.error == "unsupported source replacement":
            assert "other" in said
        else:
            assert r.error in ("missing words", "unmapped punctuation token", "unreliable word timing")
        assert (r.kept == "") == (r.error is not None)
    assert {None, "unsupported source replacement"} <= errors
