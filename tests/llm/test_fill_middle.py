"""Fill-in-the-middle against its SQL, against plain slicing of a unit list, and on odd rows."""

import hashlib
import re

from helpers import ODD, docs, odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelattice.llm import fill_middle
from tests.oracle import same


def test_matches_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        same(spark, fill_middle.op13_fill_middle, fill_middle.ORACLES["op13_fill_middle"], f"/root/testdata/{sf}")


@given(st.text("ab\n\r é日", max_size=60), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
@settings(max_examples=300, deadline=None)
def test_cuts_are_those_of_the_whole_list(text, a, b):
    for pattern in (fill_middle.LINES, r"\s*\S+|\s+", r"(?s:.)"):
        units = [m.group() for m in re.finditer(pattern, text)]
        low, high = sorted((a % (len(units) + 1), b % (len(units) + 1)))
        assert fill_middle.cuts(text, re.compile(pattern), a, b) == (len(units), len("".join(units[:low])), len("".join(units[:high])))


def expected(key, text):
    text = text or ""
    units = re.findall(fill_middle.LINES, text)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    spm = h[3] % 100 < 50
    return len(units), "spm" if spm else "psm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"


def test_markers_line_ends_and_round_trip(spark):
    texts = [
        "one\ntwo\nthree", "\n\n\n", "no newline", "a\r\nb\rc\n", "ends\n", "has <P> in it\nx", "<S", "<S\n<\nP>\n>", "a<M>\n", "日本\né\n" * 40,
        "x\n" * 300_000, "y" * 2_000_000, "same\ntext\n", "same\ntext\n", None, "", *[f"l{i}\n" * (i % 7) + "<P\n<M" for i in range(60)],
    ]
    made = fill_middle.transform(docs(spark, texts))
    got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).orderBy("doc_id").collect()
    for i, (row, text) in enumerate(zip(got, texts, strict=True)):
        assert (row.n, row.form, row.prefix_chars, row.middle_chars, row.output) == expected(i, text)
        assert row.back == (text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_odd_rows_clashing_names_and_empty_table(spark):
    df = odd_docs(spark).selectExpr("*", "7 AS n", "'x' AS form", "2 AS cut", "'k' AS output")
    got = fill_middle.transform(df, keep=("doc_id", "text", "n", "form", "cut", "output")).collect()
    assert len(got) == len(ODD) + 2
    for row in got:
        assert (row._n, row._form, row.prefix_chars, row.middle_chars, row._output) == expected(row.doc_id, row.text)
        assert (row.n, row.form, row.cut, row.output) == (7, "x", 2, "k")
    assert fill_middle.transform(docs(spark, [])).count() == 0


def test_rates_and_other_units(spark):
    df = docs(spark, ["a b c d\ne f"] * 400)
    forms = {(r, s): {x.form: x["count"] for x in fill_middle.transform(df, rate=r, spm_rate=s).groupBy("form").count().collect()} for r, s in ((0, 50), (100, 0), (100, 100), (50, 50))}
    assert forms[0, 50] == {"plain": 400} and forms[100, 0] == {"psm": 400} and forms[100, 100] == {"spm": 400}
    assert all(n > 60 for n in forms[50, 50].values()) and len(forms[50, 50]) == 3
    words = fill_middle.transform(df, pattern=r"\s*\S+|\s+")
    assert {r.n for r in words.collect()} == {6}
