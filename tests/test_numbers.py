"""Numbers, offsets of chunks and language labels against plain passes over Python lists."""

import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from cuelattice.functions import numbers as nb
from cuelattice.operators import languages as lg
from cuelattice.operators import numerals as nu
from cuelattice.queries import number_queries as nq

SF = "/root/testdata/sf0.001"


def plainly(text):
    """Left to right: a run of numbers and commas is joined if all groups but the first have three digits."""
    return re.sub(r"(?<![0-9.])[0-9]+(?:,[ \t]*[0-9]+)+(?:\.[0-9]+)?", lambda m: re.sub(r"[, \t]", "", m[0]) if re.fullmatch(r"[0-9]{1,3}(,[ \t]*[0-9]{3})+(\.[0-9]+)?", m[0]) else m[0], text)


def listed(text):
    found = re.findall(r"[0-9]+(?:\.[0-9]+)?", plainly(text or ""))
    return [str(int(n.split(".")[0])) + ("." + f if (f := n.partition(".")[2].rstrip("0")) else "") for n in found]


def column(spark, values, kind, made):
    return [r.made for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}").select("i", made(F.col("v")).alias("made")).orderBy("i").collect()]


def test_groups_and_numbers(spark):
    rng = random.Random(5)
    texts = ["", None, "1,234", "1, 234,567.50", "2019, 300 cars", "1,23,456", "1234,567", "1.234,567,890", "a1,000b", "007 and 0.50 and 10.0 and 0", "5,000,"]
    texts += ["".join(rng.choice("0123456789,,,. \ta") for _ in range(rng.randrange(40))) for _ in range(400)]
    assert column(spark, texts, "string", nb.plain_groups) == [None if t is None else plainly(t) for t in texts]
    assert column(spark, texts, "string", nb.numbers) == [None if t is None else listed(t) for t in texts]


def test_words_of_numbers(spark):
    cases = {
        "0": "zero", "007": "seven", "13": "thirteen", "40": "forty", "105": "one hundred five", "1,000": "one thousand", "1905": "nineteen five", "1900": "nineteen hundred",
        "2000": "twenty hundred", "2005": "two thousand five", "2010": "twenty ten", "1899": "one thousand eight hundred ninety nine", "12.05": "twelve point zero five",
        "1000000": "one million", "2000000000": "two billion", "1000000000000": "one thousand billion", "1000000001": "one billion one", "1" * 19: None, "-4": None, "x": None, "": None, "1.": None, None: None,
    }
    assert column(spark, list(cases), "string", nb.number_words) == list(cases.values())
    assert column(spark, ["1905", "2000"], "string", lambda c: nb.number_words(c, years=False)) == ["one thousand nine hundred five", "two thousand"]


def test_small_numbers(spark):
    cases = {"One": 1.0, " twenty ": 20.0, "three  and a half": 3.5, "twenty one": None, "zero": None, "2.5": 2.5, "": None, None: None, "and a half": None}
    assert column(spark, list(cases), "string", nb.small_number) == list(cases.values())


def test_changed_numbers(spark):
    rows = [(1, "1,000 and 2", "1000, 2.0"), (2, "3 3 4", "3 4 4"), (3, None, "5"), (4, "6", None), (5, None, None), (6, "", ""), (7, "1 2", "1"), (7, "3", "2 3"), (None, "8", "9")]
    got = {tuple(r) for r in nu.changed_numbers(spark.createDataFrame(rows, "k long, a string, b string"), ["k"], "a", "b").collect()}
    assert got == {(2, "3", 2, 1), (2, "4", 1, 2), (3, "5", 0, 1), (4, "6", 1, 0), (None, "8", 1, 0), (None, "9", 0, 1)}
    empty = spark.createDataFrame([], "k long, a string, b string")
    assert nu.changed_numbers(empty, ["k"], "a", "b").count() == 0


def test_changed_numbers_where_a_price_is_the_year(spark, tmp_path):
    rows = [(3, 1996.25, "1996-05-01"), (6, 2001.0, "2001-01-01"), (9, 1997.5, None), (1998, 1998.4, "1998-02-02"), (4, 1995.0, "1995-07-07")]
    df = spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, d string").selectExpr("o_orderkey", "o_totalprice", "CAST(d AS timestamp_ntz) AS o_orderdate")
    df.write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.sql(f"SELECT o_orderkey, number, in_source, in_target FROM ({nq.ORACLES['changed_numbers']})").fetchall()
    got = nq.changed_numbers(spark, str(tmp_path)).select("o_orderkey", "number", "in_source", "in_target").collect()
    assert sorted(map(tuple, got)) == sorted(want) and (3, "1996", 0, 1) in want and len(want) == 6


def test_words_of_a_group_are_looked_up(spark):
    assert nb.BELOW_THOUSAND[0] == "" and nb.BELOW_THOUSAND[100] == "one hundred" and nb.BELOW_THOUSAND[919] == "nine hundred nineteen" and nb.BELOW_THOUSAND[42] == "forty two"
    got = spark.range(1000).select(nb.below_thousand(F.col("id")).alias("w")).collect()
    assert tuple(r.w for r in got) == nb.BELOW_THOUSAND


def test_lost_numbers(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for d in docs:
        a, b = Counter(listed(d.text)), Counter(listed((d.text or "").replace("7", "1")))
        want |= {(d.doc_id, n, a[n], b[n]) for n in a.keys() | b.keys() if a[n] != b[n]}
    assert {tuple(r) for r in nq.lost_numbers(spark, SF).collect()} == want


def test_chunks_on_one_timeline(spark):
    cues = [("a", 0, 0, 0, 9000), ("a", 1, 0, 100, 200), ("a", 1, 1, 300, 5000), ("a", 3, 0, 0, 500), ("a", 4, 0, 7, 8), ("b", 2, 0, 5, 6), (None, 0, 0, 0, 4000), (None, 1, 0, 1, 2)]
    df = spark.createDataFrame(cues, "k string, chunk long, idx long, start_ms long, end_ms long")
    got = sorted(map(tuple, nu.on_one_timeline(df, ["k"], 2000).collect()), key=repr)
    off = {("a", 0): 0, ("a", 1): 7000, ("a", 3): 10000, ("a", 4): 10000, ("b", 2): 0, (None, 0): 0, (None, 1): 2000}
    assert got == sorted([(k, c, i, s + off[k, c], e + off[k, c]) for k, c, i, s, e in cues], key=repr)


def test_material_switches(spark):
    labels = ["en", "en", "en", "ja", "zh", "zh", "zh", None, "en", "en", "en", "mixed", "ko", "ko", "ko", "en", "en", "en"]
    rows = [("a", i, lab, i * 100, i * 100 + 90) for i, lab in enumerate(labels)] + [("b", 0, "en", 0, 900), ("b", 1, "ja", 900, 1800), ("b", 2, "ja", 1800, 1801)]
    df = spark.createDataFrame(rows, "k string, i long, lang string, start_ms long, end_ms long")
    got = {(r.k, r.before, r.after, r.at_ms) for r in lg.material_switches(df, ["k"], ["i"], "lang").collect()}
    assert got == {("a", "ko", "en", 1500), ("b", "en", "ja", 900)}


def test_stabilised(spark):
    rows = [("a", "zh", 20.0, True), ("a", "ja", 6.0, True), ("a", "ja", 6.0, True), ("a", "ko", 30.0, False), ("a", "yue", 9.0, True), ("a", "en", 0.1, False), ("a", None, 1.0, False)]
    rows += [("b", "ja", 1.0, False), ("c", "ja", 1.0, True), ("c", "zh", 1.0, True), (None, "ja", 3.0, True), (None, "zh", None, True), ("d", "en", 1.0, True)]
    df = spark.createDataFrame(rows, "k string, lang string, s double, ok boolean")
    got = Counter((r.k, r.lang, r.retained) for r in lg.stabilised(df, ["k"], "lang", F.col("s"), F.col("ok")).collect())
    lost = {("a", "zh"), ("a", "ja"), ("a", "yue"), ("c", "zh"), (None, "zh")}
    assert got == Counter((k, lab, (k, lab) not in lost) for k, lab, _, _ in rows)
