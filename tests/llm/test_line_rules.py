"""Line rules against their SQL and on odd rows."""

from helpers import ODD, docs, odd_docs

from cuelattice.llm import line_rules
from tests.oracle import same


def test_matches_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        same(spark, line_rules.op7_line_rules, line_rules.ORACLES["op7_line_rules"], f"/root/testdata/{sf}")


def test_odd_rows_and_empty_table(spark):
    got = line_rules.judge(odd_docs(spark), clean_text=True).collect()
    assert len(got) == len(ODD) + 2 and all(r.kept is not None and r.base_failed is not None for r in got)
    assert next(r for r in got if r.n_words == 6000).n_repeat_words == 6000
    assert line_rules.judge(docs(spark, [])).count() == 0


def test_clashing_names_and_long_texts(spark):
    rows = [(i, "a b\n" * 200_000 if i == 0 else "x" * 1_000_000 if i == 1 else "few words", "s", 7, "h", 9) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, host string, row int")
    got = line_rules.judge(df, keep=("doc_id", "n_words", "host", "row", "text", "source"), clean_text=True).orderBy("doc_id").collect()
    assert [(r.n_words, r._n_words, r.row, r.host, r.kept) for r in got] == [(7, n, 9, "h", False) for n in (400_000, 1, 2)]


def test_frequent_lines_go_and_depleted_documents_too(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    common = "Shared  line " + " ".join(f"c{j}" for j in range(100))
    rows = [(i, own(i) + ("\n" + common if i < 30 else "") + ("\n" + own(i + 100) * (i < 5)), "en", "h" if i % 2 else None, 0) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in line_rules.judge(df, min_docs=10, clean_text=True).collect()}
    assert all(got[i].kept == (i < 5 or i >= 30) for i in range(50))
    assert all(got[i].lost_words == (102 if i < 30 else 0) for i in range(50))
    assert got[0].clean_text == own(0) + "\n" + own(100) and got[40].clean_text == own(40) + "\n"


def test_the_limit_does_not_grow_with_the_host(spark):
    common = "shared line " + " ".join(f"c{j}" for j in range(100))
    own = "concat_ws(' ', transform(sequence(1, 60), j -> concat('w', id, 'x', j)))"
    lines = f"concat({own}, if(id < 60, '\n{common}', ''), if(id < 20, '\nrare line here', ''))"
    df = spark.range(0, 25_000, 1, 8).selectExpr("id AS doc_id", f"{lines} AS text", "'en' AS lang", "'h' AS source", "0L AS n_chars")
    got = {r.doc_id: r for r in line_rules.judge(df).where("doc_id < 100").collect()}
    assert all(got[i].lost_words == (102 if i < 60 else 0) and got[i].kept == (i >= 60) for i in range(100))
