"""Loops of every width that the reference tries."""

from cuelattice.queries import all_queries


def test_loops_of_every_width(spark, tmp_path):
    rows = [(k, " ".join([f"p{k}x{i}" for i in range(k)] * max(4, -(-12 // k))) + " end") for k in range(1, 13)] + [(20, "no " * 11), (21, "a b " * 5)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.width, r.first_at, r.repeats) for r in all_queries()["loop_candidates"](spark, str(tmp_path)).collect()}
    assert {(k, k, 0, max(4, -(-12 // k))) for k in range(1, 13)} <= got
    assert not any(d >= 20 for d, *_ in got)
