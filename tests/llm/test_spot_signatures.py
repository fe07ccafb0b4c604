"""Spot signatures against their SQL, against a plain walk over the words, and on odd rows."""

import hashlib
import random
from itertools import islice

import pytest
from helpers import ODD, SCHEMA, docs, odd_docs
from pyspark.sql import functions as F

from cuelattice.llm import spot_signatures as spots
from tests.oracle import same


def test_matches_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        same(spark, spots.op11_spot_signatures, spots.ORACLES["op11_spot_signatures"], f"/root/testdata/{sf}")


def plain(text, chain=3, gap=8):
    """The signatures of a text by walking from each word that starts one."""
    for mark in spots.MARKS + spots.SPACES:
        text = text.replace(mark, " ")
    words, anchors, out, since = text.lower().split(" "), set(spots.ANCHORS), set(), 0
    words = [w for w in words if w]
    follow = lambda i: list(islice((words[k] for k in range(i, len(words)) if words[k] not in anchors), chain))
    out.add(" ".join(follow(0)))
    for i, w in enumerate(words):
        if w in anchors:
            out.add(" ".join([w, *follow(i + 1)]))
            since = 0
        else:
            if since >= gap:
                out.add(" ".join(follow(i)))
            since += 1
    return out - {""}


def digest(found):
    return hashlib.sha256("\n".join(sorted(found, key=lambda s: s.encode())).encode()).hexdigest()


def alike(a, b, least):
    if not a and not b:
        return 1.0
    return 0.0 if min(len(a), len(b)) < least * max(len(a), len(b)) else len(a & b) / len(a | b)


def expected(texts, least=spots.LEAST):
    """The results of texts in order of their documents."""
    texts = [t or "" for t in texts]
    for t, after in zip(texts, texts[1:] + texts[:1], strict=True):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = plain(t), plain(edited), plain(after)
        yield (len(t), hashlib.sha256(edited.encode()).hexdigest(), digest(a), digest(b), alike(a, b, least), alike(a, c, least))


def results(row, names=("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")):
    return tuple(row[n] for n in names)


def some_texts(seed=5, n=80):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "der", "que", "É", "日本語"] + [f"w{i}" for i in range(40)]
    return [" ".join(rng.choices(vocabulary if i % 3 else vocabulary[7:], k=rng.randrange(0, 60))) + "." * (i % 2) for i in range(n)]


def test_signatures_are_those_of_a_walk(spark):
    texts = some_texts() + ["the", "the of", "of the House, of the Lords.", "x", "", "don't stop", " ".join(map(str, range(30)))]
    got = docs(spark, texts).select("doc_id", spots.signatures(F.col("text")).alias("s")).orderBy("doc_id").collect()
    assert [set(r.s) for r in got] == [plain(t) for t in texts] and all(len(r.s) == len(set(r.s)) for r in got)


@pytest.mark.parametrize("ranges", [2, 7, 512])
def test_edits_and_next_documents_whatever_the_ranges(spark, monkeypatch, ranges):
    texts, make = some_texts(), spots.ranged
    monkeypatch.setattr(spots, "ranged", lambda rows, size: make(rows, size, ranges, 400))
    ids = random.Random(1).sample(range(-1000, 10**12), len(texts) - 2) + [-(2**63), 2**63 - 1]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(5)
    got = sorted(spots.with_edits(df).collect(), key=lambda r: r.doc_id)
    in_order = [t for _, t in sorted(zip(ids, texts, strict=True))]
    assert [results(r) for r in got] == list(expected(in_order))


def test_a_hot_id_and_null_ids_are_dealt_out(spark):
    df = spark.range(4000).selectExpr("IF(id % 3 = 0, 5, IF(id % 3 = 1, id, NULL)) AS id", "xxhash64(id) AS h", "repeat('x', 10) AS text")
    placed = spots.ranged(df, 40_000, 60)
    by = {k: placed.where(cond).groupBy("range").count().agg(F.max("count"), F.count("*")).first() for k, cond in (("hot", "id = 5"), ("null", "id IS NULL"))}
    assert all(most < 250 and n > 10 for most, n in by.values())
    rows = sorted(placed.collect(), key=lambda r: (r.id is None, r.id or 0, r.h % 2**64))
    assert [tuple(r.range) for r in rows] == sorted(tuple(r.range) for r in rows)


def test_odd_rows_single_document_and_empty_table(spark):
    got = spots.with_edits(odd_docs(spark)).collect()
    assert len(got) == len(ODD) + 2 and all(None not in results(r) for r in got)
    assert {r.fingerprint for r in got if r.n_chars < 1 or r.n_chars == 3} == {digest(set())}
    assert len({r.fingerprint for r in got if r.n_chars == 27}) == 1
    assert [results(r) for r in spots.with_edits(docs(spark, ["the one and only text here"])).collect()] == list(expected(["the one and only text here"]))
    assert spots.with_edits(docs(spark, [])).count() == 0


def test_clashing_names_and_very_long_texts(spark):
    long = " ".join(f"the w{i} of x{i} y" for i in range(60_000))
    df = docs(spark, [long, "z" * 1_000_000, long, long + " end"]).selectExpr("*", "1 AS range", "2 AS h", "3 AS fingerprint", "4 AS next", "5 AS id", "6 AS keep_0")
    got = spots.with_edits(df, keep=("doc_id", "n_chars", "range", "h", "fingerprint", "next", "id", "keep_0")).orderBy("doc_id").collect()
    wanted = list(expected([long, "z" * 1_000_000, long, long + " end"]))
    for r, w in zip(got, wanted, strict=True):
        assert (r.range, r.h, r.fingerprint, r.next, r.id, r.keep_0) == (1, 2, 3, 4, 5, 6)
        assert results(r, ("_n_chars", "edited_sha256", "_fingerprint", "edited_fingerprint", "near_edited", "near_next")) == w


def test_length_classes_and_pruning(spark):
    a, b = F.transform(F.sequence(F.lit(1), F.col("n")), lambda x: x.cast("string")), F.transform(F.sequence(F.lit(1), F.col("m")), lambda x: x.cast("string"))
    df = spark.createDataFrame([(n, m) for n in (1, 5, 9, 10, 99, 101, 400) for m in (1, 10, 50, 91, 1000)], "n int, m int")
    for r in df.select("n", "m", spots.likeness(a, b, 0.1).alias("s")).collect():
        ratio = min(r.n, r.m) / max(r.n, r.m)
        assert r.s == (ratio if ratio >= 0.1 else 0.0)
