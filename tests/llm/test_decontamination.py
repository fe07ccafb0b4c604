"""Windows found against a brute-force search of every window of every document."""

from collections import Counter

import numpy as np
from helpers import docs, odd_docs

from cuelattice.llm import decontamination as dc
from cuelattice.llm.common import table

SF = "/root/testdata/sf0.001"


def shingles(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or Counter([tuple(words)])


def brute(texts, items):
    pairs, owners = {}, {}
    for i, b in items:
        for g in shingles((b or "").encode().lower().split()):
            owners.setdefault(g, set()).add(i)
    for d, t in texts:
        w = (t or "").encode().lower().split()
        seen = {i for k in range(1, 6) for s in range(len(w) - k + 1) for i in owners.get(tuple(w[s : s + k]), ())}
        for i, b in items:
            if i not in seen:
                continue
            iw = (b or "").encode().lower().split()
            want, n = shingles(iw), len(iw)
            k = min(5, n)
            for s in range(max(1, len(w) - n + 1) if n and len(w) >= k else 0):
                got = shingles(w[s : s + n])
                alike = sum((got & want).values()) / sum((got | want).values())
                if alike >= 0.8:
                    pairs[d, i] = max(alike, pairs.get((d, i), 0))
    return {k: round(v, 9) for k, v in pairs.items()}


def best(rows):
    out = {}
    for r in rows:
        out[r.doc_id, r.item_id] = max(round(r.similarity, 9), out.get((r.doc_id, r.item_id), 0))
    return out


def test_documents(spark):
    d, b = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    want = brute([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in b.collect()])
    assert want and best(dc.op2_decontamination(spark, SF).collect()) == want


def test_altered_passages(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([60, 40, 25, 5, 3, 1, 0])]
    texts = []
    for _ in range(40):
        w = [word() for _ in range(50)]
        i = rng.integers(0, 3)
        passage = items[i][1].split()
        for _ in range(rng.integers(0, 3)):
            at = rng.integers(0, len(passage))
            passage[at : at + 1] = [[], [word()], [word(), word()]][rng.integers(0, 3)]
        texts.append(" ".join(w[:20] + [p.upper() for p in passage] + w[20:]))
    texts += [items[3][1], items[4][1] + " x", "y " + items[5][1], None, ""]
    texts += [" ".join(items[0][1].split()[:n]) for n in (58, 52, 49, 40)]  # shorter than the item
    got = dc.find(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).selectExpr("doc_id", "inline(hits)").collect()
    assert best(got) == brute(list(enumerate(texts)), items)


def test_small_groups_filter_and_no_broadcast_give_the_same(spark, monkeypatch):
    whole = best(dc.op2_decontamination(spark, SF).collect())
    docs_, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    kept = sorted(r.doc_id for r in dc.keep_uncontaminated(docs_, bench).collect())
    for name, x in (("GROUP", 2), ("FILTER", 17), ("BROADCAST", 0)):
        monkeypatch.setattr(dc, name, x)
    assert best(dc.op2_decontamination(spark, SF).collect()) == whole
    assert sorted(r.doc_id for r in dc.keep_uncontaminated(docs_, bench).collect()) == kept == sorted({r.doc_id for r in docs_.collect()} - {d for d, _ in whole})


def test_many_items_of_one_length(spark):
    """20,000 items that begin alike: few of them are candidates of a document, and memory stays bounded."""
    rng = np.random.default_rng(9)
    start = [f"the{i}" for i in range(12)]
    items = [(i, " ".join(start + [f"v{x}" for x in rng.integers(0, 3000, 8)])) for i in range(20_000)]
    texts = [" ".join([f"v{x}" for x in rng.integers(0, 3000, 200)] + start + items[i][1].split()[12:]) for i in range(0, 20_000, 400)]
    df, bench = docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    named = spark.createDataFrame(bench.mapInArrow(dc.prepared, dc.ITEMS).withColumn("item", dc.F.col("item_id")).toArrow())
    seeds = spark.createDataFrame(dc.seeds_of(named, 0.8).toArrow())
    pairs = dc.candidates(dc.seeded(df, "text", seeds), seeds)
    assert len(texts) <= pairs.count() < 40 * len(texts)  # of a million pairs
    got = dc.find(df, bench).selectExpr("doc_id", "inline(hits)").collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, 400 * i) for i in range(len(texts))}


def test_copies_clashes_and_long_texts(spark):
    words = [f"w{i}" for i in range(30)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "  ".join(words).upper()), (3, None), (4, " ")], "item_id long, text string")
    long = " ".join(["filler"] * 400_000 + words + ["x" * 100_000] + words)
    rows = [(0, long, 7, "k", 1), (0, long, 8, "k", 2), (1, "nothing here", 9, None, 3), (2, None, 0, "", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hits int, key string, item_id int")
    got = dc.find(df, items).collect()
    assert [r.hits for r in sorted(got, key=lambda r: r.item_id)] == [7, 8, 9, 0]
    found = {r.hits: [(h.item_id, h.start) for h in r._hits] for r in got}
    assert found[7] == found[8] == [(1, 400_000), (2, 400_000), (1, 400_031), (2, 400_031)] and found[9] == found[0] == []
    kept = dc.keep_uncontaminated(df, items)
    assert kept.columns == df.columns and sorted(r.hits for r in kept.collect()) == [0, 9]


def test_radius_is_kept():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    items = dc.Items(list(range(60)), [], fps)
    items.index(24)
    probe = fps ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 40), replace=False)) for _ in fps], np.uint64)
    want = {(i, j) for i, p in enumerate(probe.tolist()) for j, f in enumerate(fps.tolist()) if bin(p ^ f).count("1") <= 24}
    assert set(items.near(probe, 24)) == want


def test_odd_and_empty(spark):
    bench = table(spark, SF, "benchmark")
    assert dc.keep_uncontaminated(odd_docs(spark), bench).count() == odd_docs(spark).count()
    assert dc.find(docs(spark, ["a b"]), bench.limit(0)).collect()[0].hits == []
    assert dc.find(docs(spark, []), bench).count() == 0 and dc.keep_uncontaminated(docs(spark, []), bench).count() == 0
    assert dc.keep_uncontaminated(docs(spark, ["a b"]), bench.limit(0)).count() == 1
