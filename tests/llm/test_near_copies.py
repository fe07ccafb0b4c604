"""The pipeline's near-duplicate stage against brute force over five-word shingles."""

import numpy as np
import pyarrow as pa
import pytest
from helpers import docs, odd_docs

import corpus_pipeline
from cuelattice.llm import near_copies
from cuelattice.llm.common import table

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute_kept(rows):
    """The ids of the first row of each component; rows: (id, text)."""
    sets = [shingle_set(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if comp[i] != comp[j] and similarity(sets[i], sets[j]) >= 0.8:
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    return sorted(min(rows[i][0] for i in range(len(rows)) if comp[i] == c) for c in set(comp))


def copies(rng, n):
    """Texts of 100 to 400 words, each with a copy in which some words are others."""
    out = []
    for i in range(n):
        words = [f"w{x}" for x in rng.integers(0, 3000, rng.integers(100, 400))]
        changed = list(words)
        for at in rng.choice(len(words), 1 + i % 6 * len(words) // 200, replace=False):
            changed[at] = "other"
        out += [" ".join(words), " ".join(changed)]
    return out


@pytest.mark.parametrize("size", [512, 8])
def test_near_copies_at_08_to_095_go(spark, monkeypatch, size):
    monkeypatch.setattr(near_copies, "SLICE", size)
    texts = copies(np.random.default_rng(4), 60)
    base = texts[0].split()
    texts += [" ".join([*base[:k], "swapped", *base[k + 1 :]]) for k in range(0, 90, 3)]  # one large group
    alike = [similarity(shingle_set(texts[i]), shingle_set(texts[i + 1])) for i in range(0, 120, 2)]
    assert sum(0.8 <= x <= 0.95 for x in alike) > 20 and sum(x < 0.8 for x in alike) > 5
    rows = list(enumerate(texts))
    got = corpus_pipeline.drop_near_duplicates(spark, docs(spark, texts), SF)
    assert sorted(r.doc_id for r in got.collect()) == brute_kept(rows)


def test_documents(spark):
    df = table(spark, SF, "documents")
    got = corpus_pipeline.drop_near_duplicates(spark, df, SF)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == brute_kept([(r.doc_id, r.text) for r in df.collect()])


def test_odd_rows_and_empty_table(spark):
    df = odd_docs(spark)
    got = corpus_pipeline.drop_near_duplicates(spark, df, SF).collect()
    assert len(got) == len({shingle_set(r.text) for r in df.collect()})
    assert corpus_pipeline.drop_near_duplicates(spark, docs(spark, []), SF).count() == 0


def template_texts(n, similarity_of_two, words=240, seed=8):
    """Texts that share a template of as many words as make two of them ``similarity_of_two`` alike."""
    rng = np.random.default_rng(seed)
    common = int(words * 2 * similarity_of_two / (1 + similarity_of_two))
    template = " ".join(f"t{i}" for i in range(common + 4))
    return [template + " " + " ".join(f"u{i}x{x}" for x in rng.integers(0, 10**6, words - common)) for i in range(n)]


def test_a_template_makes_no_group(spark):
    """3000 texts at a similarity of 0.4 make fewer than three candidate pairs a text, and all stay."""
    from pyspark.sql import functions as F

    from cuelattice.llm.common import staged

    texts = template_texts(3000, 0.4)
    sets = [shingle_set(t) for t in texts[:40]]
    alike = [similarity(a, b) for a in sets for b in sets if a is not b]
    assert 0.38 < min(alike) and max(alike) < 0.44
    pairs, made = [], near_copies.verified

    def counted(found, members, similar):
        pairs.append(staged(found, "counted").count())
        return made(found, members, similar)

    near_copies.verified = counted
    try:
        got = near_copies.keep_first(docs(spark, texts)).select(F.count_distinct("doc_id")).first()[0]
    finally:
        near_copies.verified = made
    assert got == 3000 and len(pairs) == 8 and sum(pairs) < 3 * 3000


def test_chains_join_whatever_the_slices(spark, monkeypatch):
    """Each text is near its neighbours only, so stars of keys don't join all and keys are compared whole."""
    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(words[9 * i : 9 * i + 300]) for i in range(60)] + [" ".join(words[1200 + 60 * i : 1500 + 60 * i]) for i in range(5)]
    for size in (512, 4):
        monkeypatch.setattr(near_copies, "SLICE", size)
        got = near_copies.keep_first(docs(spark, texts).repartition(3))
        assert sorted(r.doc_id for r in got.collect()) == brute_kept(list(enumerate(texts)))


def test_very_long_texts_and_clashing_names(spark):
    long = " ".join(f"v{i}" for i in range(200_000))
    texts = [long, long + " end", long + " other end", "short text of a few words"]
    df = docs(spark, texts).selectExpr("*", "1 AS row", "2 AS sketch", "3 AS digest", "4 AS bands", "5 AS least", "6 AS component")
    got = near_copies.keep_first(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.row, r.sketch, r.digest, r.bands, r.least, r.component) for r in got.collect()) == [(0, 1, 2, 3, 4, 5, 6), (3, 1, 2, 3, 4, 5, 6)]


def test_a_large_group_makes_few_comparisons(spark):
    """800 texts alike make about two pairs a text, not one for each key or each other text."""
    from cuelattice.llm.common import staged

    base = [f"w{i}" for i in range(300)]
    texts = [" ".join([*base[:k], f"swapped{j}", *base[k + 1 :]]) for j in range(4) for k in range(200)]
    pairs, made = [], near_copies.verified

    def counted(found, members, similar):
        pairs.append(staged(found, "counted").count())
        return made(found, members, similar)

    near_copies.verified = counted
    try:
        assert [r.doc_id for r in near_copies.keep_first(docs(spark, texts)).collect()] == [0]
    finally:
        near_copies.verified = made
    assert sum(pairs) < 2 * len(texts)


def test_a_pair_of_several_keys_is_made_once():
    """Rows 1 and 2 share keys 3, 5 and 9, rows 1 and 4 only 9, in slices of their own."""
    bands = {1: [3, 5, 9], 2: [3, 5, 9], 4: [7, 8, 9]}
    bits = [0] * (near_copies.PLANES * near_copies.WORDS)
    row = lambda key, digest: {"key": key, "low": 0, "high": 0, "side": 0, "digest": digest, "label": digest, "n": 10, "fp": 0, "bits": bits, "bands": bands[digest]}
    batch = pa.RecordBatch.from_pylist([row(3, 1), row(3, 2), row(5, 1), row(5, 2), row(9, 1), row(9, 2), row(9, 4)])
    made = [tuple(r.values()) for b in near_copies.met(iter([batch]), near_copies.RADIUS, near_copies.FLIPPED, 0.8) for r in b.to_pylist()]
    assert sorted(made) == [(1, 2), (1, 4), (2, 4)]


def test_a_key_of_sets_that_are_nearly_links_makes_no_row_for_a_pair():
    """60 sets at 0.75 to each other and 30 at 0.9, which estimates can't tell apart: sets and joining links leave their key, not pairs."""
    rng = np.random.default_rng(3)
    fresh = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    common, closer = fresh(120), fresh(18)
    sets = [np.sort(np.concatenate([common, fresh(20)])) for _ in range(60)] + [np.sort(np.concatenate([common, closer, fresh(7)])) for _ in range(30)]
    rows = [
        {"key": 7, "low": 0, "high": 0, "side": 0, "digest": d, "label": d, "n": len(x), "fp": 0, "bits": [0] * (near_copies.PLANES * near_copies.WORDS), "bands": [7], "shingles": x.tobytes()}
        for d, x in enumerate(sets)
    ]
    whole = pa.RecordBatch.from_pylist(rows)
    limits = (near_copies.RADIUS, near_copies.FLIPPED, 0.8)
    batches = [whole.slice(0, 25), whole.slice(25)]
    assert sum(b.num_rows for b in near_copies.met(iter(batches), *limits)) > 3000
    kept = [r["digest"] for b in near_copies.involved(iter(batches), *limits) for r in b.to_pylist()]
    assert kept == list(range(90))
    found = [tuple(r.values()) for b in near_copies.linked(iter(batches), *limits) for r in b.to_pylist()]
    reached = {60}
    for _ in found:
        reached |= {x for pair in found if reached & set(pair) for x in pair}
    assert len(found) == 29 and reached == set(range(60, 90))


def test_simhash_links_sets_without_a_common_key(spark):
    """Fingerprints within three bits meet in SimHash's blocks, and exact similarity follows: the third text is near by fingerprint alone."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(f"z{i}" for i in range(400))]
    made = [near_copies.sketch(near_copies.shingles(t.encode())) for t in texts]
    fps = [near_copies.simhash.fingerprint(near_copies.shingles(t.encode())) for t in texts[:2]]
    assert bin(fps[0] ^ fps[1]).count("1") <= 3
    signed = lambda x: int(np.array([x], np.uint64).view(np.int64)[0])
    bits = [int(x) for x in made[0][2].view(np.int64)]
    rows = [(signed(m[0]), i, signed(fp), [i * 100 + k for k in range(near_copies.BANDS)], bits) for i, (m, fp) in enumerate(zip(made, [*fps, fps[0] ^ 1], strict=True))]
    distinct = spark.createDataFrame(rows, "digest long, row long, fp long, bands array<long>, bits array<long>")
    found = near_copies.links(distinct, spark.createDataFrame(list(enumerate(texts)), "row long, text string"), 0.8)
    assert {frozenset(r) for r in found.collect()} == {frozenset(r[0] for r in rows[:2])}
