"""Fingerprints and components against brute force."""

import numpy as np
import pytest
import xxhash
from helpers import ODD, docs, odd_docs

from cuelattice.llm import simhash
from cuelattice.llm.common import table

SF = "/root/testdata/sf0.001"


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys((32, *range(9, 14)), " ")).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids, radius):
    comp = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= radius and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    least = {c: min((ids[i] for i in range(len(fps)) if comp[i] == c and ids[i] is not None), default=None) for c in comp}
    return [least[c] for c in comp]


def check(spark, df, radius=3):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    fps = [brute_print(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], fps, brute_components(fps, [i for i, _ in rows], radius), strict=True), key=repr)
    got = sorted([(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df, radius).collect()], key=repr)
    assert got == want


def test_documents(spark):
    check(spark, table(spark, SF, "documents").select("doc_id", "text"))


def test_odd_rows_and_empty_table(spark):
    check(spark, odd_docs(spark))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.fingerprints(docs(spark, ODD)).count() == len(ODD)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 7])
def test_bit_slices_count_exactly(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    for i in range(75, 150):
        fps[i] = fps[i - 75] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 10), replace=False)))
    got = np.unpackbits(simhash.within(fps, fps, radius).view(np.uint8), axis=1, bitorder="little")[:, :150]
    want = np.array([[bin(int(a) ^ int(b)).count("1") <= radius for b in fps] for a in fps])
    assert (got == want).all()


def test_large_keys_are_dealt_out_whole(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 8)
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    fps = list({base ^ sum(1 << int(b) for b in rng.choice(40, 4, replace=False)) for _ in range(60)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    from cuelattice.llm.components import components

    got = {r.node: r.component for r in components(simhash.link_edges(df)).collect()}
    want = brute_components(fps, fps, 3)
    assert [got.get(f, f) for f in fps] == [min(g for g, w2 in zip(fps, want, strict=True) if w2 == w) for w in want]


def test_components_of_a_long_chain(spark):
    from cuelattice.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
