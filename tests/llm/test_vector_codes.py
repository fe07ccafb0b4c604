"""Vector codes against their SQL, against search of all entries, and on odd rows."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelattice.llm import vector_codes
from cuelattice.llm.vector_codes import Codebooks, encode
from tests.oracle import same

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_matches_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        assert same(spark, vector_codes.op12_vector_codes, vector_codes.ORACLES["op12_vector_codes"], f"/root/testdata/{sf}") == 500


def brute(entries, x):
    """Nearest entry of each row by all distances, ties to the lower index."""
    d = ((x[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@given(st.integers(0, 10**6), st.integers(1, 64), st.integers(1, 5), st.sampled_from([1, 3, 400, 10**7]))
@settings(max_examples=150, deadline=None)
def test_search_gives_the_nearest_whatever_the_start(seed, n, width, spread):
    rng = np.random.default_rng(seed)
    books = Codebooks(rng.integers(-spread, spread + 1, (2, n, width)))  # small spreads make ties and equal entries
    x, previous = rng.integers(-spread, spread + 1, (200, width)), rng.integers(0, n, 200)
    index, d = books.nearest(1, x, previous)
    wanted, least = brute(books.entries[1], x)
    assert (index == wanted).all() and (d == least).all()


def test_the_scan_is_bounded_by_the_radius():
    """From the nearest entry of well separated ones, hardly any other entry is looked at."""
    entries = np.stack([np.arange(64) * 1000, np.zeros(64, int)], axis=1)[None]
    books = Codebooks(entries)
    books.order[0, :, 2:] = -10**6  # an index that fails if it is looked up
    x = entries[0][np.arange(64).repeat(5)] + np.random.default_rng(1).integers(-20, 21, (320, 2))
    index, _ = books.nearest(0, x, np.arange(64).repeat(5))
    assert (index == np.arange(64).repeat(5)).all()


def plain(rows, parts=16, entries=64, rounds=2, scale=256):
    """(id, label, code, error) of the rows in order of id and vector, and the digest, by loops over all entries."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], None
    w = len(kept[0][1]) // parts
    x = np.array([r[1] for r in kept], np.int64).reshape(len(kept), parts, w)
    books = [x[:entries, p].copy() for p in range(parts)]
    for step in range(rounds + 1):
        found = [brute(books[p], x[:, p]) for p in range(parts)]
        if step < rounds:
            for p in range(parts):
                for e in set(found[p][0].tolist()):
                    mine = x[found[p][0] == e, p]
                    books[p][e] = [int(t) // len(mine) for t in mine.sum(axis=0)]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b.tolist() for v in e).encode()).hexdigest()
    return [(r[0], r[2], bytes(int(found[p][0][i]) for p in range(parts)), int(sum(found[p][1][i] for p in range(parts)))) for i, r in enumerate(kept)], digest


def held(spark, rows, **how):
    coded, books = encode(spark.createDataFrame(rows, SCHEMA), keep=("vec_id", "label"), **how)
    wanted, digest = plain(rows, **how)
    got = sorted((tuple(r) for r in coded.select("vec_id", "label", "code", "error").collect()), key=repr)
    assert [(a, b, bytes(c), d) for a, b, c, d in got] == sorted(wanted, key=repr)
    assert (books.sha256() if books else None) == digest
    return got


def test_null_and_non_finite_vectors_ties_and_repeats(spark):
    rng = np.random.default_rng(3)
    v = lambda: rng.normal(0, 0.3, 32).astype(np.float32).tolist()
    rows = [(i, v(), i % 3 if i % 5 else None) for i in range(150)]
    rows += [(200, None, 1), (-1, [None] + [0.1] * 31, 1), (-2, [float("nan")] * 32, 1), (-3, [float("inf")] + [0.0] * 31, None), (-4, [float("-inf")] * 32, 2)]
    rows += [(None, v(), 1), (None, v(), None), (7, v(), 1), (7, rows[7][1], 1)] + [(300 + i, rows[0][1], 0) for i in range(40)]
    assert len(held(spark, rows)) == 194
    held(spark, rows, parts=4, entries=5, rounds=3, scale=8)


def test_fewer_rows_than_entries_and_unused_entries(spark):
    assert len(held(spark, [(i, [0.5] * 16, 1) for i in range(3)])) == 3
    held(spark, [(i, [float(i // 20)] * 16, 1) for i in range(60)])
    assert held(spark, []) == [] and held(spark, [(1, None, 2)]) == []


def test_vectors_that_cannot_be_coded_are_named(spark):
    with pytest.raises(ValueError, match="same number"):
        encode(spark.createDataFrame([(1, [0.0] * 16, 1), (2, [0.0] * 32, 1)], SCHEMA))
    with pytest.raises(ValueError, match="multiple of 16"):
        encode(spark.createDataFrame([(1, [0.0] * 15, 1)], SCHEMA))
    with pytest.raises(ValueError, match="too large"):
        encode(spark.createDataFrame([(1, [1e15] * 16, 1)], SCHEMA))


def test_clashing_names_and_label_sums(spark):
    df = spark.createDataFrame([(i, [i / 100] * 16, "x", 5, None if i % 4 == 0 else i % 4) for i in range(90)], "vec_id long, embedding array<float>, code string, error int, label int")
    coded, _ = encode(df, keep=("vec_id", "code", "error", "label", "embedding"))
    assert coded.columns == ["vec_id", "code", "error", "label", "embedding", "_code", "_error"]
    got = vector_codes.summed_over(coded, "label", "_error", "total").collect()
    for r in got:
        assert (r.code, r.error) == ("x", 5) and r.total == sum(o._error for o in got if o.label == r.label)
