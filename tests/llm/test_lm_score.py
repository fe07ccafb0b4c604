"""Scores against a plain model of the same definition."""

import math
import zlib
from collections import Counter

import pytest
from helpers import docs, odd_docs

from cuelattice.llm import lm_score as lm
from cuelattice.llm.common import table

SF = "/root/testdata/sf0.001"


def plain(rows):
    end = b"\n"
    toks = [(i, (t or "").encode().lower().split() + [end]) for i, t in rows]
    role = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    for i, t in toks:
        if role(i) != 2:
            k = int(role(i) == 5)
            uni[k].update(t)
            bi[k].update(zip([end, *t], t, strict=False))
    n0, v0 = sum(uni[0].values()), len(uni[0])
    b = lambda c: math.ceil(math.log2(c + 1))
    events = [(b(uni[0][h]), bi[0][h, w] / max(1, uni[0][h]), uni[0][w] / max(1, n0), n) for (h, w), n in bi[1].items()]
    lam = {e[0]: (0.4, 0.4, 0.2) if e[0] else (0.0, 0.8, 0.2) for e in events}
    for _ in range(30 if events else 0):
        acc = {k: [0.0, 0.0, 0.0] for k in lam}
        for k, p2, p1, n in events:
            t = (lam[k][0] * p2, lam[k][1] * p1, lam[k][2] / (v0 + 1))
            for j in range(3):
                acc[k][j] += n * t[j] / sum(t)
        new = {k: tuple(x / sum(a) for x in a) for k, a in acc.items()}
        moved = max(abs(x - y) for k in new for x, y in zip(new[k], lam[k], strict=True))
        lam = new
        if moved < 1e-4:
            break
    u, p = uni[0] + uni[1], bi[0] + bi[1]
    n, v = sum(u.values()), len(u)
    near = lambda c: lam[min(sorted(lam), key=lambda k: abs(k - c))] if lam else (0.6, 0.3, 0.1)
    out = []
    for i, t in toks:
        s = base = 0.0
        for h, w in zip([end, *t], t, strict=False):
            k = b(u[h])
            l2, l1, l0 = near(k)
            if k == 0:
                l2, l1 = 0, l1 + l2
            s += math.log10(l2 * p[h, w] / max(1, u[h]) + l1 * u[w] / max(1, n) + l0 / (v + 1))
            base += math.log10((u[w] + 1) / (n + v + 1))
        out.append((i if i is not None else -1, role(i) == 2, len(t), sum(u[w] > 0 for w in t), n, round(base, 6), round(s, 6)))
    return sorted(out)


def got(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("size", [1 << 20, 500])
def test_scores(spark, size, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", size)
    monkeypatch.setattr(lm, "BUCKET", size)
    df = table(spark, SF, "documents").select("doc_id", "text").unionByName(odd_docs(spark).select("doc_id", "text"))
    want = plain([tuple(r) for r in df.collect()])
    for a, b in zip(got(lm.score(df)), want, strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-4 and abs(a[6] - b[6]) < 1e-4


def rows_asked(spark, n, monkeypatch):
    """Rows that the blocks of ``n`` documents send, and blocks times buckets."""
    seen = {}
    monkeypatch.setattr(lm, "asks", lambda cut, tokens, grown: seen.setdefault("asks", asks_of(cut, tokens, grown)))
    words = spark.range(n).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 40), i -> concat('w', xxhash64(id, i) % 5000))) AS text")
    lm.score(words).count()
    return seen["asks"].count()


asks_of = lm.asks


def test_rows_asked_grow_with_the_tokens(spark, monkeypatch):
    for name, x in (("BLOCK", 256), ("BUCKET", 256), ("KEYS", 8)):
        monkeypatch.setattr(lm, name, x)
    few, many = (rows_asked(spark, n, monkeypatch) for n in (1000, 4000))
    assert 2 * few < many < 6 * few and many < 4000 * 41 * 4 / 8


def test_a_very_long_text(spark):
    texts = ["long " * 300_000 + "end", "x" * 2_000_000, "a b", "long end"]
    df = docs(spark, texts)
    for a, b in zip(got(lm.score(df)), plain(list(enumerate(texts))), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-3 * abs(b[5]) and abs(a[6] - b[6]) < 1e-3 * abs(b[6])


def test_the_mixture_beats_the_base(spark):
    rows = [r for r in lm.op3_lm_score(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_few_rows(spark):
    assert lm.score(docs(spark, [])).count() == 0
    assert len(got(lm.score(docs(spark, ["a b", "b c"])))) == 2
    a = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    held = spark.createDataFrame([(i, "x y") for i in a], "doc_id long, text string")
    assert got(lm.score(held)) == plain([(i, "x y") for i in a])
