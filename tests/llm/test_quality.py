"""Statistics, the discriminant against its formula, and held-out accuracy."""

import zlib

import numpy as np
from helpers import ODD, docs, odd_docs

from cuelattice.llm import quality as q
from cuelattice.llm.common import table

SF = "/root/testdata/sf0.01"


def test_statistics():
    for t in ODD:
        x = q.statistics((t or "").encode())
        assert len(x) == len(q.NAMES) and np.isfinite(x).all()
    assert q.statistics(b"") == q.statistics(b" \n ")[:10] + q.statistics(b"")[10:]


def test_margin_is_the_density_difference():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(3, 3)), rng.normal(size=(3, 3))
    covs, means = [a @ a.T + np.eye(3), b @ b.T + np.eye(3)], [np.zeros(3), np.ones(3)]
    factors = [np.linalg.cholesky(c) for c in covs]
    model = q.Model(0.5, means, factors, [-np.log(np.diag(f)).sum() + np.log(0.5) for f in factors])
    x = rng.normal(size=(20, 3))
    dens = [-0.5 * np.log(np.linalg.det(c)) - 0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) for c, m in zip(covs, means, strict=True)]
    assert np.allclose(model.margin(x), dens[1] - dens[0])


def test_query_against_plain_formulas(spark):
    """The registered query's scores from statistics, moments and inverses that are computed here at once."""
    d, labels = table(spark, SF, "documents").toPandas(), table(spark, SF, "labels").toPandas()
    x = np.array([q.statistics(t.encode()) for t in d.text])
    own = labels[[zlib.crc32(str(i).encode()) % 4 != 2 for i in labels.doc_id]]
    at = {i: k for k, i in enumerate(d.doc_id)}
    rows, y = x[[at[i] for i in own.doc_id]], own.quality.to_numpy()
    scatter = [(rows[y == c] - rows[y == c].mean(axis=0)).T @ (rows[y == c] - rows[y == c].mean(axis=0)) for c in (0, 1)]
    pooled, density = sum(scatter) / len(rows), []
    for c in (0, 1):
        n, mean = (y == c).sum(), rows[y == c].mean(axis=0)
        w = 0.9 * n / (n + len(q.NAMES) + 1)
        cov = 0.98 * (w * scatter[c] / n + (1 - w) * pooled) + 0.02 * np.diag(np.diag(pooled) + 1e-6)
        far = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        density.append(np.log(n / len(rows)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * far)
    margin = q.squeezed(density[1] - density[0])
    score = {r.doc_id: r.score for r in q.op6_quality(spark, SF).collect()}
    logit = np.array([np.log(score[i] / (1 - score[i])) for i in d.doc_id])
    inner = np.abs(logit) < 15
    slope, shift = np.polyfit(margin[inner], logit[inner], 1)
    assert slope > 0 and np.allclose(logit[inner], slope * margin[inner] + shift, atol=1e-4)


def test_clashes_and_long_texts(spark):
    df = spark.createDataFrame([(1, "x" * 3_000_000, 0.5), (2, "word\n" * 500_000, 0.5)], "doc_id long, text string, SCORE double")
    vectors = q.with_statistics(df, "text", "x")
    got = q.scored(vectors, q.Model(0.25)).collect()
    assert all(r._score == 0.25 and r.SCORE == 0.5 and np.isfinite(r.x).all() for r in got)


def test_held_out_accuracy(spark):
    rows = q.op6_quality(spark, SF)
    assert rows.count() == table(spark, SF, "documents").count()
    held = rows.join(table(spark, SF, "labels"), "doc_id").where("held_out").toPandas()
    assert (held.predicted == held.quality).mean() > 0.93 and held.score.between(0, 1).all()


def test_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] + [(None, 1), (3, None)], "doc_id long, quality int")
    vectors = q.with_statistics(odd_docs(spark), "text", "x")
    got = q.scored(vectors, q.fit(vectors, labels), to="quality").collect()
    assert len(got) == len(ODD) + 2 and all(0 <= r.quality <= 1 for r in got) and got[0].Score == 1.5
    assert {r.quality for r in q.scored(vectors, q.fit(vectors, labels.limit(0)), to="quality").collect()} == {0.5}
    empty = q.with_statistics(docs(spark, []), "text", "x")
    assert q.scored(empty, q.fit(empty, labels)).count() == 0
