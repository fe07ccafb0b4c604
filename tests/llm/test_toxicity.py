"""The kernel against its definition, and what a fitted model makes of altered insults."""

from itertools import combinations

import numpy as np
from helpers import odd_docs

from cuelattice.llm import toxicity as tx
from cuelattice.llm.common import table


def brute(a, b):
    total = 0.0
    for i in combinations(range(len(a)), tx.ORDER):
        for j in combinations(range(len(b)), tx.ORDER):
            if all(a[x] == b[y] for x, y in zip(i, j, strict=True)):
                total += tx.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel():
    words, marks = ["stupid", "stxupid", "abcd", "abc", "st"], ["stupid", "abcde"]
    want = [[brute(w, m) / np.sqrt((brute(w, w) or 1) * brute(m, m)) for m in marks] for w in words]
    assert np.allclose(tx.kernel(words, marks), want, atol=1e-5)


def test_weighted_kernels_are_the_machine_of_the_kernels():
    rng = np.random.default_rng(0)
    marks = [tx.windows(w)[0] for w in ("stupid", "moron", "achlich", "réeux")]
    model = tx.Model(marks, rng.normal(size=4), 0.3)
    words = [tx.windows("".join(rng.choice(list("stupidmornacléx"), rng.integers(1, 12))))[0] for _ in range(300)] + ["zzzz", "abc"]
    assert np.allclose(tx.weighted_kernels(words, *model.triples()) + 0.3, tx.kernel(words, marks) @ model.weights + 0.3, atol=1e-4)


def test_words():
    assert {"idiot", "you"} <= {tx.bare(w) for w in tx.raw_words("You, i d i o t!")}
    assert tx.bare("i.d-1ot!") == "idiot" and tx.bare("1234") == "" and tx.bare("###") == ""
    assert all(len(w) <= tx.LONGEST for w in tx.windows("x" * 1000))


def corpus(spark):
    rng = np.random.default_rng(2)
    syllables = ["ba", "to", "mi", "ren", "sol", "ker", "lun", "da"]
    word = lambda: "".join(rng.choice(syllables, 3))
    docs, labels = [], []
    for i in range(300):
        text = [word() for _ in range(30)]
        if i % 5 == 0:
            text[3] = text[11] = rng.choice(["stupid", "moron", "worthless"])
        docs.append((i, " ".join(text[:15]) + ". " + " ".join(text[15:]), "en", "s", 0))
        labels.append((i, 1, int(i % 5 == 0)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_fit_and_score(spark):
    docs, labels = corpus(spark)
    model = tx.fit(docs, labels, per_class=500)
    got = {r.doc_id: r.score for r in tx.score(docs, model).collect()}
    assert all((got[i] >= 0.3) == (i % 5 == 0) for i in got)
    altered = spark.createDataFrame([(0, "you stupiid, worth-less bato"), (1, "mo ron m o r o n, s t u p i d"), (2, "batomi renlun kerda")], "doc_id long, text string")
    s = {r.doc_id: r.score for r in tx.score(altered, model).collect()}
    assert s[0] > 0.3 and s[1] > 0.3 and s[2] < 0.3
    odd = tx.score(odd_docs(spark), model).collect()
    assert all(0 <= r._score <= 1 for r in odd) and odd[0].Score == 1.5
    texts = [r.text for r in docs.limit(40).collect()] + [None, "", "a", "stupid" * 30, "x" * 200_000 + " moron", "tie tie. Tie!", "w o r t h l e s s"]
    some = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.score for r in tx.score(some, model).orderBy("doc_id").collect()]
    assert np.allclose(got, [brute_score(model, t or "") for t in texts], atol=1e-3) and got[-3] > 0.3


def brute_score(model, text):
    """The score by all kernels of all windows of a text's words."""
    worst = {}
    for w in tx.raw_words(text):
        for p in tx.windows(tx.bare(w)) if tx.bare(w) else []:
            if len(p) >= tx.ORDER:
                worst[w] = max(worst.get(w, -tx.RANGE), float(tx.kernel([p], model.marks)[0] @ model.weights + model.bias))
    two = (sorted((min(m, tx.RANGE) for m in worst.values()), reverse=True) + [-tx.RANGE] * 2)[:2]
    return float(model.probability(np.array([two]))[0])


def test_training_reads_whole_words_and_every_marking_word(spark):
    """An insult that only the end of a long word tells apart, and more marking words than landmarks."""
    start = "abcdefghij" * 3
    rows = [(i, f"{start}{'xqzvw' if i % 2 else 'kolum'} {chr(97 + i % 26) * 3}{chr(97 + i // 26) * 3} {'grum' + chr(97 + i % 5) * 3 if i % 2 else 'sola'}", i % 2) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = tx.fit(docs, labels, count=8)
    assert any("xqzvw" in m for m in model.marks) and len(model.marks) <= 8
    new = spark.createDataFrame([(0, f"{start}xqzvw"), (1, f"{start}kolum")], "doc_id long, text string")
    bad, good = (r.score for r in tx.score(new, model).orderBy("doc_id").collect())
    assert bad > 0.3 > good


def test_equal_margins(spark):
    model = tx.Model(["\x02aaa\x02"], np.ones(1), -0.5)
    found = model.worst([["xbcax", "xcbax"], ["xcbax", "xbcax"], ["a"]])
    assert found[0] == found[1] and found[0][1] == "xbcax" and found[2] == (-np.inf, "")


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r.predicted for r in tx.op8_toxicity(spark, sf).where("held_out").collect()}
    held = [(r.toxic, got[r.doc_id]) for r in table(spark, sf, "labels").collect() if r.doc_id in got]
    assert np.mean([p for y, p in held if y]) >= 0.85 and np.mean([p for y, p in held if not y]) <= 0.05


def test_without_labels(spark):
    docs, labels = corpus(spark)
    for some in (labels.where("toxic = 0"), labels.limit(0)):
        assert tx.score(docs, tx.fit(docs, some)).where("score > 0.3").count() == 0
    assert tx.score(docs.limit(0), tx.fit(docs.limit(0), labels)).count() == 0
