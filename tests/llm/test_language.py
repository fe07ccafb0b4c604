"""Codewords, n-grams, and held-out accuracy."""

import numpy as np
import pytest
from helpers import ODD, docs, odd_docs

from cuelattice.llm import language as lg
from cuelattice.llm.common import remainder, table

SF = "/root/testdata/sf0.01"


def test_codewords_differ():
    for k in (2, 3, 4, 5, 9, 30):
        code = lg.codewords(k)
        assert len({tuple(r) for r in code.tolist()}) == k and set(np.unique(code)) == {-1, 1}
        if k > 2:
            assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 2
        assert all(0 < (c == 1).sum() < k for c in code.T)


def test_grams_of_parts_are_those_of_the_whole(monkeypatch):
    text = "Héllo  wörld, 12 x ".encode() * 50
    whole = np.sort(np.concatenate(list(lg.grams(text))))
    monkeypatch.setattr(lg, "CHUNK", 64)
    assert (np.sort(np.concatenate(list(lg.grams(text)))) == whole).all()


def test_held_out_accuracy(spark):
    d = table(spark, SF, "documents")
    rows = lg.op4_language(spark, SF).join(d.select("doc_id", "lang"), "doc_id").toPandas()
    held = rows[rows.held_out & (rows.lang_pred != "und")]
    assert len(rows) == d.count() and (held.lang_pred == held.lang).mean() > 0.97
    assert rows.score.between(0, 1).all() and rows[~rows.held_out].doc_id.nunique() == d.where(remainder("doc_id", 4) != 2).count()


def test_letters():
    assert not any(lg.has_letter(x.encode()) for x in ("", " 12 _ ", "½", "²", "①", "٣", "Ⅷ", "😀", "—"))
    assert all(lg.has_letter(x.encode()) for x in ("a", "½é", "日", "ʰ", "ª"))


def test_query_against_every_step_by_hand(spark):
    """Margins, losses and choice of whole texts, with plain loops, under the model that is fitted."""
    d = table(spark, "/root/testdata/sf0.001", "documents")
    model = lg.fit(d.where(remainder("doc_id", 4) != 2))
    got = {r.doc_id: r for r in lg.op4_language(spark, "/root/testdata/sf0.001").collect()}
    for r in d.limit(40).collect():
        text = " ".join(("".join(chr(b + 32) if 65 <= b <= 90 else chr(b) if 97 <= b <= 122 or b >= 128 else " " for b in f" {r.text} ".encode())).split(" ")).encode("latin-1")
        seen = b"".join(bytes([c]) for i, c in enumerate(text) if i == 0 or c != 32 or text[i - 1] != 32)
        hashes = [(int.from_bytes(seen[i : i + n], "big") * int(lg.FACTORS[n - 2]) % 2**32) >> 16 for n in lg.SIZES for i in range(len(seen) - n + 1)]
        margins = [sum(float(model.weights[h, b]) for h in hashes) / len(hashes) for b in range(model.code.shape[1])]
        loss = [sum(t * np.log1p(np.exp(-c * (m * s + f))) for t, c, m, s, f in zip(model.trust, code, margins, model.slope, model.shift, strict=True)) for code in model.code]
        share = 1 / sum(np.exp(min(loss) - x) for x in loss)
        assert got[r.doc_id].lang_pred == model.languages[int(np.argmin(loss))] and abs(got[r.doc_id].score - share) < 1e-3


def test_ties_long_texts_and_clashes(spark):
    code = lg.codewords(2)
    tie = lg.Model(["a", "b"], code, np.zeros((1 << lg.BITS, 1), np.float32), np.ones(1), np.zeros(1), np.ones(1))
    rows = spark.createDataFrame([("text", 1), ("é" * 2_000_000, 2)], "text string, Language int")
    got = lg.identify(rows, tie).collect()
    assert [(r._language.lang_pred, r._language.score, r._language.ambiguous) for r in got] == [("a", 0.5, True)] * 2


def test_too_many_languages(spark):
    rows = spark.createDataFrame([(i, "text", f"l{i}", "s", 4) for i in range(8)], "doc_id long, text string, lang string, source string, n_chars long")
    with pytest.raises(ValueError, match="languages"):
        lg.fit(rows, most_languages=7)


def test_odd_rows(spark):
    model = lg.fit(table(spark, SF, "documents"), per_language=50)
    got = {(r.doc_id, r.text): r.language for r in lg.identify(odd_docs(spark), model).collect()}
    assert all(got[i, t].lang_pred == "und" and got[i, t].ambiguous for i, t in enumerate(ODD[:3]))
    assert got[6, ODD[6]].lang_pred in model.languages
    none = lg.fit(docs(spark, []))
    assert {r.language.lang_pred for r in lg.identify(docs(spark, ["some text"]), none).collect()} == {"und"}
    one = lg.fit(docs(spark, ["some text", "more text"]))
    assert {r.language.lang_pred for r in lg.identify(docs(spark, ["other text"]), one).collect()} == {"en"}
    given = odd_docs(spark).withColumn("language", lg.F.lit("x"))
    kept = lg.keep_identified(given)
    assert kept.columns == given.columns and {r.text for r in kept.collect()} <= {*ODD, "no id here at all"} - {None, "", " \n "}
    assert lg.keep_identified(given.limit(0)).count() == 0
