"""Encoded ids against the library's own, whole text by whole text."""

import shutil
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from helpers import ODD, docs, odd_docs

from cuelattice.llm import packing, token_store
from cuelattice.llm.common import table
from cuelattice.llm.encoding import Encoder

SF = "/root/testdata/sf0.001"
LOWER, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def reference(path, texts):
    enc = Encoder(path)
    return [np.array([*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in texts]


def test_pieces_give_the_ids_of_the_whole_text():
    rng = np.random.default_rng(3)
    alphabet = list("ab É'sßΣσ.,!\n\t  1２é\x1c\x85日") + ["<|endoftext|>", "'ll", "  ", "́"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(1500)]
    for path in (LOWER, BYTES):
        got = Encoder(path).encode(texts)
        for t, g, want in zip(texts, got, reference(path, texts), strict=True):
            assert np.frombuffer(g, "<u2").tolist() == want[:-1].tolist(), repr(t)


def test_added_tokens_have_their_own_ids():
    from tokenizers import Tokenizer

    texts = ["one <|endoftext|> two", "<|endoftext|>", "a<|startoftext|>B  c\n<|endoftext|>", "<|endoftext|" + ">" * 3 + " É日本", "<|ENDOFTEXT|>", "plain words", ""]
    for path in (LOWER, BYTES):
        library = Tokenizer.from_file(path)
        got = [np.frombuffer(x, "<u2").tolist() for x in Encoder(path).encode(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0] == [505, 220, 50256, 734]


def test_store_round_trip(spark, tmp_path):
    df = table(spark, SF, "documents").limit(60).unionByName(odd_docs(spark).drop("Score", "held_out"))
    path = token_store.write_store(df, str(tmp_path / "store"), LOWER)
    src = sorted([(r.doc_id if r.doc_id is not None else -1, reference(LOWER, [r.text])[0].tolist()) for r in df.collect()])
    back = token_store.read_ids(spark, path, 2).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids) for r in back) == src
    sums = token_store.read_checksums(spark, path, 2).orderBy("start").collect()
    assert [r.start for r in sums] == np.concatenate([[0], np.cumsum([r.n_tokens for r in sums])[:-1]]).tolist()
    assert [r.doc_id if r.doc_id is not None else -1 for r in sums] == [d for d, _ in src]
    want = {(d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in src}
    assert {(r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in sums} == want
    chunks = token_store.read_objects(spark, path, "chunk")
    assert chunks.count() == chunks.select("digest").distinct().count()


def files(path, part):
    return sorted(p for p in (Path(path) / part).rglob("*.parquet"))


def rewritten(file, change):
    """The file with its rows changed, and without its checksum file."""
    rows = pq.ParquetFile(file).read()
    pq.write_table(pa.Table.from_pylist(change(rows.to_pylist()), rows.schema), file)
    file.with_name(f".{file.name}.crc").unlink(missing_ok=True)


def cut_first(key):
    return lambda rows: [r | {key: r[key][::-1]} if i == 0 else r for i, r in enumerate(rows)]


DAMAGE = {
    "a chunk's ids": ("objects/kind=chunk", lambda f: rewritten(f, cut_first("ids"))),
    "a chunk is gone": ("objects/kind=chunk", lambda f: rewritten(f, lambda rows: rows[1:])),
    "a recipe's digests": ("recipes", lambda f: rewritten(f, cut_first("digests"))),
    "a recipe's root": ("recipes", lambda f: rewritten(f, cut_first("root"))),
    "a recipe's id": ("recipes", lambda f: rewritten(f, lambda rows: [r | {"doc_id": 77} if i == 0 else r for i, r in enumerate(rows)])),
    "a recipe is gone": ("recipes", lambda f: rewritten(f, lambda rows: rows[1:])),
    "a recipe is there twice": ("recipes", lambda f: rewritten(f, lambda rows: rows + rows[:1])),
    "a file of recipes is gone": ("recipes", lambda f: f.unlink()),
    "the manifest's root": ("manifest", lambda f: rewritten(f, cut_first("root"))),
    "the manifest's counts": ("manifest", lambda f: rewritten(f, lambda rows: [r | {"n_tokens": r["n_tokens"] + 1} for r in rows])),
    "a range of the manifest is gone": ("manifest", lambda f: rewritten(f, lambda rows: rows[1:])),
}


def test_damage_is_found(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "FAN", 3)
    assert token_store.merkle([b"a", b"b", b"c"]) != token_store.merkle([b"a", b"c", b"b"])
    rng = np.random.default_rng(2)
    texts = [" ".join(map(str, rng.integers(0, 900, 300))) for _ in range(40)]
    path = token_store.write_store(docs(spark, texts), str(tmp_path / "store"), LOWER)
    assert token_store.read_checksums(spark, path, 2).count() == 40
    for what, (part, damage) in DAMAGE.items():
        own = str(tmp_path / what.replace(" ", "-").replace("'", ""))
        shutil.copytree(path, own)
        damage(files(own, part)[0])
        for read in (token_store.read_checksums, token_store.read_ids):
            with pytest.raises(Exception, match="damaged|manifest|lacks chunks"):
                print(what, len(read(spark, own, 2).collect()))


def test_many_buckets_and_ranges_give_the_same(spark, tmp_path, monkeypatch):
    df = table(spark, SF, "documents").limit(50)
    got = [token_store.read_checksums(spark, token_store.write_store(df, str(tmp_path / "one"), LOWER), 2).orderBy("start").collect()]
    monkeypatch.setattr(token_store, "BUCKET", 1 << 10)
    monkeypatch.setattr(token_store, "RANGE", 1 << 14)
    got.append(token_store.read_checksums(spark, token_store.write_store(df, str(tmp_path / "many"), LOWER), 2).orderBy("start").collect())
    assert got[0] == got[1]


def test_very_long_texts(spark, tmp_path):
    rng = np.random.default_rng(5)
    texts = ["x" * 300_000, " ".join(map(str, rng.integers(0, 99999, 400_000))), "É日本ſ " * 50_000]
    df = docs(spark, texts)
    path = token_store.write_store(df, str(tmp_path / "store"), LOWER)
    want = {i: x for i, x in enumerate(reference(LOWER, texts))}
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.read_checksums(spark, path, 2).collect()} == {(i, len(x), zlib.crc32(x.tobytes())) for i, x in want.items()}
    want = {i: x for i, x in enumerate(reference(BYTES, texts))}
    rows = packing.digest_columns(packing.pack(df, BYTES)).collect()
    assert {(r.doc_id, r.start, r.ids_crc32) for r in rows} == {(r.doc_id, r.start, zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())) for r in rows}
    assert sum(r.length for r in rows) == sum(map(len, want.values()))


def test_empty_store(spark, tmp_path):
    path = token_store.write_store(docs(spark, []), str(tmp_path / "store"), LOWER)
    assert token_store.read_checksums(spark, path, 2).count() == 0


def test_chunks_survive_a_shift():
    rng = np.random.default_rng(1)
    body = rng.integers(0, 40000, 5000).astype("<u2")
    shifted = np.concatenate([rng.integers(0, 40000, 7).astype("<u2"), body])
    cuts = lambda x: {x[a:b].tobytes() for a, b in zip([0, *token_store.boundaries(x)], token_store.boundaries(x), strict=False)}
    assert len(cuts(body) & cuts(shifted)) > 0.8 * len(cuts(body))


def test_packing(spark, tmp_path):
    df = odd_docs(spark)
    rows = packing.pack(df, BYTES).collect()
    assert all(r.length == 1 << (r.length.bit_length() - 1) and r.length <= 2048 and r.offset == 0 for r in rows)
    assert len({r.sequence_id for r in rows}) == len(rows)
    whole = {}
    for r in sorted(rows, key=lambda r: r.start):
        if r.doc_id != 3:
            whole.setdefault(r.doc_id, []).append(np.frombuffer(r.ids, "<u4"))
    for i, t in enumerate(ODD):
        if i != 3:
            assert np.concatenate(whole[i]).tolist() == reference(BYTES, [t])[0].tolist()
    digests = packing.digest_columns(packing.pack(df, BYTES)).collect()
    written = packing.bucketed(packing.pack(df, BYTES), str(tmp_path / "packed"))
    assert sorted(map(tuple, written.collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    folders = {int(p.name.split("=")[1]) for p in (tmp_path / "packed").glob("length=*")}
    assert folders == {r.length for r in rows}
    for n in folders:
        assert {r.length for r in written.where(f"length = {n}").collect()} == {n}
    assert {(r.doc_id, r.start, r.ids_crc32) for r in digests} == {(r.doc_id, r.start, zlib.crc32(r.ids)) for r in rows}
    assert packing.pack(docs(spark, []), BYTES).count() == 0


def test_lengths():
    assert packing.lengths(5000, 2048) == [2048, 2048, 512, 256, 128, 8]
    assert packing.lengths(1, 2048) == [1]
