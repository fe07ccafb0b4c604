"""Each stage of the pipeline against its operator's own query or brute force, on all that it is given."""

import zlib

import numpy as np
import public_tokenizers
from helpers import docs, odd_docs
from test_near_copies import brute_kept
from test_simhash import brute_components, brute_print

import corpus_pipeline
from cuelattice.llm import decontamination, language, packing, simhash, toxicity
from cuelattice.llm.common import shared_dir, table
from cuelattice.llm.encoding import Encoder

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark):
    shared_dir(spark)
    given = table(spark, SF, "documents")
    toxic = corpus_pipeline.drop_toxic(spark, given, SF).checkpoint()
    assert toxic.columns == given.columns
    assert ids(toxic) == ids(toxicity.op8_toxicity(spark, SF).where("predicted = 0"))
    told = corpus_pipeline.drop_unidentified(spark, toxic, SF).checkpoint()
    own = {r.doc_id for r in language.identify(toxic, language.fit(toxic.where("crc32(cast(doc_id as string)) % 4 <> 2"))).where("language.ambiguous").collect()}
    assert ids(told) == sorted(set(ids(toxic)) - own)
    once = corpus_pipeline.drop_near_duplicates(spark, told, SF).checkpoint()
    assert ids(once) == brute_kept([(r.doc_id, r.text) for r in told.orderBy("doc_id").collect()]) and once.columns == given.columns
    clean = corpus_pipeline.drop_contaminated(spark, once, SF).checkpoint()
    hit = {r.doc_id for r in decontamination.op2_decontamination(spark, SF).collect()}
    assert ids(clean) == sorted(set(ids(once)) - hit)
    enc = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for r in clean.collect():
        x, at = np.array([*enc.tokenizer.encode(r.text, add_special_tokens=False).ids, 1], "<u4"), 0
        for k in packing.lengths(len(x), 2048):
            want.add((r.doc_id, at, k, zlib.crc32(x[at : at + k].tobytes())))
            at += k
    packed = corpus_pipeline.pack_sequences(spark, clean, SF).collect()
    assert {(r.doc_id, r.start, r.length, r.ids_crc32) for r in packed} == want and len(packed) == len(want)
    whole = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.start, r.length, r.ids_crc32) for r in whole} == want


def test_first_rows_stay(spark):
    df = odd_docs(spark)
    got = simhash.keep_first(df).collect()
    rows = df.collect()
    prints = [brute_print(r.text) for r in rows]
    comp = brute_components(prints, list(range(len(rows))), 3)
    assert len(got) == len(set(comp)) and simhash.keep_first(df).columns == df.columns
    assert len({brute_print(r.text) for r in got}) == len(got)
    assert simhash.keep_first(docs(spark, [])).count() == 0


def test_sequences_are_read_from_their_buckets(spark):
    packed = corpus_pipeline.pack_sequences(spark, docs(spark, ["a few words", None, "other words " * 3000]), SF)
    assert sum(r.length for r in packed.collect()) == sum(r.doc_tokens for r in packed.where("start = 0").collect())
    assert all("/length=" in f for f in packed.inputFiles()) and packed.inputFiles()
