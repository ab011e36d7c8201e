"""Texts that quote an added token get the ids of `tokenizers` in its default setting."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from wayfare.llm import registry
from wayfare.llm.encode import Encoder

END = "<|endoftext|>"
TEXTS = [f"a {END} b", END, f" {END}", f"{END} ", END * 3, f"x  {END}  y", f"a\n\n{END}\n b {END}c", "<|endoftext| >", "<|ENDOFTEXT|>", f"it's{END}'s", "no marker  here", ""]


def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids():
    e, want = Encoder(added=True), reference()
    assert len(want(TEXTS[0])) == 4
    for text in TEXTS:
        assert np.frombuffer(e.ids(text), np.uint32).tolist() == want(text), text


def test_queries_and_stage(spark, tmp_path):
    want = [reference()(t) for t in TEXTS]
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for out in (registry.QUERIES["op5_best_fit_packing"](spark, str(tmp_path)), P.pack_sequences(spark, docs, str(tmp_path))):
        got = {r.doc_id: (r.length, r.ids_crc32) for r in out.collect()}
        assert got == {i: (len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for i, x in enumerate(want)}
    lengths = [len(x) for x in want]
    assert {r.length: r.docs for r in registry.QUERIES["op6_token_counts"](spark, str(tmp_path)).collect()} == {n: lengths.count(n) for n in lengths}
