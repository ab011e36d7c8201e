import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wayfare.llm.encode import Encoder
from wayfare.llm.packing import pack, plan
from wayfare.llm.token_counts import at_limits, length_histogram, quantiles, suffix_table

SCHEMA = "doc_id long, text string, piece int"
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a\nb", "a\n\nb", "a \n b", "a \n  b", "a\n \nb", "\n", "\n\n", "a\n ", "a \n", "a  b", "a  b", "a  b c", "x\x00 y", "tab\tand\r\nmore",
    "it's we'll I'M 's", "日本語 テスト 123 ４５", "😀 é è ñ", "<|endoftext|> x", "  lead and trail  ", "a\x1cb \x1fc", "　x y", "a.b,c;d 12.5% #tag", "ab " * 3000,
]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_equal_those_of_tokenizers(spark, reference):
    e = Encoder()
    rng = np.random.default_rng(3)
    alphabet = np.array([" ", "\n", "a", "B", "'s", "1", ".", " ", "\t", "é"])
    texts = ODD + ["".join(rng.choice(alphabet, 30)) for _ in range(3000)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in texts:
        assert np.frombuffer(e.ids(text), np.uint32).tolist() == reference(text), repr(text[:80])


def test_plan_holds_every_piece_and_is_tight():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 1025, 5000), rng.integers(300, 400, 999), [1024] * 5, [512] * 7, [1] * 3000, [342, 342, 341], []):
        counts = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)], strict=True)) if len(lengths) else {}
        held = defaultdict(int)
        bins = 0
        for n, runs in plan(counts):
            assert sum(a * k for a, k in runs) <= 1024 and sum(k for a, k in runs if a > 341) <= 2
            bins += n
            for a, k in runs:
                held[a] += n * k
        assert dict(held) == counts
        assert bins <= np.ceil(sum(lengths) / 1024) * 1.35 + 1
    assert sum(n for n, _ in plan({512: 7, 1: 1024})) == 5


def test_pack_round_trip(spark, reference):
    docs = [(i, t, 1) for i, t in enumerate(ODD)] + [(0, "", 1), (None, None, 2), (7, "word and " * 4000, 3), (7, "word and " * 4000, 3)]
    out = pack(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    want = defaultdict(list)
    for i, t, _ in docs:
        ids = [*reference(t or ""), 2]
        start, k = 0, 0
        while start < len(ids):
            n = (len(ids) - start) % 1024 or 1024
            want[i].append((k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())))
            start, k = start + n, k + 1
    assert {i: sorted(x) for i, x in pieces.items()} == {i: sorted(x) for i, x in want.items()}
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_token_counts(spark, reference):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(None, None, 1), (3, "x y", 1)], SCHEMA)
    lengths = [len(reference(t or "")) for t in [*ODD, None, "x y"]]
    table = suffix_table(length_histogram(docs))
    rows = {r.length: r for r in table.collect()}
    assert set(rows) == set(lengths)
    for n, r in rows.items():
        assert r.docs == lengths.count(n) and r.docs_from == sum(x >= n for x in lengths) and r.total == sum(lengths)
        assert r.tokens_from == sum(x for x in lengths if x >= n) and r.truncated == sum(min(x, n) for x in lengths)
        assert abs(r.share - sum(x <= n for x in lengths) / len(lengths)) < 1e-12
    limits = spark.createDataFrame([(x,) for x in (0, 1, 5, 100, 10**6)], "limit long")
    assert {r.limit: r.truncated for r in at_limits(table, limits).collect()} == {x: sum(min(y, x) for y in lengths) for x in (0, 1, 5, 100, 10**6)}
    at = np.sort(lengths)
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    assert {r.share: r.length for r in quantiles(table, shares).collect()} == {q: int(at[max(0, int(np.ceil(q * len(at))) - 1)]) for q in shares}
    empty = suffix_table(length_histogram(docs.limit(0)))
    assert empty.count() == 0 and quantiles(empty, [0.5]).first().length is None and at_limits(empty, limits).agg({"truncated": "max"}).first()[0] == 0
    far = spark.createDataFrame([(n, 2) for n in (3, 1000, 1024, 5000, 9000)], "length long, docs long")
    asked = spark.createDataFrame([(x,) for x in (0, 3, 4, 1001, 1024, 1025, 3000, 5000, 5001, 9000, 9001, 50_000)], "limit long")
    assert {r.limit: r.truncated for r in at_limits(suffix_table(far), asked).collect()} == {r.limit: sum(2 * min(n, r.limit) for n in (3, 1000, 1024, 5000, 9000)) for r in asked.collect()}


def test_a_very_long_text(spark, reference):
    text = "long words that go on and on, " * 40_000
    n = len(reference(text))
    docs = spark.createDataFrame([(1, text, 0), (2, "short", 0)], SCHEMA)
    rows = {r.length: r.truncated for r in suffix_table(length_histogram(docs)).collect()}
    assert n in rows and rows[n] == n + 1
    pieces = pack(docs).where("doc_id = 1").collect()
    assert len(pieces) == -(-(n + 1) // 1024) and sum(r.length for r in pieces) == n + 1
