"""Features, counts, training, calibration and predictions against plain versions, and held-out accuracy."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from wayfare.llm import langid


def plain_hash(gram):
    h = 0
    for ch in gram:
        h = (h * 0x01000193 + ord(ch)) % 2**32
    x = (h ^ (0x9E3779B1 * len(gram) & 0xFFFFFFFF)) * 0x85EBCA6B % 2**32
    return (x ^ (x >> 15)) * 0xC2B2AE35 % 2**32 >> (32 - langid.BITS)


def plain_counts(text):
    out, gap = [" "], False
    for ch in text.lower():
        if ch.isalpha():
            out.append(ch)
            gap = False
        elif not gap and out != [" "] or (not gap and len(out) == 1):
            out.append(" ")
            gap = True
    s = "".join(out) + " "
    return Counter(plain_hash(s[i : i + n]) for n in range(1, langid.ORDER + 1) for i in range(len(s) - n + 1))


@pytest.mark.parametrize("text", ["a", "Hello, World", "Été 2024\n\nDAß \U0001f600x", " , x", "ab" * 50])
def test_features_are_hashed_ngrams(text, monkeypatch):
    want = plain_counts(text)
    ids, n = langid.counts(text)
    assert dict(zip(ids.tolist(), n.tolist(), strict=True)) == want
    monkeypatch.setattr(langid, "PIECE", 7)
    ids, n = langid.counts(text)
    assert dict(zip(ids.tolist(), n.tolist(), strict=True)) == want


def test_document_frequencies_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = docs.select("text").unionByName(spark.createDataFrame([(None,), ("",), ("12 34",), ("one",)], "text string")).repartition(5)
    n, df = langid.document_frequencies(docs)
    texts = [r.text for r in docs.collect() if langid.has_letter(r.text)]
    want = np.zeros(2**langid.BITS, int)
    for x in texts:
        want[list(plain_counts(x))] += 1
    assert n == len(texts) and df.tolist() == want.tolist()


def test_leader_follows_its_formula():
    rng = np.random.default_rng(1)
    leader = langid.Leader(5, 3, alpha=0.7, beta=1.0, l1=0.05, l2=0.1)
    z, n = np.zeros((6, 3)), np.zeros((6, 3))

    def weight(f, c):
        l1, l2 = (0.05, 0.1) if f < 5 else (0, 0)
        return 0.0 if abs(z[f, c]) <= l1 else (np.sign(z[f, c]) * l1 - z[f, c]) / ((1.0 + np.sqrt(n[f, c])) / 0.7 + l2)

    for _ in range(60):
        ids = np.append(np.sort(rng.choice(5, 3, replace=False)), 5)
        x, y = np.append(rng.uniform(size=3), 1.0), int(rng.integers(3))
        leader.learn(ids, x, y)
        w = np.array([[weight(f, c) for c in range(3)] for f in ids])
        p = np.exp(x @ w) / np.exp(x @ w).sum()
        for i, f in enumerate(ids):
            for c in range(3):
                g = (p[c] - (c == y)) * x[i]
                z[f, c] += g - (np.sqrt(n[f, c] + g * g) - np.sqrt(n[f, c])) / 0.7 * w[i, c]
                n[f, c] += g * g
    np.testing.assert_allclose(leader.weights(np.arange(6)), [[weight(f, c) for c in range(3)] for f in range(6)], atol=1e-4)
    strict = langid.Leader(5, 3, l1=100.0)
    strict.learn(np.array([0, 5]), np.array([1.0, 1.0]), 1)
    assert not strict.weights(np.arange(5)).any() and strict.weights(np.array([5])).any()


def test_temperature_undoes_a_scale():
    rng = np.random.default_rng(2)
    logits = rng.normal(size=(4000, 3)) * 2
    p = langid.softmax(logits)
    y = np.array([rng.choice(3, p=x) for x in p])
    assert langid.temperature(logits * 4, y) == pytest.approx(4, rel=0.1) and langid.temperature(logits / 3, y) == pytest.approx(1 / 3, rel=0.1)
    assert langid.temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_sample_is_bounded_even_and_without_copies(spark):
    rows = [(i, f"{'abc'[i % 3]} word{i} of it", "xyz"[i % 3] if i < 600 else "x") for i in range(1500)]
    rows += [(9, "the same row again", "x")] * 700 + [(10_000 + i, "1234", "z") for i in range(5)]
    often = Counter(r[2] for r in rows)
    found = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), often, 90, 10**6)
    got = Counter(x for x, *_ in found)
    assert set(got) == set("xyz") and max(got.values()) <= 30 and min(got.values()) >= 20
    few = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), often, 90, 500)
    assert 0 < sum(len(ids) for _, ids, _ in few) <= 500
    assert len(langid.sample(spark.createDataFrame(rows[:20], "doc_id long, text string, lang string"), Counter(r[2] for r in rows[:20]), 90, 10**6)) == 20


def test_query_on_held_out_rows(spark):
    got = langid.op13_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(got) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and langid.has_letter(lang[r.doc_id][1])]
    assert len(held) > 200 and np.mean([r.lang_pred == lang[r.doc_id][0] for r in held]) >= 0.98
    assert abs(np.mean([r.score for r in held]) - np.mean([r.lang_pred == lang[r.doc_id][0] for r in held])) < 0.05


def test_odd_rows(spark):
    words = {"aa": "kala mana tara", "bb": "zug wolf drum", None: "kala wolf"}
    rows = [(i, f"{words[k]} {i}", k, "p", "s") for i, k in enumerate([*["aa", "bb", None] * 30])]
    rows += [(100, None, "aa", "p", "s"), (101, "", "bb", "p", "s"), (102, "12 - 34 !", "cc", "p", "s"), (None, "tara tara", "aa", "p", "s"), (5, "mana " * 200_000, "aa", "p", "s"), (7, "kala", "aa", "p", "s"), (7, "kala", "aa", "p", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, _found string").withColumn("a.b", F.lit(1))
    model = langid.fit(docs)
    assert model.langs == ["aa", "bb"]
    out = langid.identify(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "_found", "a.b", "lang_pred", "score"]
    got = out.collect()
    assert len(got) == len(rows) and all(r["_found"] == "s" for r in got)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (100, 101, 102))
    assert all(r.lang_pred == r.lang for r in got if r.lang in ("aa", "bb") and r.doc_id not in (100, 101))
    assert langid.identify(docs.limit(0), model).count() == 0
    none = langid.fit(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, none).collect()} == {("und", 0.0)}
    one = langid.fit(docs.where("lang = 'aa'"))
    assert {r.lang_pred for r in langid.identify(docs, one).collect()} == {"aa", "und"}
    assert langid.fit(docs, max_langs=1).langs == ["aa"]
