"""The pipeline's near-dedup stage against all pairs of five-word shingle sets."""

import numpy as np

import corpus_pipeline as P
from tests.conftest import SF
from wayfare.llm import jaccard as J


def five_words(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    """Least index reachable over pairs of similarity 0.8 and more."""
    sets, label = [five_words(t) for t in texts], list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


def family(seed=3):
    """Texts of 120 words, and copies of them with some words replaced."""
    rng = np.random.default_rng(seed)
    out = []
    for base in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for edits in (0, 1, 1, 2, 2, 3, 4, 6, 9):
            copy = list(words)
            for at in rng.choice(120, edits, replace=False):
                copy[at] = f"x{rng.integers(0, 10**6)}"
            out.append(" ".join(copy))
    return out + ["", " ", None, "few words", "Few  WORDS", "few others"]


def test_stage_drops_all_near_copies(spark):
    texts = family()
    docs = spark.createDataFrame([(5 * i + 2, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    kept = sorted(r.doc_id for r in P.near_dedup(spark, docs, SF).collect())
    assert kept == [5 * i + 2 for i in sorted(set(brute(texts)))]


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    want = {rows[i].doc_id for i in brute([r.text for r in rows])}
    assert {r.doc_id for r in P.near_dedup(spark, docs, SF).collect()} == want


def test_pairs_at_the_threshold_share_a_key():
    rng = np.random.default_rng(9)
    found = 0
    for _ in range(2000):
        x = rng.integers(0, 2**63, 200, dtype=np.uint64) * np.uint64(2)
        a, b = np.unique(x[:180]), np.unique(x[20:])  # 160 of 200 are shared
        found += bool((J.band_keys(a) == J.band_keys(b)).any())
    assert found >= 1996


def test_edges(spark):
    schema = "doc_id long, text string"
    assert P.near_dedup(spark, spark.createDataFrame([], schema), SF).count() == 0
    rows = [(None, "a b"), (None, "a b"), (4, "a b"), (4, "a b"), (9, "A  B")]
    assert sorted(r.doc_id or 0 for r in P.near_dedup(spark, spark.createDataFrame(rows, schema), SF).collect()) == [0, 0, 4]


def test_loose_groups_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 20)  # one bucket meets itself in several tasks
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    texts = []
    for i in range(150):
        copy = list(base)
        for at in rng.choice(200, int(rng.integers(2, 9)), replace=False):
            copy[at] = f"x{rng.integers(0, 10**6)}"
        texts.append(" ".join(copy[: int(rng.integers(150, 200))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs, SF).collect()) == sorted(set(brute(texts)))


def test_shared_elements():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (0, 1, 50, 4000, 6000, 6000)]
    for n in (6, 2):
        got = J.shared_elements(sets, n)
        want = [[len(np.intersect1d(a, b)) for b in (sets[n:] or sets)] for a in sets[:n]]
        for i, row in enumerate(want):
            assert [x for j, x in enumerate(row) if n < 6 or i != j] == [x for j, x in enumerate(got[i].tolist()) if n < 6 or i != j]


def test_repeated_ids_and_rows_keep_every_text(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [(1, one, "x", None, 1), (1, two, "x", None, 1), (2, three, None, "x", 1), (2, three, None, "x", 1), (2, three, "x", None, 1), (3, two, "y", "y", 1), (7, None, "e", "e", 1), (7, "", None, None, 2), (None, one, "z", "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string, text_hash string, root long")
    got = sorted(((r.doc_id or 0), r.text or "") for r in P.near_dedup(spark, docs, SF).collect())
    assert got == [(0, one), (1, one), (1, two), (2, three), (7, "")]
    assert P.near_dedup(spark, docs, SF).columns == docs.columns
