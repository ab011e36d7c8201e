import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wayfare.llm import katz as K


class Brute:
    """Katz by dictionaries, from the definition."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = [Counter() for _ in range(order)]
        for t in texts:
            words = ["<s>"] * (order - 1) + self.words(t)
            for i in range(order - 1, len(words)):
                for o in range(order):
                    self.counts[o][tuple(words[i - o : i + 1])] += 1
        self.total, self.known = sum(self.counts[0].values()), len(self.counts[0])
        self.d = [K.discounts([sum(c == r for c in x.values()) for r in range(1, 7)]) for x in self.counts]
        self.follow = [defaultdict(list) for _ in range(order)]
        for o, x in enumerate(self.counts):
            for g in x:
                self.follow[o][g[:-1]].append(g[-1])

    @staticmethod
    def words(text):
        return [w.decode("latin-1") for w in (text or "").encode().lower().split()] + ["</s>"]

    def kept(self, c, o):
        return c * self.d[o][c] if c <= 5 else c - K.SLIVER

    def p(self, word, context):
        o = len(context)
        c = self.counts[o][*context, word]
        if o == 0:
            if c:
                return self.kept(c, 0) / self.total
            return 1 - sum(self.kept(x, 0) for x in self.counts[0].values()) / self.total if self.total else 1.0
        after = self.follow[o][context]
        if not after:
            return self.p(word, context[1:])
        times = sum(self.counts[o][*context, w] for w in after)
        if c:
            return self.kept(c, o) / times
        left = 1 - sum(self.kept(self.counts[o][*context, w], o) for w in after) / times
        return left / (1 - sum(self.p(w, context[1:]) for w in after)) * self.p(word, context[1:])

    def score(self, text):
        words = ["<s>"] * (self.order - 1) + self.words(text)
        return sum(math.log10(self.p(words[i], tuple(words[i - self.order + 1 : i]))) for i in range(self.order - 1, len(words)))


TEXTS = ["the cat sat on the mat", "The cat ran", "a dog sat on a log", "", None, "the the the the the the the the cat", "x y z x y z x y q", "rare words alone here", "Ä ä the CAT", "the cat sat on the mat"]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_against_brute_force(spark, order):
    rows = [(i if i != 6 else None, t, i % 4 != 3, i) for i, t in enumerate(TEXTS * 3)]
    rows.append((99, "mat dog the sat unheard cat rare alone words", False, 0))
    rows.append((100, "long words here " * 20000, False, 0))
    model = Brute([t for _, t, learn, _ in rows if learn], order)
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean, idx long").repartition(3)
    got = K.score(docs, F.col("train"), order, block_bytes=60).collect()
    assert len(got) == len(rows) and all(r.train_tokens == model.total for r in got)
    found = {r.doc_id: r for r in got}
    for i, t, learn, _ in rows:
        r = found[i]
        words = model.words(t)
        assert r.n_tokens == len(words) and r.held_out != learn
        c = [model.counts[0][w,] for w in words]
        assert r.n_known == sum(x > 0 for x in c)
        assert r.base_score == pytest.approx(sum(math.log10((x + 1) / (model.total + model.known + 1)) for x in c), rel=1e-9)
        if i != 100:
            assert r.score == pytest.approx(model.score(t), abs=1e-8), t


def test_distributions_sum_to_one():
    model = Brute(TEXTS * 2, 3)
    vocabulary = [g[0] for g in model.counts[0]] + ["unheard"]
    for context in [("the",), ("cat",), ("unheard",), ("the", "cat"), ("<s>", "<s>"), ("y", "z"), ()]:
        assert sum(model.p(w, context) for w in vocabulary) == pytest.approx(1, abs=1e-9)


def test_query_and_edges(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    model = Brute([t for i, t in docs.items() if i not in held], K.ORDER)
    got = K.op1_katz_backoff(spark, d).collect()
    assert {r.doc_id for r in got if r.held_out} == held and len(got) == len(docs)
    for r in sorted(got, key=lambda r: r.doc_id)[:25]:
        assert r.score == pytest.approx(model.score(docs[r.doc_id]), rel=1e-9)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    schema = "doc_id long, text string"
    assert K.score(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    alone = K.score(spark.createDataFrame([(1, "a b"), (2, None)], schema), F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 and r.base_score == 0 for r in alone)
