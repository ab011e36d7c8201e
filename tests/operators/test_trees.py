"""Listwise trees: gradients by finite differences, splits by brute force, order of held-out groups; Shapley values by all subsets."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.operators import ranking, trees
from wayfare.sources.tables import scratch


def test_gradients_are_finite_differences():
    rng = np.random.default_rng(0)
    ends = np.array([4, 5, 11, 11 + 7])
    score, label = rng.normal(size=18), rng.integers(0, 3, 18).astype(float)
    g, h = trees.listwise_gradients(score, label, ends, 1.3)
    starts = np.append(0, ends[:-1])
    weights = [trees.swap_weights(score[None, a:b], label[None, a:b])[0] for a, b in zip(starts, ends, strict=True)]

    def loss(s):
        return sum((w * np.log1p(np.exp(-1.3 * (s[a:b, None] - s[None, a:b])))).sum() for w, a, b in zip(weights, starts, ends, strict=True))

    e = 1e-4
    for i in range(18):
        up, down = score.copy(), score.copy()
        up[i] += e
        down[i] -= e
        assert g[i] == pytest.approx((loss(up) - loss(down)) / 2 / e, abs=1e-6)
        assert h[i] == pytest.approx((loss(up) - 2 * loss(score) + loss(down)) / e / e, abs=1e-4)


def test_pairs_grow_with_the_positives(monkeypatch):
    rng, met, real = np.random.default_rng(5), [], trees.higher_weights
    monkeypatch.setattr(trees, "higher_weights", lambda s, y: met.append(real(s, y)) or met[-1], raising=False)
    monkeypatch.setattr(trees, "PAIR_ENTRIES", 100)
    ends = np.array([25, 50, 51, 76, 100])
    label = np.zeros(100)
    label[[3, 30, 31, 80]] = 1
    g, h = trees.listwise_gradients(rng.normal(size=100), label, ends)
    assert sum(w.size for *_, w in met) == 3 * 25 + 24
    assert g[50] == 0 and not g[51:76].any() and (g[[3, 30, 31, 80]] < 0).all() and (h[:50] > 0).all()
    assert [g[a:b].sum() for a, b in zip([0, *ends[:-1]], ends, strict=True)] == pytest.approx([0] * 5)


def test_swap_weights_are_changes_in_ndcg():
    rng = np.random.default_rng(1)
    s, y = rng.normal(size=6), np.array([0, 2, 1, 0, 1, 0.0])

    def ndcg(order):
        return ((2.0 ** y[order] - 1) / np.log2(np.arange(6) + 2)).sum() / (np.sort(2.0**y - 1)[::-1] / np.log2(np.arange(6) + 2)).sum()

    order = np.argsort(-s, kind="stable")
    w = trees.swap_weights(s[None], y[None])[0]
    for i in range(6):
        for j in range(6):
            swapped = order.copy()
            a, b = np.flatnonzero(order == i)[0], np.flatnonzero(order == j)[0]
            swapped[a], swapped[b] = j, i
            assert w[i, j] == pytest.approx(abs(ndcg(order) - ndcg(swapped)) if y[i] > y[j] else 0.0, abs=1e-12)


def rows(spark, groups, size, seed):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        a, b, c = rng.uniform(size=(3, size))
        worth = np.where(a > 0.5, b, 1 - b) + 0.2 * rng.normal(size=size)  # the sense of b turns with a
        top = set(np.argsort(-worth)[:3].tolist())
        out += [(g, i, int(i in top), float(a[i]), float(b[i]) if rng.uniform() > 0.05 else None, float(c[i])) for i in range(size)]
    return spark.createDataFrame(out, "user_id long, item_id long, label int, a double, b double, c double")


NAMES = ["a", "b", "c"]


def ndcg_of(ranked, k=10):
    got = ranked.where(f"rank <= {k}").groupBy("user_id").agg(F.sum(F.col("label") / F.log2(F.col("rank") + 1)).alias("d")).agg(F.avg("d")).first()[0]
    return got / sum(1 / np.log2(i + 2) for i in range(3))


def ordered(df, score):
    from pyspark.sql import Window

    return df.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id")))


def test_held_out_groups_are_ordered_at_least_as_well_as_by_labels_alone(spark):
    fit, held = rows(spark, 150, 15, 2), rows(spark, 80, 15, 3)
    model = trees.fit_listwise(fit, NAMES, trees=12, depth=3, rate=0.3)
    ours = ndcg_of(ordered(held, trees.scores(model)))
    theirs = ndcg_of(ranking.tree_rank(held, ranking.fit_trees(fit, NAMES, trees=12, depth=3, rate=0.3), NAMES, 15))
    chance = ndcg_of(ordered(held, F.col("c")))
    assert ours >= theirs - 0.005 and ours > chance + 0.2
    assert dict(trees.gains(model))["c"] < 0.2


def test_first_split_is_the_best_of_all(spark):
    df = rows(spark, 40, 10, 4)
    got = sorted(((r.user_id, r.item_id, r.label, r.a, r.b, r.c) for r in df.collect()), key=lambda r: r[:2])
    x = np.array([[np.nan if v is None else v for v in r[3:]] for r in got], float)
    y = np.array([r[2] for r in got], float)
    g, h = trees.listwise_gradients(np.zeros(len(y)), y, np.arange(10, 401, 10))
    model = trees.fit_listwise(df, NAMES, trees=1, depth=1, ridge=1.0, least_rows=10)
    t = model.trees[0]
    best = 0.0
    for f, edges in enumerate(model.edges):
        for e in [-np.inf, *edges]:
            left = ~(x[:, f] > e)
            if min(left.sum(), (~left).sum()) >= 10:
                worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
                best = max(best, worth(left) + worth(~left) - worth(np.ones(len(y), bool)))
    # Ties in score are in the order of hashed groups and rows, so gradients at the start may differ by ties alone.
    assert t.gain[0] == pytest.approx(best, rel=0.25) and t.cover[0] == 400 and t.cover[1] + t.cover[2] == 400
    left = ~(x[:, t.feature[0]] > t.threshold[0])
    assert left.sum() == t.cover[1]


def brute(tree, x, known):
    """The expected value of a tree where only the known features are."""
    def go(at):
        f = tree.feature[at]
        if f < 0:
            return tree.value[at]
        left, right = 2 * at + 1, 2 * at + 2
        if f in known:
            return go(right if x[f] > tree.threshold[at] else left)
        return (tree.cover[left] * go(left) + tree.cover[right] * go(right)) / tree.cover[at]

    return go(0)


def random_tree(rng, depth, features):
    n = 2 ** (depth + 1) - 1
    t = trees.Tree(np.full(n, -1), np.zeros(n), rng.normal(size=n), np.zeros(n), np.zeros(n))

    def grow(at, cover, d):
        t.cover[at] = cover
        if d < depth and cover >= 2 and rng.uniform() > 0.15:
            t.feature[at], t.threshold[at] = rng.integers(features), rng.normal()
            cut = rng.integers(1, cover)
            grow(2 * at + 1, cut, d + 1)
            grow(2 * at + 2, cover - cut, d + 1)

    grow(0, 500, 0)
    return t


def test_shapley_values_equal_all_subsets():
    rng = np.random.default_rng(5)
    m = 5
    forest = trees.Forest([f"f{i}" for i in range(m)], [], [random_tree(rng, 4, m) for _ in range(6)])
    x = rng.normal(size=(7, m))
    x[0, 2] = np.nan
    base, parts = trees.shapley(forest, x)
    np.testing.assert_allclose(base + parts.sum(1), forest.score(x), atol=1e-10)
    for row, got in zip(x, parts, strict=True):
        value = {s: sum(brute(t, row, set(s)) for t in forest.trees) for k in range(m + 1) for s in combinations(range(m), k)}
        assert base == pytest.approx(value[()])
        for f in range(m):
            rest = [i for i in range(m) if i != f]
            want = sum(factorial(k) * factorial(m - k - 1) / factorial(m) * (value[tuple(sorted((*s, f)))] - value[s]) for k in range(m) for s in combinations(rest, k))
            assert got[f] == pytest.approx(want, abs=1e-10)


def test_explanations_add_up_and_models_come_back(spark):
    df = rows(spark, 60, 12, 6)
    model = trees.fit_listwise(df, NAMES, trees=11, depth=2)  # scores are written anew once
    assert len(model.trees) == 11
    path = scratch(spark, "forest")
    trees.save_forest(spark, model, path)
    again = trees.load_forest(spark, path)
    scored = {(r.user_id, r.item_id): r.score for r in df.withColumn("score", trees.scores(again)).collect()}
    out = trees.explain(df, again, 2).collect()
    assert len(out) == df.count()
    for r in out:
        assert r.base + r.rest + sum(x.value for x in r.reasons) == pytest.approx(scored[r.user_id, r.item_id], abs=1e-9) and len(r.reasons) == 2
    spark.read.parquet(f"{path}/features").withColumn("version", F.lit("0")).write.parquet(f"{path}-old/features")
    with pytest.raises(ValueError, match="version"):
        trees.load_forest(spark, f"{path}-old")


def test_nothing_to_learn(spark):
    df = rows(spark, 3, 5, 7)
    assert not trees.fit_listwise(df.withColumn("label", F.lit(1)), NAMES).trees
    none = trees.fit_listwise(df.limit(0), NAMES)
    assert not none.trees and {r.score for r in df.withColumn("score", trees.scores(none)).collect()} == {0.0}
