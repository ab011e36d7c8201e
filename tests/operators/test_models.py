import datetime as dt
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.operators import asof, drift, evaluate, neural, ranking, towers, vectors
from wayfare.operators import retrieval as R
from wayfare.streaming import events as S

T0 = dt.datetime(2024, 1, 1)
DAY = 86400.0


def brute(rows, r):
    """Features of r = (id, user, item, minute, type, price, vertical, merchant) from all strictly earlier rows."""
    past = [x for x in rows if x[3] < r[3]]
    user, item = [x for x in past if x[1] == r[1]], [x for x in past if x[2] == r[2]]
    pair = [x for x in user if x[2] == r[2]]
    buys = lambda xs: [x for x in xs if x[4] in (9, 10)]
    mean = lambda xs: sum(xs) / len(xs) if xs else None
    since = lambda xs, f: (r[3] - f(x[3] for x in xs)) * 60 / DAY if xs else None
    part = lambda n, xs: n / len(xs) if xs else None
    avg = mean([x[5] for x in user if x[5] > 0])
    return [
        len(user), len(buys(user)), part(len(buys(user)), user), len({x[2] for x in user}), since(user, max), since(user, min), avg, mean([x[5] for x in buys(user) if x[5] > 0]),
        len(item), len(buys(item)), part(len(buys(item)), item), len({x[1] for x in item}), since(item, max), since(item, min),
        len(pair), len(buys(pair)), since(pair, max), part(sum(x[6] == r[6] for x in user), user), part(sum(x[7] == r[7] for x in user), user), r[5] / avg if avg else None,
    ]


def test_asof_against_brute_force_with_ties(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(8), rng.randrange(10), rng.randrange(60), rng.choice([3, 3, 3, 6, 9]), rng.choice([0.0, 5.0, 12.5]), rng.randrange(3), rng.randrange(4)) for i in range(250)]
    df = spark.createDataFrame([(i, u, m, T0 + dt.timedelta(minutes=t), k, p, v, c) for i, u, m, t, k, p, v, c in rows], "event_id long, user_id long, item_id long, ts timestamp, event_type int, price_at_event double, vertical int, merchant_id int")
    got = {r.event_id: r for r in asof.asof_features(df).collect()}
    for r in rows:
        for name, want in zip(asof.FEATURES, brute(rows, r), strict=True):
            have = got[r[0]][name]
            assert (have is None) == (want is None) and (want is None or have == pytest.approx(want, abs=1e-9)), (name, r)
    early = [r for r in rows if r[3] < 30]
    cut = {r.event_id: r for r in asof.asof_features(df.where(F.minute("ts") < 30)).collect()}
    assert all(cut[r[0]] == got[r[0]] for r in early)
    assert asof.asof_features(df.select("event_id", "user_id", "item_id", "ts", "event_type").limit(0)).columns[-1] == asof.FEATURES[-1]


def test_fusion_by_hand(spark):
    rows = [(1, "a", 10, 1, 0.9), (1, "a", 11, 2, 0.8), (1, "b", 11, 1, 5.0), (1, "b", 12, 2, 4.0), (1, "b", -1, 3, 3.0)]
    ranked = spark.createDataFrame(rows, "user_id long, source string, item_id int, rank int, score double")
    out = R.fuse(ranked, ["a", "b"], spark.createDataFrame([(1, 10)], "user_id long, item_id int")).orderBy("position").collect()
    assert [(r.item_id, r.n_sources) for r in out] == [(11, 2), (12, 1)]
    assert out[0].fused == pytest.approx(1 / 62 + 1 / 61, abs=1e-9) and out[0].sources == ["a", "b"]
    tied = spark.createDataFrame([(1, "b", 5, 1, 1.0), (1, "a", 9, 1, 1.0)], ranked.schema)
    assert [r.item_id for r in R.fuse(tied, ["a", "b"]).orderBy("position").collect()] == [9, 5]


def greedy(items, k, mc=2, cc=3):
    chosen, held, merchants, categories = [], [], {}, {}
    for s, i, m, c in sorted(items, key=lambda x: (-x[0], x[1])):
        if len(chosen) < k and (m is None or merchants.get(m, 0) < mc) and (c is None or categories.get(c, 0) < cc):
            chosen.append(i)
            merchants[m], categories[c] = merchants.get(m, 0) + 1, categories.get(c, 0) + 1
        else:
            held.append(i)
    return (chosen + held)[:k]


def test_diversity_against_greedy(spark):
    rng = random.Random(1)
    groups = {u: [(round(rng.random(), 2), i, rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2])) for i in range(15)] for u in range(20)}
    df = spark.createDataFrame([(u, i, s, m, c) for u, g in groups.items() for s, i, m, c in g], "user_id long, item_id long, final double, merchant_id int, category_id int")
    got = {}
    for r in ranking.diversify(df, 10).orderBy("user_id", "position").collect():
        got.setdefault(r.user_id, []).append(r.item_id)
    assert got == {u: greedy(g, 10) for u, g in groups.items()}


def test_filters_and_adjustments(spark):
    df = spark.createDataFrame([(1, 1.0, False, 99.0, True, 0.5), (2, 1.0, None, None, True, 0.5), (3, 1.0, True, 50.0, False, 1.0)], "item_id int, score double, is_available boolean, delivery_minutes double, is_sponsored boolean, popularity_rank double")
    assert {r.item_id: r.reason for r in ranking.hard_filters(df, 40).collect()} == {1: "unavailable", 2: None, 3: "delivery_time"}
    out = {r.item_id: r for r in ranking.adjust(df, 0.1, 0.2).collect()}
    assert out[2].final == pytest.approx(1.0) and set(out[2].adjustments) == {"sponsored", "popularity"} and out[3].adjustments == {}


def test_metrics_by_hand(spark):
    recs = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (1, 4, 10), (2, 1, 10)], "user_id long, rank int, item_id int")
    truth = spark.createDataFrame([(1, 10), (1, 12), (3, 5)], "user_id long, item_id int")
    got = {r.user_id: r for r in evaluate.user_metrics(recs, truth).collect()}
    assert set(got) == {1, 3}
    r = got[1]
    assert r.precision_5 == pytest.approx(0.4) and r.recall_5 == 1 and r.mrr == 1 and r.map_5 == pytest.approx((1 + 2 / 3) / 2)
    assert r.ndcg_5 == pytest.approx((1 + 1 / 2) / (1 + 1 / np.log2(3))) and got[3].ndcg_20 == 0


def test_bootstrap_and_gate(spark):
    pairs = lambda f: spark.createDataFrame([(i, 0.0, f(i), f(i)) for i in range(200)], "user_id long, c double, t double, diff double")
    up = evaluate.bootstrap(pairs(lambda i: 0.1 + (i % 5) * 0.01), 300).first()
    assert 0.1 < up.lower < up.upper < 0.14 and 0 < up.p_value < 0.01
    none = evaluate.bootstrap(pairs(lambda i: float(i % 2) - 0.5), 300).first()
    assert none.lower < 0 < none.upper and none.p_value > 0.05
    assert tuple(evaluate.bootstrap(pairs(lambda i: 0.0).limit(0), 10).first()) == (0.0, 0.0, 1.0)
    gate = lambda rows: {r.check_name: r for r in evaluate.promotion_gate(spark.createDataFrame(rows, "metric string, candidate double, incumbent double")).collect()}
    good = gate([("ndcg", 0.02, None), ("coverage", 0.3, None), ("latency", 20.0, None)])
    assert all(r.promoted for r in good.values()) and good["gini"].verdict == "skipped"
    assert not gate([("ndcg", 0.02, 0.02), ("coverage", 0.3, 0.3)])["primary"].promoted
    assert gate([("ndcg", None, 0.02), ("coverage", 0.3, 0.3), ("latency", 1.0, 1.0)])["primary"].verdict == "inconclusive"


def test_drift_identities(spark):
    rng = np.random.default_rng(0)
    frame = lambda x: spark.createDataFrame([(float(v), float("nan") if i % 50 == 0 else 1.0) for i, v in enumerate(x)], "x double, c double")
    base = rng.normal(size=2000)
    same = {r.feature: r for r in drift.detect_drift(frame(base), frame(base), ["x", "c"]).collect()}
    assert same["x"].psi == 0 and same["x"].ks == 0 and same["x"].js == 0 and same["c"].reference_n == 1960
    far = drift.detect_drift(frame(base), frame(base + 100), ["x"]).first()
    assert far.ks == 1 and far.severity == "major" and 0.5 < far.js <= 1
    h = spark.createDataFrame([("a", 1.0, 0), ("a", 2.0, 10), ("a", float("inf"), 10), ("b", 1.0, 0), ("b", 2.0, 0), ("b", float("inf"), 4), ("z", 1.0, 0), ("z", float("inf"), 0)], "s string, upper double, cumulative long")
    assert {r.s: r.estimate for r in drift.histogram_percentile(h, "s", 0.5).collect()} == {"a": 1.5, "b": 2.0, "z": None}


def likes(seed=2):
    """Users like the half of 40 items that has their parity."""
    rng = np.random.default_rng(seed)
    return [(int(u), int(i)) for u in range(40) for i in rng.choice(np.arange(20) + 20 * (u % 2), 8, replace=False)]


@pytest.mark.parametrize("group", [200_000, 80])
def test_bpr_learns_in_blocks(spark, monkeypatch, group):
    monkeypatch.setattr(neural, "GROUP_PAIRS", group)
    users, items = neural.fit_bpr(spark.createDataFrame(likes(), "user_id long, item_id long"), dim=8, epochs=3, passes=8)
    top = neural.factor_topk(users, items, 5).collect()
    assert len(top) == 200 and {r["rank"] for r in top} == {1, 2, 3, 4, 5}
    assert np.mean([(r.item_id >= 20) == (r.user_id % 2 == 1) for r in top]) > 0.9


def test_factors_come_back_under_their_version(spark, tmp_path):
    users, items = (spark.createDataFrame([(i, [float(i + n), 1.0]) for i in range(3)], "id long, embedding array<double>") for n in (0, 10))
    neural.save_factors(users, items, f"{tmp_path}/f")
    assert [sorted((r.id, r.embedding) for r in df.collect()) for df in neural.load_factors(spark, f"{tmp_path}/f")] == [[(i, [float(i + n), 1.0]) for i in range(3)] for n in (0, 10)]
    spark.read.parquet(f"{tmp_path}/f").withColumn("version", F.lit("0")).write.parquet(f"{tmp_path}/old")
    with pytest.raises(ValueError, match="version"):
        neural.load_factors(spark, f"{tmp_path}/old")


@pytest.mark.parametrize("group", [200_000, 80])
def test_two_towers_learn(spark, monkeypatch, group):
    monkeypatch.setattr(neural, "GROUP_PAIRS", group)
    pairs = spark.createDataFrame([(u, i, [float(u % 2)]) for u, i in likes()], "user_id long, item_id long, x array<double>")
    items = spark.createDataFrame([(i, [float(i % 3), float(-np.log(40))]) for i in range(40)], "item_id long, x array<double>")
    model = towers.fit_two_tower(pairs, items, dim=8, hidden=16, epochs=3, passes=6, batch=64)
    users = model.encode(pairs.select(F.col("user_id").alias("id"), "x").distinct(), 0)
    found = model.encode(items.select(F.col("item_id").alias("id"), F.slice("x", 1, 1).alias("x")), 1)
    assert all(abs(np.linalg.norm(r.embedding) - 1) < 1e-9 for r in found.collect())
    top = neural.factor_topk(users, found, 5).collect()
    assert len(top) == 200 and np.mean([(r.item_id >= 20) == (r.user_id % 2 == 1) for r in top]) > 0.9


def test_in_batch_loss_and_gradients():
    q = np.eye(3)
    loss, p = towers.in_batch_loss(q, q, np.array([0, 0, 1]), np.zeros(3))
    assert p[0, 1] == 0 and loss < 1e-3
    _, p = towers.in_batch_loss(q, q, np.array([0, 1, 2]), np.zeros(3), known=np.array([[1, 0, 1], [0, 1, 0], [0, 0, 1]], bool))
    assert p[0, 2] == 0 and p[0, 0] > 0
    rng = np.random.default_rng(1)
    t = towers.Tower(5, 4, 3)
    w, f, d = t.start(rng) + rng.normal(0, 0.1, t.size), rng.normal(size=(6, 5)), rng.normal(size=(6, 3))
    _, seen = t.encode(w, f)
    dw, di = t.gradient(w, seen, d)
    value = lambda w, f: (t.encode(w, f)[0] * d).sum()
    for j in range(len(w)):
        e = np.zeros(len(w))
        e[j] = 1e-6
        assert (value(w + e, f) - value(w - e, f)) / 2e-6 == pytest.approx(dw[j], abs=1e-4)
    e = np.zeros_like(f)
    e[2, 1] = 1e-6
    assert (value(w, f + e) - value(w, f - e)) / 2e-6 == pytest.approx(di[2, 1], abs=1e-4)


def clustered(n=1200, d=16, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(20, d))[rng.integers(0, 20, n)] + rng.normal(size=(n, d)) * 0.4
    x[50] = x[51]
    return x


def test_exact_search_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(vectors, "ROUND", 2)
    x = clustered(400)
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16)], "id long, embedding array<double>").repartition(3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for few in (df.where("id % 100 = 0"), df):
        asked = [r.id for r in few.collect() if r.id < 400]
        want = set()
        for i in asked:
            s = np.round(unit @ unit[i], 6)
            s[i] = -np.inf
            want |= {(i, int(j), n + 1) for n, j in enumerate(np.lexsort((np.arange(400), -s))[:5])}
        got = vectors.cosine_topk(few, df, 5).collect()
        assert {(r.query, r.id, r["rank"]) for r in got} == want
    assert vectors.cosine_topk(df.limit(0), df, 5).count() == 0


def test_index_recall_and_version(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 40)
    x = clustered()
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id long, embedding array<double>")
    vectors.build_index(df, str(tmp_path / "index"))
    index = vectors.load_index(spark, str(tmp_path / "index"))
    assert index[1].count() == 1200 and index[0].agg(F.max("shards")).first()[0] > 1
    asked = df.where("id % 100 = 0")
    found, exact = vectors.search_index(index, asked, 10), vectors.cosine_topk(asked, df, 10)
    assert found.groupBy("query").count().where("count = 10").count() == 12
    assert evaluate.overlap_at_k(found, exact, 10).agg(F.avg("recall")).first()[0] >= 0.9
    assert index[0].first().probe < index[0].count()
    index[0].withColumn("version", F.lit("0")).write.parquet(str(tmp_path / "old/lists"))
    index[1].write.parquet(str(tmp_path / "old/vectors"))
    with pytest.raises(ValueError, match="version"):
        vectors.load_index(spark, str(tmp_path / "old"))


def test_lists_are_fitted_without_comparing_all_centres(spark, monkeypatch, tmp_path):
    from pyspark.ml.clustering import KMeans

    made, real = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, rows: made.append(self.getSolver()) or real(self, rows))
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(clustered())], "id long, embedding array<double>")
    vectors.build_index(df, str(tmp_path / "index"))
    assert made == ["block"]


def test_recall_on_the_embeddings(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    row = vectors.benchmark(df, df.where("id % 100 = 0"), str(tmp_path / "index")).first()
    assert row.recall >= 0.9 and row.vectors == 500 and row.queries == 5 and row.build_s > 0


def test_scores_are_added_up_where_the_history_lies(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(u, int(i), float(rng.integers(1, 9))) for u in range(15) for i in rng.choice(30, 6, replace=False)]
    m = spark.createDataFrame(rows, "user_id long, item_id int, w double")
    similar = R.item_similarity(m).localCheckpoint()
    scores = R.cf_scores(m, similar)
    plan = R.top_k(scores, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") == 1  # histories by user
    whole = {(r.user_id, r.item_id): r.score for r in scores.collect()}
    want = {}
    near = {}
    for r in similar.collect():
        near.setdefault(r.item_i, []).append((r.item_j, r.sim))
    for u, i, w in rows:
        for j, x in near.get(i, []):
            want[u, j] = want.get((u, j), 0) + w * x
    assert whole == pytest.approx(want) and whole.keys() == want.keys()
    monkeypatch.setattr(R, "SENT_PAIRS", 50)
    dealt = {(r.user_id, r.item_id): r.score for r in R.cf_scores(m, similar).collect()}
    assert dealt == pytest.approx(want) and dealt.keys() == want.keys()


def test_tasks_by_user_are_as_many_as_the_work_needs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    m = spark.createDataFrame([(u, int(i), 1.0) for u in range(40) for i in rng.choice(20, 6, replace=False)], "user_id long, item_id int, w double")
    similar = R.item_similarity(m).localCheckpoint()
    hits = m.join(similar, m.item_id == similar.item_i).count()
    parts = lambda df: int(re.search(r"hashpartitioning\(user_id#\d+L?, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())[1])
    few = {(r.user_id, r.item_id): r.score for r in R.cf_scores(m, similar).collect()}
    assert parts(R.cf_scores(m, similar)) == 4  # the session's
    monkeypatch.setattr(R, "TASK_HITS", 50, raising=False)
    scores = R.cf_scores(m, similar)
    assert parts(scores) == math.ceil(hits / 50)
    assert {(r.user_id, r.item_id): r.score for r in scores.collect()} == pytest.approx(few)
    ranked = R.top_k(scores, 5).withColumn("source", F.lit("a")).localCheckpoint()
    one = {tuple(r) for r in R.fuse(ranked, ["a"], m).select("user_id", "item_id", "fused", "position").collect()}
    monkeypatch.setattr(R, "TASK_ROWS", 50, raising=False)
    fused = R.fuse(ranked, ["a"], m, expected=440)
    assert parts(fused) == 9
    assert {tuple(r) for r in fused.select("user_id", "item_id", "fused", "position").collect()} == one


def test_similarity_of_heavy_users(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(u, int(i), float(rng.integers(1, 9))) for u in range(12) for i in rng.choice(60, 50 if u == 0 else 8, replace=False)]
    m = spark.createDataFrame(rows, "user_id long, item_id int, w double")
    whole = {(r.item_i, r.item_j): r.sim for r in R.item_similarity(m).collect()}
    monkeypatch.setattr(R, "HEAVY", 7)
    dealt = {(r.item_i, r.item_j): r.sim for r in R.item_similarity(m).collect()}
    assert dealt == pytest.approx(whole) and dealt.keys() == whole.keys()
    w = {(u, i): x for u, i, x in rows}
    items = sorted({i for _, i, _ in rows})
    col = {i: np.array([w.get((u, i), 0.0) for u in range(12)]) for i in items}
    want = {(i, j): round(s, 9) for i in items for j in items if i != j and (s := col[i] @ col[j] / np.linalg.norm(col[i]) / np.linalg.norm(col[j]) / (col[j] > 0).sum() ** 0.5) >= 1e-4}
    assert whole == pytest.approx(want, abs=2e-9)


def test_trees_rank_and_explain(spark, tmp_path):
    rng = random.Random(4)
    rows = [(u, i, float(rng.random()), float(rng.random()), rng.choice([None, 1.0, 2.0])) for u in range(60) for i in range(10)]
    rows = [(u, i, a, b, c, int(a > 0.7 and c is not None)) for u, i, a, b, c in rows]
    df = spark.createDataFrame(rows, "user_id long, item_id long, a double, b double, c double, label int")
    model = ranking.fit_trees(df, ["a", "b", "c"], trees=8, depth=3)
    gains = dict(ranking.gain_importance(model, ["a", "b", "c"]))
    assert gains["a"] > gains["c"] > gains["b"] and sum(gains.values()) == pytest.approx(1)
    top = ranking.tree_rank(df, model, ["a", "b", "c"], 3)
    first = top.where("rank = 1").agg(F.avg("label")).first()[0]
    assert first > 0.8
    why = {(r.user_id, r.item_id): r for r in ranking.explain_trees(top, model, ["a", "b", "c"], 3, str(tmp_path / "trees")).collect()}
    for r in top.collect():
        w = why[r.user_id, r.item_id]
        assert w.base + sum(x.value for x in w.reasons) == pytest.approx(r.score)
        assert [abs(x.value) for x in w.reasons] == sorted((abs(x.value) for x in w.reasons), reverse=True)


def test_saved_state_of_another_version_is_refused(spark, tmp_path):
    rows = [(1, 5, T0, 9, 2.0), (1, 5, T0 + dt.timedelta(days=1), 3, 0.0), (1, 6, T0, 3, 4.0), (2, 5, T0, 9, 0.0)]
    e = spark.createDataFrame(rows, "user_id long, item_id long, ts timestamp, event_type int, price_at_event double")
    asof.save_state(asof.pair_state(e.limit(2)), str(tmp_path / "s"))
    both = asof.merge_pairs(asof.load_state(spark, str(tmp_path / "s")), asof.pair_state(e.subtract(e.limit(2))))
    want = {r.user_id: r for r in asof.user_state(e).collect()}
    for r in asof.state_of_users(both).collect():
        assert r == want[r.user_id]
    asof.load_state(spark, str(tmp_path / "s")).withColumn("version", F.lit("0")).write.parquet(str(tmp_path / "old"))
    with pytest.raises(ValueError, match="version"):
        asof.load_state(spark, str(tmp_path / "old"))


def test_late_events_do_not_move_state_back(spark, tmp_path):
    for n, (user, minute) in enumerate([(1, 50), (1, 10), (2, 5)]):
        df = spark.createDataFrame([(n, T0 + dt.timedelta(minutes=minute), user, 1, 9, 1.0)], S.EVENT_SCHEMA)
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = S.running_user_state(S.read_stream(spark, f"{tmp_path}/in")).writeStream.outputMode("update").format("memory").queryName("late_state").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    last = spark.sql("SELECT max_by(struct(*), events) AS x FROM late_state GROUP BY user_id").select("x.*").collect()
    us = lambda m: int((T0 - dt.datetime(1970, 1, 1)).total_seconds() + 60 * m) * 1000000
    assert {(r.user_id, r.events, r.first_us, r.last_us) for r in last} == {(1, 2, us(10), us(50)), (2, 1, us(5), us(5))}
