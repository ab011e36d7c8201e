import datetime as dt
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.functions import expr as X
from wayfare.operators import augment, ingest, sessions
from wayfare.sources import tables as T

T0 = dt.datetime(2024, 1, 1)


def events(spark, rows):
    """rows: (event_id, seconds, user, item, type)."""
    return spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), u, m, k, 0) for i, s, u, m, k in rows], "event_id long, ts timestamp, user_id long, item_id int, event_type int, region_id int")


def test_dedup_keeps_the_first_of_a_second(spark):
    e = events(spark, [(0, 0.9, 1, 1, 3), (1, 0.1, 1, 1, 3), (2, 1.0, 1, 1, 3), (3, 0.2, 1, 1, 6)])
    assert sorted(r.event_id for r in ingest.dedup_seconds(e).collect()) == [1, 2, 3]


def test_k_core(spark):
    ring = [(i, 0, i % 3, i // 3, 3) for i in range(9)]
    tail = [(9, 0, 7, 0, 3), (10, 0, 0, 9, 3)]
    core = ingest.k_core(events(spark, ring + tail), 3, 3)
    assert sorted(r.event_id for r in core.collect()) == list(range(9))
    with pytest.raises(ValueError, match="empty"):
        ingest.k_core(events(spark, ring), 4, 4)


def test_core_rounds_move_each_edge_once(spark, monkeypatch):
    rng, moved, real = np.random.default_rng(3), [], ingest.counted

    def counted(df, name="cut"):
        out = real(df, name)
        moved.append((name, out[1]))
        return out

    monkeypatch.setattr(ingest, "counted", counted)
    pairs = [(int(u), int(m)) for u, m in zip(rng.integers(0, 12, 90), rng.integers(0, 12, 90), strict=True)]
    pairs += [(100 + i, 100 + i) for i in range(6)] + [(100 + i, 101 + i) for i in range(6)]  # a chain, which falls from its ends
    rows = [(i, 0, u, m, 3) for i, (u, m) in enumerate(pairs)] + [(1000 + i, 0, 0, None, 3) for i in range(3)]
    want = [r for r in rows if r[3] is not None]
    while (kept := [r for r in want if sum(x[2] == r[2] for x in want) >= 2 and sum(x[3] == r[3] for x in want) >= 2]) != want:
        want = kept
    for most in (ingest.SENT_NODES, 0):
        monkeypatch.setattr(ingest, "SENT_NODES", most)
        moved.clear()
        assert sorted(r.event_id for r in ingest.k_core(events(spark, rows), 2, 2).collect()) == [r[0] for r in want]
        assert len([n for name, n in moved if name == "kcore-lost"]) > 3
        edges = len(set(pairs))
        assert sum(n for name, n in moved if name in ("kcore", "kcore-lost")) < 2 * edges
        got, _ = ingest.core_edges(events(spark, rows), 2, 2)
        assert got.agg(F.sum("n")).first()[0] == len(want)


def test_roots_with_cycle_and_missing_parent(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5), (7, 5), (8, 8)], "category_id int, parent_id int")
    roots = {r.category_id: r.root for r in ingest.category_roots(tree).collect()}
    assert roots == {1: 1, 2: 1, 3: 1, 4: 99, 5: 5, 6: 5, 7: 5, 8: 8}
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(30)], "category_id int, parent_id int")
    assert {r.root for r in ingest.category_roots(chain).collect()} == {0}


def test_gap_of_exactly_the_limit_stays(spark):
    e = events(spark, [(0, 0, 1, 1, 3), (1, 1800, 1, 1, 3), (2, 3600.000001, 1, 1, 3), (3, 0, 2, 1, 3)])
    s = {r.event_id: r.session_id for r in sessions.sessionize(e).collect()}
    assert s[0] == s[1] != s[2] and sorted(set(s.values())) == [0, 1, 2]
    long = sessions.sessionize(events(spark, [(i, i, 1, 1, 3) for i in range(7)]), max_events=3)
    assert [r["count"] for r in long.groupBy("session_id").count().orderBy("session_id").collect()] == [3, 3, 1]


def test_repeat_purchases(spark):
    e = events(spark, [(0, 0, 1, 1, 9), (1, 1, 1, 1, 3), (2, 2, 1, 1, 9), (3, 2, 1, 2, 9)])
    assert {r.event_id: r.event_type for r in sessions.repeat_purchases(e).collect()} == {0: 9, 1: 3, 2: 10, 3: 9}


def test_split_drops_users_that_train_does_not_know(spark):
    e = events(spark, [(i, i, i // 10, 1, 3) for i in range(100)])
    s = sessions.temporal_split(e).groupBy("split").count().collect()
    assert {r.split for r in s} == {"train"} and s[0]["count"] == 70
    assert all(r.ok for r in sessions.leakage_report(sessions.temporal_split(e)).collect())


def test_uniforms_equal_numpy_and_leave_ansi_alone(spark):
    ids = np.arange(-5, 500)
    got = X.with_uniform(spark.createDataFrame([(int(i),) for i in ids], "id long"), "id", 42, augment.SALTS["region"], "u").orderBy("id").collect()
    x = ids.astype(np.uint64) + np.uint64(42) + np.uint64(augment.SALTS["region"])
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    assert [r.u for r in got] == ((x >> np.uint64(11)) / 2.0**53).tolist()
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_attributes_follow_their_weights(spark):
    users = spark.range(20000).select(F.col("id").alias("user_id"))
    share = {r.device: r["count"] / 20000 for r in augment.user_attributes(users).groupBy("device").count().collect()}
    assert all(abs(share[i] - w) < 0.02 for i, w in enumerate(augment.DEVICE_WEIGHTS))
    roots = spark.createDataFrame([(1, 50), (2, 30), (3, 30), (4, 10)], "root int, n long")
    assert {r.root: r.vertical for r in augment.root_verticals(roots, [0.5, 0.5]).collect()} == {1: 0, 2: 1, 3: 1, 4: 0}
    u = np.array([1e-9, 1e-6, 0.01, 0.07, 0.08, 0.5, 0.9, 0.99, 1 - 1e-9])
    both = spark.createDataFrame([(float(x),) for x in u], "u double").select("u", augment.beta72_quantile(F.col("u")).alias("x"), augment.normal_quantile(F.col("u")).alias("z")).orderBy("u").collect()
    x = np.array([r.x for r in both])
    assert np.allclose(8 * x**7 - 7 * x**8, u)
    assert np.allclose([r.z for r in both], [NormalDist().inv_cdf(v) for v in u], rtol=1e-12, atol=1e-12)
    prices = augment.item_prices(spark.range(3000).select(F.col("id").alias("item_id"), (F.col("id") % 6).cast("int").alias("vertical")))
    med = {r.vertical: r.m for r in prices.groupBy("vertical").agg(F.median("price").alias("m")).collect()}
    assert abs(med[0] - np.exp(2.5)) < 1.5 and abs(med[2] - np.exp(1.6)) < 1


def test_csv_readers(spark, tmp_path):
    (tmp_path / "e.csv").write_text("timestamp,visitorid,event,itemid,transactionid\n1433221332117,257597,view,355908,\n1433224214164,992329,transaction,248676,4000\n")
    rows = T.read_events(spark, str(tmp_path / "e.csv")).orderBy("ts").collect()
    assert [r.event_type for r in rows] == [3, 9] and rows[0].ts == dt.datetime(2015, 6, 2, 5, 2, 12, 117000) and rows[1].transaction_id == 4000
    (tmp_path / "bad.csv").write_text("timestamp,visitorid,event,itemid,transactionid\n1,1,stare,1,\n")
    with pytest.raises(Exception, match="unknown event"):
        T.read_events(spark, str(tmp_path / "bad.csv")).collect()
    for n in (1, 2):
        (tmp_path / f"p{n}.csv").write_text(f"timestamp,itemid,property,value\n{n},7,categoryid,{n}\n{n},7,888,x\n")
    assert T.read_item_properties(spark, str(tmp_path / "p1.csv"), str(tmp_path / "p2.csv")).count() == 2
    (tmp_path / "t.csv").write_text("categoryid,parentid\n1,\n2,1\n")
    assert {r.category_id: r.parent_id for r in T.read_category_tree(spark, str(tmp_path / "t.csv")).collect()} == {1: None, 2: 1}


def test_feature_sink_checks_version_and_columns(spark, tmp_path):
    path = str(tmp_path / "features")
    T.write_features(spark.createDataFrame([("train", 1.0), ("test", 2.0)], "split string, a double"), path, "v1")
    assert T.read_features(spark, path, "v1", ["a"]).count() == 2
    with pytest.raises(ValueError, match="version"):
        T.read_features(spark, path, "v2", ["a"])
    with pytest.raises(ValueError, match="lack"):
        T.read_features(spark, path, "v1", ["a", "b"])
    with pytest.raises(ValueError, match="at most"):
        T.write_json_row(spark.range(T.REPORT_ROWS + 1), str(tmp_path / "long"))
    assert '"split"' in T.write_json_row(T.read_features(spark, path, "v1", ["a"]), str(tmp_path / "report"))


def test_merchants_are_drawn_from_their_ids(spark):
    m = augment.merchants(spark, per_vertical=2000).collect()
    assert [r.merchant_id for r in sorted(m, key=lambda r: r.merchant_id)] == list(range(12000)) and {r.vertical for r in m} == set(range(6))
    assert abs(np.mean([r.rating for r in m]) / 5 - 0.8) < 0.01 and 0 <= min(r.rating for r in m) and max(r.rating for r in m) <= 5  # Beta(8, 2) has the mean 0.8
    assert 2 <= min(r.delivery_radius_km for r in m) and max(r.delivery_radius_km for r in m) <= 15 and abs(np.mean([r.delivery_radius_km for r in m]) - 8.5) < 0.2
    assert {r.avg_delivery_minutes for r in m} == set(range(15, 75))
    assert {r.region_id for r in m} == set(range(12)) and sum(r.region_id == 0 for r in m) > 2 * sum(r.region_id == 5 for r in m)
    few = augment.merchant_attributes(spark.createDataFrame([(7, 0)], "merchant_id long, vertical int")).first()
    assert tuple(few)[2:] == tuple(next(r for r in m if r.merchant_id == 7))[2:]  # the id alone decides
