"""The jobs from raw CSV logs to reports, by the command line."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wayfare import __main__ as cli
from wayfare.operators import augment, ingest, ranking, sessions
from wayfare.operators import retrieval as R
from wayfare.plans import jobs
from wayfare.sources import tables as T

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
EVENTS = "ts timestamp, user_id long, item_id long, event_type int"


def raw(tmp_path):
    rng = random.Random(5)
    start = int(T0.timestamp() * 1000)
    rows = [(start + rng.randrange(20 * 86_400_000), 500 + rng.randrange(20), 900 + rng.randrange(15), rng.choice(["view", "view", "addtocart", "transaction"])) for _ in range(900)]
    rows += [(start + 5, 500, 900, "view"), (start + 7, 500, 900, "view"), (start + 9, 1, 2, "view")]  # twice in a second; outside the core
    (tmp_path / "events.csv").write_text("timestamp,visitorid,event,itemid,transactionid\n" + "".join(f"{t},{u},{e},{i},{'7' if e == 'transaction' else ''}\n" for t, u, i, e in rows))
    for part in (1, 2):
        lines = [f"{start + k},{900 + k},{p},{v}\n" for k in range(15) if k % 2 == part % 2 for p, v in (("categoryid", k % 4), ("available", k % 3 and 1), ("other", "x"))]
        (tmp_path / f"properties{part}.csv").write_text("timestamp,itemid,property,value\n" + "".join(lines))
    (tmp_path / "tree.csv").write_text("categoryid,parentid\n0,\n1,0\n2,1\n3,9\n")
    return rows


def test_command_line_from_csv_to_reports(spark, tmp_path, capsys):
    rows = raw(tmp_path)
    out = str(tmp_path / "out")
    cli.main(["build", "--out", out, "--events", f"{tmp_path}/events.csv", "--properties", f"{tmp_path}/properties1.csv", f"{tmp_path}/properties2.csv", "--tree", f"{tmp_path}/tree.csv"])
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    seconds = {(u, i, e, t // 1000) for t, u, i, e in rows if u != 1}
    e = read("interactions")
    assert e.count() == len(seconds) and read("user_map").count() == 20 and read("items").count() == 15 and read("merchants").count() == 720
    assert [r.event_id for r in e.orderBy("ts", "event_id").collect()] == list(range(len(seconds)))
    items = {r.source_item_id: r for r in read("items").collect()}
    assert [items[900 + k].root_category_id for k in range(4)] == [0, 0, 0, 9] and not items[900].is_available and items[901].is_available
    assert items[901].available_from == items[901].first_available and items[900].available_from == items[900].first_interaction
    assert all(r.merchant_id // 120 == r.vertical for r in read("items").collect())
    first = e.groupBy("user_id", "item_id").agg(F.count_if(F.col("event_type") == 9).alias("n")).agg(F.max("n")).first()[0]
    assert first <= 1 and e.where("event_type = 10").count() > 0
    s = read("splits")
    assert sessions.leakage_report(s).where("NOT ok").count() == 0 and read("sessions").agg(F.sum("n_events")).first()[0] == len(seconds)
    for job in ("features", "baselines", "ranker", "experiment", "drift"):
        cli.main([job, "--out", out])
    shown = capsys.readouterr().out
    assert "item_cf" in shown and ("tree_ranker" in shown or "fused" in shown)
    with pytest.raises(ValueError, match="version"):
        T.read_features(spark, f"{out}/features", "2", ["event_id"])
    with pytest.raises(SystemExit):
        cli.main(["build", "--out", out])


def test_caps_cores_and_unknown_events(spark, tmp_path):
    rows = [(T0 + dt.timedelta(minutes=7 * n), n % 4, n % 6, 3) for n in range(120)]
    events = spark.createDataFrame(rows, EVENTS)
    none = spark.createDataFrame([], "ts timestamp, item_id long, property string, value string")
    tree = spark.createDataFrame([], "category_id int, parent_id int")
    got = {r.table: r.rows for r in jobs.build_dataset(spark, events, none, tree, f"{tmp_path}/a", 5, 5, (3, 2)).collect()}
    assert got["users"] <= 3 and got["items"] == 2
    assert spark.read.parquet(f"{tmp_path}/a/items").where("category_id <> -1 OR is_available").count() == 0
    with pytest.raises(ValueError, match="empty"):
        jobs.build_dataset(spark, events, none, tree, f"{tmp_path}/b", 500, 5)
    (tmp_path / "odd.csv").write_text("timestamp,visitorid,event,itemid,transactionid\n5,1,swipe,2,\n")
    with pytest.raises(Exception, match="unknown event"):
        T.read_events(spark, f"{tmp_path}/odd.csv").collect()


def test_lists_of_global_baselines(spark):
    rng = random.Random(8)
    rows = [(T0 + dt.timedelta(hours=n), rng.randrange(6), min(rng.randrange(25), rng.randrange(25)), rng.choice([3, 6, 9])) for n in range(200)]
    rows += [(T0 + dt.timedelta(hours=n), 99, n, 3) for n in range(25)]  # has seen everything
    train = spark.createDataFrame(rows, EVENTS)
    lists = jobs.baseline_lists(train, 4)
    seen = {(u, i) for _, u, i, _ in rows}
    scores = {r.item_id: r.score for r in jobs.popularity.decayed(train).collect()}
    for u in range(6):
        want = sorted((i for i in scores if (u, i) not in seen), key=lambda i: (-round(scores[i], 6), i))[:4]
        assert [r.item_id for r in lists["popularity"].where(F.col("user_id") == u).orderBy("rank").collect()] == want
    assert all(df.where("user_id = 99").count() == 0 for df in lists.values())


def test_recommend_rank_and_importance(spark):
    scores = spark.createDataFrame([(1, 5, 0.5), (1, 6, 0.9), (1, 7, 0.9), (1, 8, 1.0)], "user_id long, item_id long, score double")
    only, seen = spark.createDataFrame([(5,), (6,), (7,)], "item_id long"), spark.createDataFrame([(1, 6)], "user_id long, item_id long")
    assert [r.item_id for r in R.recommend(scores, 3, seen, only).orderBy("rank").collect()] == [7, 5]
    assert R.recommend(scores, 3, None, only.limit(0)).count() == 0
    data = scores.withColumnRenamed("score", "fused").withColumn("x", -F.col("item_id"))
    assert [r.item_id for r in ranking.rank_candidates(data, None, 2).orderBy("rank").collect()] == [8, 6]
    assert [r.item_id for r in ranking.rank_candidates(data, {"x": 2.0}, 2).orderBy("rank").collect()] == [5, 6]
    shares = {r.feature: r.importance for r in ranking.importance(data, {"fused": 1.0, "x": 0.0}).collect()}
    assert shares == {"fused": 1.0, "x": 0.0}


def test_roots_and_ratings(spark):
    tree = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 3), (5, None), (6, 77)], "category_id int, parent_id int")
    assert {r.category_id: r.root for r in ingest.category_roots(tree).collect()} == {1: 2, 2: 2, 3: 2, 4: 2, 5: 5, 6: 77}
    prices = augment.item_prices(spark.range(300).select(F.col("id").alias("item_id"), (F.col("id") % 6).cast("int").alias("vertical")))
    low, high, mean = prices.agg(F.min("base_rating"), F.max("base_rating"), F.avg("base_rating")).first()
    assert 0 < low and high <= 5 and 3.6 < mean < 4.2 and prices.agg(F.min("price")).first()[0] >= augment.MIN_PRICE


def test_drift_windows_sort_only_the_seconds_they_need(spark):
    rng = random.Random(9)
    e = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=rng.randrange(300))) for i in range(2000)], "event_id long, ts timestamp").repartition(8)
    e = e.unionByName(spark.createDataFrame([(5000, None), (5001, None)], "event_id long, ts timestamp"))
    for rows in (1, 40, 1999, 3000):
        last, first = jobs.drift_windows(e, e, rows)
        assert last.collect() == e.orderBy(F.desc("ts"), F.desc("event_id")).limit(rows).collect()
        assert first.collect() == e.orderBy("ts", "event_id").limit(rows).collect()
        if rows == 40:
            for window in (last, first):
                at = window._jdf.queryExecution().optimizedPlan().toString()
                assert "Filter" in at and at.index("Sort") < at.index("Filter")
    assert jobs.drift_windows(e.limit(0), e, 5)[0].count() == 0
