"""Queries over CSV sources, sinks, whole jobs, and the compositions of retrieval, ranking and experiments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfare.operators import asof, drift, evaluate, ranking, trees
from wayfare.operators import retrieval as R
from wayfare.plans import jobs
from wayfare.plans.cleaning import HISTORY_SQL, SPLIT
from wayfare.plans.features import asof_sql, rounded_features, splits
from wayfare.plans.quality import DRIFT_FEATURES, RECS_SQL, drift_features, drift_sql, recommendations
from wayfare.plans.registry import ORACLES, query
from wayfare.plans.retrieval import _FEATURES, _LINEAR, CF_SQL, FUSED_SQL, RANKED_SQL, SOURCES, _shelf, candidates, cf, dataset, fused, labelled, listed, ranked_sources
from wayfare.sources.tables import BEHAVIOUR_SQL as A
from wayfare.sources.tables import behaviour, checkpointed, code_map, read_category_tree, read_events, read_features, read_item_properties, scratch, table, write_features


@query("src1_csv_events", f"WITH {A} SELECT date_trunc('millisecond', ts) AS ts, user_id, item_id::bigint AS item_id, event_type, CASE WHEN event_type = 9 THEN event_id END AS transaction_id FROM a WHERE event_type IN (3, 6, 9)")
def csv_events(spark, d):
    e = behaviour(spark, d).where("event_type IN (3, 6, 9)")
    name = code_map({3: "view", 6: "addtocart", 9: "transaction"})[F.col("event_type")]
    raw = e.select(F.unix_millis("ts").alias("timestamp"), F.col("user_id").alias("visitorid"), name.alias("event"), F.col("item_id").cast("long").alias("itemid"), F.when(F.col("event_type") == 9, F.col("event_id").cast("double")).alias("transactionid"))
    path = scratch(spark, "csv-events")
    raw.write.option("header", True).csv(path)
    return read_events(spark, path)


_PROPERTY = "CASE l_linenumber % 3 WHEN 0 THEN 'categoryid' WHEN 1 THEN 'available' ELSE 'color' END"


@query("src2_csv_properties", f"SELECT * FROM (SELECT l_shipdate AS ts, l_partkey AS item_id, {_PROPERTY} AS property, l_linenumber::varchar AS value FROM lineitem) WHERE property IN ('categoryid', 'available')")
def csv_properties(spark, d):
    rows = table(spark, d, "lineitem").select(F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("timestamp"), F.col("l_partkey").alias("itemid"), F.expr(_PROPERTY).alias("property"), F.col("l_linenumber").cast("string").alias("value"))
    paths = [scratch(spark, f"csv-properties-{part}") for part in (0, 1)]
    for part, path in enumerate(paths):
        rows.where(F.col("value").cast("int") % 2 == part).write.option("header", True).csv(path)
    return read_item_properties(spark, *paths)


@query("src3_csv_tree", "SELECT n_nationkey AS category_id, CASE WHEN n_regionkey > 0 THEN n_regionkey + 100 END AS parent_id FROM nation")
def csv_tree(spark, d):
    path = scratch(spark, "csv-tree")
    table(spark, d, "nation").select(F.col("n_nationkey").alias("categoryid"), F.when(F.col("n_regionkey") > 0, (F.col("n_regionkey") + 100).cast("double")).alias("parentid")).write.option("header", True).csv(path)
    return read_category_tree(spark, path)


@query("snk2_feature_sink", f"WITH {SPLIT} SELECT split, count(*) AS rows, count(DISTINCT user_id) AS users FROM s GROUP BY 1")
def feature_sink(spark, d):
    path = scratch(spark, "features")
    write_features(asof.asof_features(splits(spark, d)[0]), path, "1")
    back = read_features(spark, path, "1", ["user_id", *asof.FEATURES])
    return back.groupBy(F.col("split").cast("string").alias("split")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("user_id").alias("users"))


_TREE = [(1, 101), (2, 101), (3, 102), (4, 102), (5, 103), (6, 103), (7, None), (101, 200), (102, 200)]


@query("jn1_item_attributes", f"""WITH {HISTORY_SQL}, k AS (SELECT l_partkey AS item_id, try_cast(last(l_linenumber::varchar ORDER BY l_shipdate, l_linenumber::varchar) AS int) AS category_id FROM lineitem GROUP BY 1),
f AS (SELECT item_id, min(ts) FILTER (value = '1') AS first_available, coalesce(try_cast(last(value ORDER BY ts, coalesce(try_cast(value AS int), 0)) AS int), 0) = 1 AS is_available FROM h GROUP BY 1)
SELECT p_partkey AS item_id, coalesce(category_id, -1) AS category_id, CASE WHEN category_id <= 4 THEN 200 WHEN category_id <= 6 THEN 103 WHEN category_id = 7 THEN 7 ELSE -1 END AS root_category_id, first_available, coalesce(is_available, false) AS is_available
FROM part LEFT JOIN k ON k.item_id = p_partkey LEFT JOIN f ON f.item_id = p_partkey""")
def item_attributes(spark, d):
    lines = table(spark, d, "lineitem").withColumn("ts", F.col("l_shipdate").cast("timestamp"))
    flag = F.when(F.col("l_returnflag") == "A", "1").when(F.col("l_returnflag") == "R", "none").otherwise("0")
    category = lines.select("ts", F.col("l_partkey").alias("item_id"), F.lit("categoryid").alias("property"), F.col("l_linenumber").cast("string").alias("value"))
    changes = category.unionByName(lines.select("ts", F.col("l_partkey").alias("item_id"), F.lit("available").alias("property"), flag.alias("value")))
    item_map = table(spark, d, "part").select(F.col("p_partkey").alias("source_item_id"), F.col("p_partkey").alias("item_id"))
    return jobs.item_base(item_map, changes, spark.createDataFrame(_TREE, "category_id int, parent_id int")).drop("source_item_id")


@query("jn14_latest_features", f"""WITH {SPLIT}, l AS (SELECT last(event_id ORDER BY ts, event_id) AS event_id FROM tr GROUP BY user_id)
SELECT f.* FROM ({asof_sql()}) f JOIN l USING (event_id)""")
def latest_features(spark, d):
    """The features at each user's last training event."""
    f = asof.asof_features(splits(spark, d)[0]).where("split = 'train'")
    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return rounded_features(f.withColumn("_n", last).where("_n = 1"), ["event_id"])


@query("dr7_drift_windows", drift_sql("rw", "cw", ", rw AS (SELECT * FROM tr ORDER BY ts DESC, event_id DESC LIMIT 90), cw AS (SELECT * FROM te ORDER BY ts, event_id LIMIT 90)"))
def drift_of_windows(spark, d):
    _, train, test = splits(spark, d)
    reference, current = jobs.drift_windows(train, test, 90)
    return drift.detect_drift(drift_features(reference), drift_features(current), list(DRIFT_FEATURES))


@query("rr4_rerank", ORACLES["rr3_diversity"])
def rerank(spark, d):
    return ranking.rerank(_shelf(spark, d), 15, 45, 0.1, 0.2)


@query("fu2_fuse_scores", f"""WITH {SPLIT}, {RANKED_SQL}, y AS (SELECT user_id, item_id, round(sum(1.0::double / (60 + rank)), 9) AS fused, count(*) AS n_sources, min(s * 1000 + rank) AS f FROM rk GROUP BY 1, 2)
SELECT user_id, item_id, fused, n_sources, row_number() OVER (PARTITION BY user_id ORDER BY fused DESC, f, item_id) AS position FROM y""")
def fuse_scores(spark, d):
    """Fusion from scores alone: nothing is excluded, nothing is cut."""
    train = splits(spark, d)[1]
    out = R.fuse_scores(ranked_sources(train).drop("rank"), SOURCES, expected=listed(train, len(SOURCES)))
    return out.select("user_id", "item_id", "fused", "n_sources", F.col("position").cast("long").alias("position"))


@query("tk1_recommend", f"""WITH {SPLIT}, {CF_SQL}, hist AS (SELECT DISTINCT user_id, item_id FROM tr),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM cf WHERE item_id IN (SELECT item_id FROM tr WHERE event_type = 9) AND (user_id, item_id) NOT IN (SELECT user_id, item_id FROM hist)) SELECT user_id, item_id, score, rank FROM r WHERE rank <= 10""")
def recommend(spark, d):
    train = splits(spark, d)[1]
    candidates = train.where("event_type = 9").select("item_id").distinct()
    return R.recommend(cf(train), 10, train, candidates).select("user_id", "item_id", "score", F.col("rank").cast("long").alias("rank"))


@query("sv3_fused_fallback", f"WITH {SPLIT}, {FUSED_SQL} SELECT * FROM (SELECT user_id, item_id, fused AS score, row_number() OVER (PARTITION BY user_id ORDER BY fused DESC, item_id) AS rank FROM fu) WHERE rank <= 10")
def fused_fallback(spark, d):
    """Without a ranker the fused score decides."""
    out = ranking.rank_candidates(fused(splits(spark, d)[1]), None, 10)
    return out.select("user_id", "item_id", "score", F.col("rank").cast("long").alias("rank"))


@query("sv6_stage_trace", f"""WITH {SPLIT}, {FUSED_SQL}, z AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id % 8 ORDER BY position) AS m FROM fu),
o AS (SELECT * FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY position) AS p FROM z WHERE m <= 2) WHERE p <= 10)
SELECT 'retrieve' AS stage, count(*) AS rows, count(DISTINCT user_id) AS users FROM rk UNION ALL SELECT 'fuse', count(*), count(DISTINCT user_id) FROM fu UNION ALL SELECT 'rerank', count(*), count(DISTINCT user_id) FROM o""")
def stage_trace(spark, d):
    from wayfare.plans.retrieval import recommend_all

    train = splits(spark, d)[1]
    out = None
    for stage, df in (("retrieve", ranked_sources(train)), ("fuse", fused(train)), ("rerank", recommend_all(spark, d))):
        one = df.agg(F.lit(stage).alias("stage"), F.count(F.lit(1)).alias("rows"), F.countDistinct("user_id").alias("users"))
        out = one if out is None else out.unionByName(one)
    return out


@query("ab2_shared_users", f"WITH {SPLIT}, {RECS_SQL} SELECT DISTINCT user_id FROM tt WHERE user_id IN (SELECT user_id FROM pr) AND user_id IN (SELECT user_id FROM cr)")
def shared_users(spark, d):
    train, test, p, c = recommendations(spark, d)
    return evaluate.shared_users(p, c, evaluate.novel_truth(test, train))


@query("rk5_importance", f"""WITH x AS ({ORACLES['rk2_ranking_dataset']}), v AS (SELECT unnest({list(_LINEAR)}) AS feature, unnest([{', '.join(f'abs({w})::double * stddev_pop(coalesce({c}, 0)::double)' for c, w in _LINEAR.items())}]) AS v FROM x)
SELECT feature, round(v / sum(v) OVER (), 5) AS importance FROM v""")
def importance(spark, d):
    return ranking.importance(dataset(spark, d).select("user_id", *_FEATURES), _LINEAR).withColumn("importance", F.round("importance", 5))


def _trees(spark, d):
    data = checkpointed(dataset(spark, d), "ranking")
    return data, ranking.fit_trees(data, _FEATURES)


@query("rk3_tree_ranker")
def tree_ranker(spark, d):
    data, model = _trees(spark, d)
    return ranking.tree_rank(data, model, _FEATURES, 10).select("user_id", "item_id", "label", "score", "rank")


@query("rk4_tree_explanations")
def tree_explanations(spark, d):
    data, model = _trees(spark, d)
    out = ranking.explain_trees(ranking.tree_rank(data, model, _FEATURES, 5), model, _FEATURES, 2, scratch(spark, "trees"))
    return out.select("user_id", "item_id", "base", F.posexplode("reasons").alias("place", "r")).select("user_id", "item_id", "base", "place", "r.feature", "r.value")


@query("rk5_gain_importance")
def gain_importance(spark, d):
    _, model = _trees(spark, d)
    return spark.createDataFrame(ranking.gain_importance(model, _FEATURES), "feature string, importance double")


def listwise(spark, d):
    """(held-out rows, model): fitted on the validation window's labels, held out is the test window; both label the same candidates, made once."""
    every, train, cand = candidates(spark, d)
    cand = checkpointed(cand, "candidates")
    fit = checkpointed(labelled(every, train, cand, "validation"), "ranking")
    return labelled(every, train, cand, "test"), trees.fit_listwise(fit, _FEATURES)


def _best(rows, model, k):
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id"))
    return rows.withColumn("score", trees.scores(model)).withColumn("rank", rank).where(F.col("rank") <= k)


@query("rk3_listwise_ranker")
def listwise_ranker(spark, d):
    """The held-out window's candidates in the order of listwise boosted trees."""
    held, model = listwise(spark, d)
    return _best(held, model, 10).select("user_id", "item_id", "label", "score", "rank")


@query("rk4_shapley_values")
def shapley_values(spark, d):
    """The three largest exact Shapley values of each user's five best candidates; with base and rest they add up to the score."""
    held, model = listwise(spark, d)
    out = trees.explain(_best(held, model, 5), model, 3)
    return out.select("user_id", "item_id", "base", "rest", F.posexplode("reasons").alias("place", "r")).select("user_id", "item_id", "base", "rest", "place", "r.feature", "r.value")


@query("rk5_listwise_gains")
def listwise_gains(spark, d):
    """Shares of all splits' gain, of the saved and loaded model."""
    path = scratch(spark, "forest")
    trees.save_forest(spark, listwise(spark, d)[1], path)
    return spark.createDataFrame(trees.gains(trees.load_forest(spark, path)), "feature string, importance double")


def _job_sql(rounds: int = 8) -> str:
    cores = ", ".join(
        f"k{i + 1} AS (SELECT * FROM k{i} WHERE user_id IN (SELECT user_id FROM k{i} GROUP BY 1 HAVING sum(n) >= 5) AND item_id IN (SELECT item_id FROM k{i} GROUP BY 1 HAVING sum(n) >= 5))" for i in range(rounds)
    )
    return f"""WITH {A}, d0 AS (SELECT * FROM (SELECT ts, user_id, item_id, event_type, row_number() OVER (PARTITION BY user_id, item_id, event_type, date_trunc('second', ts) ORDER BY ts) AS n FROM a) WHERE n = 1),
k0 AS (SELECT user_id, item_id, count(*) AS n FROM d0 GROUP BY 1, 2), {cores}, c AS (SELECT d0.* EXCLUDE (n) FROM d0 JOIN k{rounds} USING (user_id, item_id)),
l AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM c),
q AS (SELECT floor(quantile_cont(epoch_us(ts), 0.70))::bigint AS t1 FROM c), known AS (SELECT DISTINCT user_id FROM c, q WHERE epoch_us(ts) <= t1)
SELECT unnest(['interactions', 'splits', 'items', 'users', 'merchants', 'sessions', 'item_map', 'user_map']) AS "table",
  unnest([(SELECT count(*) FROM c), (SELECT count(*) FROM c WHERE user_id IN (FROM known)), (SELECT count(DISTINCT item_id) FROM c), (SELECT count(DISTINCT user_id) FROM c), 720,
          (SELECT count(*) FROM l WHERE gap IS NULL OR gap > 1800000000), (SELECT count(DISTINCT item_id) FROM c), (SELECT count(DISTINCT user_id) FROM c)]) AS rows"""


def _build(spark, d, out):
    lines = table(spark, d, "lineitem").withColumn("ts", F.col("l_shipdate").cast("timestamp"))
    category = lines.select("ts", (F.col("l_partkey") % 100).alias("item_id"), F.lit("categoryid").alias("property"), F.col("l_linenumber").cast("string").alias("value"))
    flags = lines.select("ts", (F.col("l_partkey") % 100).alias("item_id"), F.lit("available").alias("property"), F.when(F.col("l_returnflag") == "R", "0").otherwise("1").alias("value"))
    return jobs.build_dataset(spark, behaviour(spark, d), category.unionByName(flags), spark.createDataFrame(_TREE, "category_id int, parent_id int"), out)


@query("job_build_dataset", _job_sql())
def job_build(spark, d):
    return _build(spark, d, scratch(spark, "dataset"))


@query("job_experiment")
def job_experiment(spark, d):
    """All jobs in turn: tables, features, baselines, drift, and an experiment of two baselines."""
    out = scratch(spark, "dataset")
    _build(spark, d, out)
    jobs.build_features(spark, out)
    jobs.train_baselines(spark, out)
    jobs.monitor_drift(spark, out)
    return jobs.run_experiment(spark, out, "popularity", "item_cf")
