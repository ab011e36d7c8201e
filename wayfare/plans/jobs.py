"""Whole jobs: the tables from raw logs, their features, the baselines' results, an experiment, a drift report.

Each job reads and writes Parquet tables below one folder; fan-out points are written once and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.distributed import row_numbers, running_sum
from wayfare.operators import asof, augment, drift, evaluate, ingest, popularity, ranking, sessions
from wayfare.operators import retrieval as R
from wayfare.sources.tables import checkpointed, read_features, write_features, write_json_row, write_table

TABLES = ("interactions", "splits", "items", "users", "merchants", "sessions", "item_map", "user_map")
DRIFT_ROWS = 250_000
FEATURE_VERSION = "1"


def item_base(item_map: DataFrame, changes: DataFrame, tree: DataFrame) -> DataFrame:
    """item_map with category_id, root_category_id, first_available and is_available from the property log.

    Items without a category get -1, items without an availability record are not available.
    """
    category = ingest.latest_value(changes.where("property = 'categoryid'"), "item_id", "value").select(F.col("item_id").alias("source_item_id"), F.col("latest").alias("category_id"))
    available = ingest.availability(changes.where("property = 'available'"), "item_id", "value").withColumnRenamed("item_id", "source_item_id")
    base = item_map.join(category, "source_item_id", "left").join(available, "source_item_id", "left").join(ingest.category_roots(tree), "category_id", "left")
    return base.select("item_id", "source_item_id", F.coalesce("category_id", F.lit(-1)).alias("category_id"), F.coalesce("root", F.lit(-1)).alias("root_category_id"), "first_available", F.coalesce("is_available", F.lit(False)).alias("is_available"))


def item_table(item_map: DataFrame, changes: DataFrame, tree: DataFrame, firsts: DataFrame, last: DataFrame, merchants: DataFrame, seed: int = augment.SEED) -> DataFrame:
    """One row for each item: latest category and its root, availability, vertical, merchant, price, rating, first use, cold flag.

    item_map: (source_item_id, item_id); changes: (ts, item_id, property, value) by source id; tree: (category_id,
    parent_id); firsts: (item_id, first_interaction); last: one row (last).
    """
    base = checkpointed(item_base(item_map, changes, tree), "item-base")
    verticals = augment.root_verticals(base.groupBy(F.col("root_category_id").alias("root")).agg(F.count(F.lit(1)).alias("n")))
    base = base.join(verticals.withColumnRenamed("root", "root_category_id"), "root_category_id")
    owned = augment.item_merchants(base, merchants).select("item_id", "merchant_id")
    priced = augment.item_prices(base, seed).select("item_id", "price", "base_rating")
    full = base.join(owned, "item_id").join(priced, "item_id").join(firsts, "item_id", "left")
    full = full.withColumn("available_from", F.coalesce("first_available", "first_interaction")).withColumn("available_until", F.lit(None).cast("timestamp"))
    return ingest.cold_flags(full, last)


def build_dataset(spark: SparkSession, events: DataFrame, changes: DataFrame, tree: DataFrame, out: str, min_user: int = 5, min_item: int = 5, caps: tuple[int, int] | None = None, gap_minutes: int = sessions.GAP_MINUTES, max_events: int = sessions.MAX_EVENTS) -> DataFrame:
    """Write TABLES and metadata below `out`; returns (table, rows).

    events: (ts, user_id, item_id, event_type) with source ids.  Rows are deduplicated by second, reduced to their
    core, capped if asked, given dense ids, enriched, sessionised and split; a split that leaks raises.
    """
    clean = ingest.dedup_seconds(events.select("ts", "user_id", "item_id", "event_type"), "ts")
    core = ingest.k_core(clean, min_user, min_item)
    core = checkpointed(ingest.cap_presets(core, *caps) if caps else core, "core")
    for who in ("user", "item"):
        ids = ingest.dense_ids(core, f"{who}_id").select(F.col(f"{who}_id").alias(f"source_{who}_id"), F.col("index").alias(f"{who}_id"))
        write_table(ids, f"{out}/{who}_map")
    user_map, item_map = spark.read.parquet(f"{out}/user_map"), spark.read.parquet(f"{out}/item_map")
    e = core.select("ts", "event_type", F.col("user_id").alias("source_user_id"), F.col("item_id").alias("source_item_id"))
    e = e.join(user_map, "source_user_id").join(item_map, "source_item_id").select("ts", "user_id", "item_id", "event_type")
    e = row_numbers(e, ["ts", "user_id", "item_id", "event_type"], "event_id").withColumn("event_id", F.col("event_id") - 1)
    e = checkpointed(e, "numbered")

    last = e.agg(F.max("ts").alias("last"))
    write_table(augment.merchants(spark), f"{out}/merchants")
    firsts = e.groupBy("item_id").agg(F.min("ts").alias("first_interaction"))
    write_table(item_table(item_map, changes, tree, firsts, last, spark.read.parquet(f"{out}/merchants")), f"{out}/items")
    signup = e.groupBy("user_id").agg(F.min("ts").alias("first_interaction"))
    people = augment.user_attributes(user_map).join(user_map, "user_id").join(signup, "user_id", "left")
    people = ingest.cold_flags(people, last).select("user_id", "source_user_id", "region_id", F.col("device").alias("device_pref"), F.col("first_interaction").alias("signup_at"), "is_cold")
    write_table(people, f"{out}/users")

    items = spark.read.parquet(f"{out}/items").select("item_id", "vertical", "merchant_id", F.col("price").alias("price_at_event"))
    users = spark.read.parquet(f"{out}/users").select("user_id", "region_id", F.col("device_pref").alias("device"))
    e = e.join(items, "item_id").join(users, "user_id")
    e = sessions.sessionize(sessions.repeat_purchases(e), gap_minutes, max_events).drop("session_nr")
    write_table(e, f"{out}/interactions")
    e = spark.read.parquet(f"{out}/interactions")
    write_table(sessions.session_table(e), f"{out}/sessions")
    write_table(sessions.temporal_split(e), f"{out}/splits", "split")
    split = spark.read.parquet(f"{out}/splits")
    if leaks := [(r.earlier, r.later) for r in sessions.leakage_report(split).where("NOT ok").collect()]:
        raise ValueError(f"later events in earlier windows: {leaks}")
    counts = None
    for name in TABLES:
        one = spark.read.parquet(f"{out}/{name}").agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
        counts = one if counts is None else counts.unionByName(one)
    counts = checkpointed(counts, "counts")
    write_json_row(counts.unionByName(split.groupBy(F.concat(F.lit("split_"), "split").alias("table")).agg(F.count(F.lit(1)).alias("rows"))), f"{out}/metadata")
    return counts


def build_features(spark: SparkSession, out: str, version: str = FEATURE_VERSION) -> DataFrame:
    """Point-in-time features of all retained splits, computed once over their union; written by split."""
    rows = asof.asof_features(spark.read.parquet(f"{out}/splits"))
    write_features(rows.select("event_id", "user_id", "item_id", "ts", "event_type", "split", *asof.FEATURES), f"{out}/features", version)
    return read_features(spark, f"{out}/features", version, ["event_id", "user_id", "item_id", "ts", "event_type", *asof.FEATURES])


def baseline_lists(train: DataFrame, k: int = 20) -> dict[str, DataFrame]:
    """(user_id, item_id, score, rank) of unseen items for each baseline; global lists are cut before they meet the users."""
    out = {}
    for name, scores in (("popularity", popularity.decayed(train)), ("trending", popularity.trending(train))):
        out[name] = R.global_unseen(scores.withColumn("score", F.round("score", 6)), train, k)
    m = checkpointed(R.user_item(train), "matrix")  # read several times
    out["item_cf"] = R.top_k(R.without_seen(R.cf_scores(m, R.item_similarity(m)).withColumn("score", F.round("score", 6)), train), k)
    return out


def train_baselines(spark: SparkSession, out: str, k: int = 20) -> DataFrame:
    """(model, users, metrics): every baseline's lists against what users of the test window did anew; lists and results are written."""
    split = spark.read.parquet(f"{out}/splits")
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    truth = checkpointed(evaluate.novel_truth(test, train), "truth")
    results = None
    for name, lists in baseline_lists(train, k).items():
        write_table(lists.select("user_id", "item_id", "score", "rank"), f"{out}/lists/{name}")
        per = evaluate.user_metrics(spark.read.parquet(f"{out}/lists/{name}"), truth).withColumn("model", F.lit(name))
        results = per if results is None else results.unionByName(per)
    write_table(results, f"{out}/user_metrics")
    results = spark.read.parquet(f"{out}/user_metrics")
    names = [c for c in results.columns if c not in ("user_id", "model")]
    table = results.groupBy("model").agg(F.count(F.lit(1)).alias("users"), *[F.round(F.avg(c), 6).alias(c) for c in names])
    write_json_row(table, f"{out}/results")
    return table


RANKER_SOURCES = ["item_cf", "popularity", "trending"]
RANKER_FEATURES = ["fused", "n_sources", *RANKER_SOURCES, "item_events", "user_events"]


def train_ranker(spark: SparkSession, out: str, k: int = 20) -> DataFrame:
    """(model, users, metrics): the baselines' lists fused, and ranked by trees fitted on what the validation window did anew.

    The model's lists and its gains are written.  Without a positive to learn from the fused score ranks.
    """
    split = spark.read.parquet(f"{out}/splits")
    train, validation, test = (split.where(F.col("split") == s) for s in ("train", "validation", "test"))
    lists = None
    for name in RANKER_SOURCES:
        one = spark.read.parquet(f"{out}/lists/{name}").withColumn("source", F.lit(name))
        lists = one if lists is None else lists.unionByName(one)
    cand = R.fuse(lists, RANKER_SOURCES, expected=lists.count()).join(R.source_scores(lists, RANKER_SOURCES), ["user_id", "item_id"])
    cand = cand.join(asof.item_state(train).select("item_id", F.col("events").alias("item_events")), "item_id", "left")
    cand = checkpointed(cand.join(asof.user_state(train).select("user_id", F.col("events").alias("user_events")), "user_id", "left"), "candidates")
    fit = checkpointed(ranking.ranking_dataset(cand, evaluate.novel_truth(validation, train), RANKER_FEATURES), "ranking")
    name = "fused"
    if fit.isEmpty():
        top = ranking.rank_candidates(cand, None, k)
    else:
        name, model = "tree_ranker", ranking.fit_trees(fit, RANKER_FEATURES)
        top = ranking.tree_rank(cand, model, RANKER_FEATURES, k)
        write_json_row(spark.createDataFrame(ranking.gain_importance(model, RANKER_FEATURES), "feature string, importance double"), f"{out}/importance")
    write_table(top.select("user_id", "item_id", "score", "rank"), f"{out}/lists/{name}")
    per = checkpointed(evaluate.user_metrics(spark.read.parquet(f"{out}/lists/{name}"), evaluate.novel_truth(test, train)), "ranker-metrics")
    names = [c for c in per.columns if c != "user_id"]
    return per.agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("users"), *[F.round(F.avg(c), 6).alias(c) for c in names])


def run_experiment(spark: SparkSession, out: str, control: str, treatment: str, metric: str = "ndcg_10", samples: int = 2000) -> DataFrame:
    """One row: lift of treatment over control on their shared users, its interval and p-value, and whether it is significant."""
    per = spark.read.parquet(f"{out}/user_metrics")
    pairs = checkpointed(evaluate.paired(per.where(F.col("model") == control), per.where(F.col("model") == treatment), metric), "pairs")
    one = evaluate.lift(pairs).join(F.broadcast(evaluate.bootstrap(pairs, samples)))
    one = one.withColumn("significant", (F.col("lower") > 0) | (F.col("upper") < 0))
    write_json_row(one, f"{out}/experiment")
    return one


def drift_windows(reference: DataFrame, current: DataFrame, rows: int = DRIFT_ROWS) -> tuple[DataFrame, DataFrame]:
    """The last rows of the reference and the first of the current window, by (ts, event_id).

    Rows of each second are counted first, so that only the seconds that hold these rows are sorted: each part of a
    table would send up to `rows` of its own to one task.
    """
    return last_rows(reference, rows, True), last_rows(current, rows, False)


def last_rows(df: DataFrame, rows: int, last: bool) -> DataFrame:
    """The last or first `rows` rows by (ts, event_id); rows without a ts come first."""
    second = F.coalesce(F.unix_seconds(F.col("ts").cast("timestamp")), F.lit(-(2**62)))
    place = -second if last else second
    counts = df.groupBy(place.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    upto = running_sum(counts, ["at"], F.col("n"), "upto").where(F.col("upto") - F.col("n") < rows).agg(F.max("at")).first()[0]
    near = df.where(place <= upto) if upto is not None else df
    order = [F.desc("ts"), F.desc("event_id")] if last else ["ts", "event_id"]
    return near.orderBy(*order).limit(rows)


def monitor_drift(spark: SparkSession, out: str, rows: int = DRIFT_ROWS, version: str = FEATURE_VERSION) -> DataFrame:
    """Drift of every feature between the end of training and the beginning of the test window."""
    f = read_features(spark, f"{out}/features", version, ["event_id", "ts", *asof.FEATURES])
    report = drift.detect_drift(*drift_windows(f.where("split = 'train'"), f.where("split = 'test'"), rows), list(asof.FEATURES))
    write_json_row(report, f"{out}/drift")
    return report
