"""Queries over point-in-time features and popularity."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfare.functions.distributed import row_numbers
from wayfare.operators import asof, evaluate, popularity, sessions
from wayfare.plans.cleaning import SPLIT, WEIGHT_SQL
from wayfare.plans.registry import query
from wayfare.sources.tables import BEHAVIOUR_SQL as A
from wayfare.sources.tables import ORDERS_SQL as B
from wayfare.sources.tables import behaviour, kept, orders_as_events, scratch


def splits(spark, d):
    """(all, train, test) of a folder's events; the split rows lie in the shared folder under the state of the events' files."""
    s = kept(spark, f"{d}/events.parquet", "split-events", lambda: sessions.temporal_split(behaviour(spark, d)))
    return s, s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split")


def rounded_features(df, keys):
    return df.select(*keys, *[F.round(F.col(c) + 1e-9, 6).alias(c) if t == "double" else F.col(c).cast("long").alias(c) for c, t in df.select(*asof.FEATURES).dtypes])


_DAYS = "86400000000.0::double"
_ASOF = f"""WITH {SPLIT}, e AS (SELECT *, epoch_us(ts) AS t, CASE WHEN price_at_event > 0 THEN price_at_event END AS p, event_type IN (9, 10) AS c FROM s),
u AS (SELECT x.event_id, count(y.t) AS user_event_count, count(*) FILTER (y.c) AS user_purchase_count, count(DISTINCT y.item_id) AS user_distinct_items, (x.t - max(y.t)) / {_DAYS} AS user_days_since_last,
  (x.t - min(y.t)) / {_DAYS} AS user_tenure_days, avg(y.p) AS user_avg_interaction_price, avg(y.p) FILTER (y.c) AS user_avg_order_value, count(*) FILTER (y.item_id = x.item_id) AS ui_prior_events,
  count(*) FILTER (y.item_id = x.item_id AND y.c) AS ui_prior_purchases, (x.t - max(y.t) FILTER (y.item_id = x.item_id)) / {_DAYS} AS ui_days_since_last,
  count(*) FILTER (y.vertical = x.vertical) AS nv, count(*) FILTER (y.merchant_id = x.merchant_id) AS nm
  FROM e x LEFT JOIN e y ON y.user_id = x.user_id AND y.t < x.t GROUP BY x.event_id, x.t),
i AS (SELECT x.event_id, count(y.t) AS item_event_count, count(*) FILTER (y.c) AS item_purchase_count, count(DISTINCT y.user_id) AS item_distinct_users, (x.t - max(y.t)) / {_DAYS} AS item_days_since_last,
  (x.t - min(y.t)) / {_DAYS} AS item_age_days FROM e x LEFT JOIN e y ON y.item_id = x.item_id AND y.t < x.t GROUP BY x.event_id, x.t)
SELECT event_id, user_event_count, user_purchase_count, round(user_purchase_count / nullif(user_event_count, 0), 6) AS user_conversion_rate, user_distinct_items, round(user_days_since_last, 6) AS user_days_since_last,
  round(user_tenure_days, 6) AS user_tenure_days, round(user_avg_interaction_price, 6) AS user_avg_interaction_price, round(user_avg_order_value, 6) AS user_avg_order_value, item_event_count, item_purchase_count,
  round(item_purchase_count / nullif(item_event_count, 0), 6) AS item_conversion_rate, item_distinct_users, round(item_days_since_last, 6) AS item_days_since_last, round(item_age_days, 6) AS item_age_days,
  ui_prior_events, ui_prior_purchases, round(ui_days_since_last, 6) AS ui_days_since_last, round(nv / nullif(user_event_count, 0), 6) AS user_category_affinity, round(nm / nullif(user_event_count, 0), 6) AS user_merchant_affinity,
  round(CASE WHEN user_avg_interaction_price > 0 THEN coalesce(price_at_event, 0) / user_avg_interaction_price END, 6) AS price_ratio_to_user_avg
FROM e JOIN u USING (event_id) JOIN i USING (event_id)"""


def asof_sql() -> str:
    """Means of prices in cents end in exact halves; a nudge makes both sides round them alike."""
    return _ASOF.replace(", 6) AS", " + 1e-9::double, 6) AS")


@query("wn4_asof_features", asof_sql())
def asof_events(spark, d):
    return rounded_features(asof.asof_features(splits(spark, d)[0]), ["event_id"])


@query("wn4_asof_ties", f"""WITH {B}, u AS (SELECT user_id, ts, count(*) AS n, count(*) FILTER (event_type = 9) AS c FROM b GROUP BY 1, 2)
SELECT x.user_id, x.ts, x.n::bigint AS rows, coalesce(sum(y.n), 0)::bigint AS before, coalesce(sum(y.c), 0)::bigint AS bought_before FROM u x LEFT JOIN u y ON y.user_id = x.user_id AND y.ts < x.ts GROUP BY 1, 2, 3""")
def asof_ties(spark, d):
    e = orders_as_events(spark, d).withColumn("tie", F.struct("item_id", "merchant_id", "price_at_event", "event_type"))
    f = asof.asof_features(e, "tie")
    return f.groupBy("user_id", F.col("ts").cast("timestamp_ntz").alias("ts")).agg(F.count(F.lit(1)).alias("rows"), F.max("user_event_count").alias("before"), F.max("user_purchase_count").cast("long").alias("bought_before"))


@query("wn5_user_state", f"""WITH {SPLIT} SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 9) AS purchases, count(DISTINCT item_id) AS distinct_items, min(ts) AS first_ts, max(ts) AS last_ts,
  round(avg(price_at_event) FILTER (price_at_event > 0), 6) AS avg_price, round(avg(price_at_event) FILTER (price_at_event > 0 AND event_type = 9), 6) AS avg_order_value FROM tr GROUP BY user_id""")
def user_state(spark, d):
    s = asof.user_state(splits(spark, d)[1])
    return s.withColumns({c: F.round(c, 6) for c in ("avg_price", "avg_order_value")})


@query("wn5_item_state", f"""WITH {SPLIT} SELECT item_id, count(*) AS events, count(*) FILTER (event_type = 9) AS purchases, count(DISTINCT user_id) AS distinct_users, min(ts) AS first_ts, max(ts) AS last_ts FROM tr GROUP BY item_id""")
def item_state(spark, d):
    return asof.item_state(splits(spark, d)[1])


POP_SQL = f"pop AS (SELECT item_id, round(sum({WEIGHT_SQL} * pow(0.5::double, ((SELECT max(epoch_us(ts)) FROM tr) - epoch_us(ts)) / {_DAYS} / 30.0::double)), 6) AS score FROM tr GROUP BY 1)"
TREND_SQL = f"trend AS (SELECT item_id, round(sum({WEIGHT_SQL}), 6) AS score FROM tr WHERE ((SELECT max(epoch_us(ts)) FROM tr) - epoch_us(ts)) / {_DAYS} <= 7 GROUP BY 1)"


def pop_scores(train):
    return popularity.decayed(train).withColumn("score", F.round("score", 6))


def trend_scores(train):
    return popularity.trending(train).withColumn("score", F.round("score", 6))


@query("md1_popularity", f"WITH {SPLIT}, {POP_SQL} SELECT item_id, score FROM pop ORDER BY score DESC, item_id LIMIT 20")
def md1(spark, d):
    return popularity.top_items(pop_scores(splits(spark, d)[1]), 20)


@query("md3_trending", f"WITH {SPLIT}, {TREND_SQL} SELECT item_id, score FROM trend ORDER BY score DESC, item_id LIMIT 20")
def md3(spark, d):
    return popularity.top_items(trend_scores(splits(spark, d)[1]), 20)


_BUCKET = "(CASE WHEN hour(ts) < 6 THEN 0 WHEN hour(ts) < 10 THEN 1 WHEN hour(ts) < 14 THEN 2 WHEN hour(ts) < 17 THEN 3 WHEN hour(ts) < 21 THEN 4 ELSE 5 END)::int"
CTX_SQL = f"""x AS (SELECT *, {_BUCKET} AS bucket, {WEIGHT_SQL} * pow(0.5::double, ((SELECT max(epoch_us(ts)) FROM tr) - epoch_us(ts)) / {_DAYS} / 30.0::double) AS w FROM tr),
g AS (SELECT 3 AS level, region_id, vertical, bucket, item_id, sum(w) AS score, count(*) AS n FROM x GROUP BY 2, 3, 4, 5 UNION ALL SELECT 2, region_id, vertical, NULL, item_id, sum(w), count(*) FROM x GROUP BY 2, 3, 5
  UNION ALL SELECT 1, NULL, vertical, NULL, item_id, sum(w), count(*) FROM x GROUP BY 3, 5 UNION ALL SELECT 0, NULL, NULL, NULL, item_id, sum(w), count(*) FROM x GROUP BY 5),
m AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY level, region_id, vertical, bucket) AS cell_rows FROM g) WHERE cell_rows >= 30 OR level = 0)"""


@query("md2_contextual", f"WITH {SPLIT}, {CTX_SQL} SELECT level::int AS level, region_id, vertical, bucket, item_id, round(score, 6) AS score, cell_rows::bigint AS cell_rows FROM m")
def md2(spark, d):
    return popularity.contextual(splits(spark, d)[1]).withColumn("score", F.round("score", 6))


_CONTEXTS = [(0, 0, 0, 2), (1, 1, 1, None), (2, 3, 5, 4), (3, 9, 2, 1), (4, 9, 9, 0), (5, 2, 3, 5)]
_CTX_VALUES = ", ".join(f"({i}, {r}, {v}, {'NULL' if b is None else b})" for i, r, v, b in _CONTEXTS)
FALLBACK_SQL = """h AS (SELECT context_id, max(level) AS level FROM ctx, (SELECT DISTINCT level, region_id, vertical, bucket FROM m) c
  WHERE level = 0 OR (c.vertical = ctx.vertical AND (level = 1 OR (c.region_id = ctx.region_id AND (level = 2 OR c.bucket = ctx.bucket)))) GROUP BY 1),
y AS (SELECT h.context_id, h.level, m.item_id, m.score FROM h JOIN ctx USING (context_id) JOIN m ON m.level = h.level AND (h.level = 0 OR (m.vertical = ctx.vertical AND (h.level = 1 OR (m.region_id = ctx.region_id AND (h.level = 2 OR m.bucket = ctx.bucket))))))"""


@query("ag6_contextual_fallback", f"""WITH {SPLIT}, {CTX_SQL}, ctx(context_id, region_id, vertical, bucket) AS (VALUES {_CTX_VALUES}), {FALLBACK_SQL}
SELECT h.context_id::int AS context_id, i.item_id, h.level::int AS level, round(coalesce(y.score, 0), 6) AS score FROM h CROSS JOIN (SELECT DISTINCT item_id FROM tr) i LEFT JOIN y ON y.context_id = h.context_id AND y.item_id = i.item_id""")
def fallback(spark, d):
    train = splits(spark, d)[1]
    ctx = spark.createDataFrame(_CONTEXTS, "context_id int, region_id int, vertical int, bucket int")
    return popularity.contextual_scores(popularity.contextual(train), ctx, train).withColumn("score", F.round("score", 6))


@query("sv11_hour_sweep", f"""WITH {SPLIT}, {CTX_SQL}, ctx AS (SELECT range::int AS context_id, 1 AS region_id, 2 AS vertical, range::int AS bucket FROM range(6)), {FALLBACK_SQL},
k AS (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY round(score, 6) DESC, item_id) AS rank FROM y)
SELECT rank::int AS slot, count(DISTINCT item_id) AS distinct_items FROM k WHERE rank <= 3 GROUP BY 1""")
def hour_sweep(spark, d):
    train = splits(spark, d)[1]
    ctx = spark.range(6).select(F.col("id").cast("int").alias("context_id"), F.lit(1).alias("region_id"), F.lit(2).alias("vertical"), F.col("id").cast("int").alias("bucket"))
    scores = popularity.contextual_scores(popularity.contextual(train), ctx, train).withColumn("score", F.round("score", 6))
    return popularity.top_items(scores, 3, ["context_id"]).groupBy(F.col("rank").alias("slot")).agg(F.countDistinct("item_id").alias("distinct_items"))


@query("ev11_first_context", f"""WITH {SPLIT} SELECT user_id, hour(f.ts)::int AS hour, (isodow(f.ts) - 1)::int AS weekday, f.region_id, f.vertical
FROM (SELECT user_id, arg_min({{'ts': ts, 'region_id': region_id, 'vertical': vertical}}, (ts, event_id)) AS f FROM te GROUP BY 1)""")
def first_context(spark, d):
    return evaluate.first_context(splits(spark, d)[2])


@query("wn7_event_numbers", f"WITH {A} SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS nr FROM a")
def numbers(spark, d):
    from wayfare.operators.ingest import dense_ids

    key = F.struct("ts", "event_id").alias("key")
    return dense_ids(behaviour(spark, d).select(key), "key").select("key.event_id", F.col("index").alias("nr"))


@query("wn10_history_ladder", f"""WITH {SPLIT}, h AS (SELECT user_id, count(DISTINCT item_id) AS history_items FROM tr GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY history_items DESC, user_id) - 1 AS rank, count(*) OVER () AS n FROM h)
SELECT user_id, history_items, round(100.0::double * (1 - rank / greatest(n - 1, 1)), 1) AS percentile FROM r WHERE rank % greatest(1, n // 8) = 0 AND rank // greatest(1, n // 8) < 8""")
def ladder(spark, d):
    h = splits(spark, d)[1].groupBy("user_id").agg(F.countDistinct("item_id").alias("history_items"))
    r = row_numbers(h, [F.desc("history_items"), F.asc("user_id")], "rank").withColumn("rank", F.col("rank") - 1)
    r = r.join(F.broadcast(h.agg(F.count(F.lit(1)).alias("n"))))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 8))
    return r.where((F.col("rank") % step == 0) & (F.floor(F.col("rank") / step) < 8)).select("user_id", "history_items", F.round(100.0 * (1 - F.col("rank") / F.greatest(F.col("n") - 1, F.lit(1))), 1).alias("percentile"))


@query("snk4_saved_state", f"""WITH {SPLIT} SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 9) AS purchases, count(DISTINCT item_id) AS distinct_items, min(ts) AS first_ts, max(ts) AS last_ts,
  round(avg(price_at_event) FILTER (price_at_event > 0) + 1e-9::double, 6) AS avg_price, round(avg(price_at_event) FILTER (price_at_event > 0 AND event_type = 9) + 1e-9::double, 6) AS avg_order_value FROM s GROUP BY user_id""")
def saved_state(spark, d):
    """The training window's state, written, read back, and brought up to the end by the later events."""
    every, train, _ = splits(spark, d)
    path = scratch(spark, "state")
    asof.save_state(asof.pair_state(train), path)
    later = asof.pair_state(every.where("split <> 'train'"))
    s = asof.state_of_users(asof.merge_pairs(asof.load_state(spark, path), later))
    return s.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("avg_price", "avg_order_value")})
