"""Point-in-time features: what was known strictly before an event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.functions.expr import DAY, converts

FEATURES = (
    "user_event_count", "user_purchase_count", "user_conversion_rate", "user_distinct_items", "user_days_since_last", "user_tenure_days", "user_avg_interaction_price", "user_avg_order_value",
    "item_event_count", "item_purchase_count", "item_conversion_rate", "item_distinct_users", "item_days_since_last", "item_age_days",
    "ui_prior_events", "ui_prior_purchases", "ui_days_since_last", "user_category_affinity", "user_merchant_affinity", "price_ratio_to_user_avg",
)


def asof_features(events: DataFrame, tie: str = "event_id") -> DataFrame:
    """events with FEATURES; rows with equal ts do not see each other, undefined values are null.

    All frames end one microsecond before the row's own time.  The first row of a pair (by ts, tie) is flagged, and
    running sums of flags count distinct partners.  Missing price, vertical and merchant columns count as 0, null, null.
    """
    for c, kind in (("price_at_event", "double"), ("vertical", "int"), ("merchant_id", "int")):
        if c not in events.columns:
            events = events.withColumn(c, F.lit(None).cast(kind))
    keep = events.columns
    e = events.withColumn("_t", F.unix_micros("ts")).withColumn("_c", converts().cast("int")).withColumn("_p", F.when(F.col("price_at_event") > 0, F.col("price_at_event")))
    pair = Window.partitionBy("user_id", "item_id")
    e = e.withColumn("_first", (F.row_number().over(pair.orderBy("_t", tie)) == 1).cast("int"))
    past = lambda *keys: Window.partitionBy(*keys).orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    n, zero = F.count(F.lit(1)), F.lit(0)
    conv = lambda w: F.coalesce(F.sum("_c").over(w), zero)
    days = lambda x: (F.col("_t") - x) / DAY
    w = past("user_id")
    e = e.withColumns(
        {
            "user_event_count": n.over(w), "user_purchase_count": conv(w), "user_distinct_items": F.coalesce(F.sum("_first").over(w), zero), "user_days_since_last": days(F.max("_t").over(w)), "user_tenure_days": days(F.min("_t").over(w)),
            "user_avg_interaction_price": F.avg("_p").over(w), "user_avg_order_value": F.avg(F.when(F.col("_c") == 1, F.col("_p"))).over(w),
        }
    )
    e = item_past(e)
    for who in ("user", "item"):
        e = e.withColumn(f"{who}_conversion_rate", F.when(F.col(f"{who}_event_count") > 0, F.col(f"{who}_purchase_count") / F.col(f"{who}_event_count")))
    w = past("user_id", "item_id")
    e = e.withColumns({"ui_prior_events": n.over(w), "ui_prior_purchases": conv(w), "ui_days_since_last": days(F.max("_t").over(w))})
    for name, key in (("user_category_affinity", "vertical"), ("user_merchant_affinity", "merchant_id")):
        e = e.withColumn(name, F.when((F.col("user_event_count") > 0) & F.col(key).isNotNull(), n.over(past("user_id", key)) / F.col("user_event_count")))
    ratio = F.when(F.col("user_avg_interaction_price") > 0, F.coalesce("price_at_event", F.lit(0.0)) / F.col("user_avg_interaction_price"))
    return e.withColumn("price_ratio_to_user_avg", ratio).select(*keep, *FEATURES)


def item_past(e: DataFrame) -> DataFrame:
    """e with what was known of each row's item: totals of its earlier days, and a frame within its day.

    So no task holds a popular item's whole history: a day's rows are one frame, and the days' totals another.
    """
    e = e.withColumn("_day", F.floor(F.col("_t") / DAY))
    before = Window.partitionBy("item_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    sums = e.groupBy("item_id", "_day").agg(F.count(F.lit(1)).alias("_n"), F.sum("_c").alias("_b"), F.sum("_first").alias("_f"), F.max("_t").alias("_l"), F.min("_t").alias("_o"))
    sums = sums.select("item_id", "_day", *[f(c).over(before).alias(c) for c, f in (("_n", F.sum), ("_b", F.sum), ("_f", F.sum), ("_l", F.max), ("_o", F.min))])
    own = Window.partitionBy("item_id", "_day").orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    e = e.join(sums, ["item_id", "_day"])
    plus = lambda c, x: F.coalesce(F.col(c), F.lit(0)) + F.coalesce(x.over(own), F.lit(0))
    age = lambda x: (F.col("_t") - x) / DAY
    e = e.withColumns(
        {
            "item_event_count": plus("_n", F.count(F.lit(1))), "item_purchase_count": plus("_b", F.sum("_c")), "item_distinct_users": plus("_f", F.sum("_first")),
            "item_days_since_last": age(F.coalesce(F.max("_t").over(own), "_l")), "item_age_days": age(F.coalesce("_o", F.min("_t").over(own))),
        }
    )
    return e.drop("_day", "_n", "_b", "_f", "_l", "_o")


def user_state(events: DataFrame) -> DataFrame:
    """The state after the last event of each user, as plain aggregates."""
    price = F.when(F.col("price_at_event") > 0, F.col("price_at_event"))
    c = converts().cast("int")
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.sum(c).alias("purchases"), F.countDistinct("item_id").alias("distinct_items"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.avg(price).alias("avg_price"), F.avg(F.when(c == 1, price)).alias("avg_order_value"))


def item_state(events: DataFrame) -> DataFrame:
    c = converts().cast("int")
    return events.groupBy("item_id").agg(F.count(F.lit(1)).alias("events"), F.sum(c).alias("purchases"), F.countDistinct("user_id").alias("distinct_users"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


STATE_VERSION = "1"


def pair_state(events: DataFrame) -> DataFrame:
    """(user_id, item_id, events, purchases, first_ts, last_ts, priced, price, bought, paid): what adds up to every other state."""
    price, c = F.when(F.col("price_at_event") > 0, F.col("price_at_event")), converts().cast("int")
    paid = F.when(c == 1, price)
    return events.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("events"), F.sum(c).alias("purchases"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(price).alias("priced"), F.sum(price).alias("price"), F.count(paid).alias("bought"), F.sum(paid).alias("paid"))


def merge_pairs(*states: DataFrame) -> DataFrame:
    """Pair states of separate stretches of events as one."""
    both = states[0]
    for more in states[1:]:
        both = both.unionByName(more)
    sums = [F.sum(c).alias(c) for c in ("events", "purchases", "priced", "price", "bought", "paid")]
    return both.groupBy("user_id", "item_id").agg(*sums, F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def state_of_users(pairs: DataFrame) -> DataFrame:
    """user_state() from pair states."""
    return pairs.groupBy("user_id").agg(
        F.sum("events").alias("events"), F.sum("purchases").alias("purchases"), F.count(F.lit(1)).alias("distinct_items"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        (F.sum("price") / F.nullif(F.sum("priced"), F.lit(0))).alias("avg_price"), (F.sum("paid") / F.nullif(F.sum("bought"), F.lit(0))).alias("avg_order_value"),
    )


def save_state(pairs: DataFrame, path: str) -> None:
    pairs.select(F.lit(STATE_VERSION).alias("version"), "*").write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """A saved pair state; another version is refused."""
    rows = spark.read.parquet(path)
    if found := {r.version for r in rows.select("version").distinct().collect()} - {STATE_VERSION}:
        raise ValueError(f"state of version {sorted(found)}, this reads {STATE_VERSION}")
    return rows.drop("version")
