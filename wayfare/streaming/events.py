"""Event streams: validated ingest, running state, sessions, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, item_id INT, event_type INT, price_at_event DOUBLE"
#: With what live features read besides.
LIVE_SCHEMA = f"{EVENT_SCHEMA}, vertical INT, merchant_id INT"


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1, schema: str = EVENT_SCHEMA) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def accept(events: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """events with reason: unknown_user or unknown_item, null where accepted; users and items are static tables."""
    u, i = users.select("user_id").distinct().withColumn("_u", F.lit(True)), items.select("item_id").distinct().withColumn("_i", F.lit(True))
    checked = events.join(u, "user_id", "left").join(i, "item_id", "left")
    return checked.withColumn("reason", F.when(F.col("_u").isNull(), "unknown_user").when(F.col("_i").isNull(), "unknown_item")).drop("_u", "_i")


def running_user_state(events: DataFrame) -> DataFrame:
    """(user_id, events, purchases, first_us, last_us) after each batch, kept per user; late events never move last_us back."""
    us = F.unix_micros("ts")
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type").isin(9, 10)).alias("purchases"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))


def closed_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions that the watermark has closed."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return s.select("user_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "n_events")


def windowed_counts(events: DataFrame, width: str, slide: str, late: str) -> DataFrame:
    s = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return s.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def merge_history(batch: DataFrame, history: DataFrame) -> DataFrame:
    """History pairs with a batch's own added; impressions (0) do not count as history."""
    return history.select("user_id", "item_id").unionByName(batch.where("event_type <> 0").select("user_id", "item_id")).distinct()
