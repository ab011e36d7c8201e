"""Sessions, repeat purchases, event numbers, time splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.distributed import running_sum
from wayfare.functions.quantiles import exact_quantiles

GAP_MINUTES, MAX_EVENTS = 30, 500
TRAIN, VALIDATION = 0.70, 0.15


def sessionize(events: DataFrame, gap_minutes: int = GAP_MINUTES, max_events: int = MAX_EVENTS) -> DataFrame:
    """events with session_nr (0-based in its user) and session_id: a gap over the limit starts a session, and long ones are split.

    session_id is dense over (user, session): users are numbered by a prefix sum over their session counts.
    """
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(by)
    out = events.withColumn("_new", F.when(gap.isNull() | (gap > gap_minutes * 60_000_000), 1).otherwise(0)).withColumn("_s", F.sum("_new").over(by))
    part = F.floor((F.row_number().over(Window.partitionBy("user_id", "_s").orderBy("ts", "event_id")) - 1) / max_events)
    out = out.withColumn("_part", part)
    out = out.withColumn("session_nr", F.dense_rank().over(Window.partitionBy("user_id").orderBy("_s", "_part")) - 1).drop("_new", "_s", "_part")
    counts = out.groupBy("user_id").agg((F.max("session_nr") + 1).alias("_n"))
    base = running_sum(counts, ["user_id"], F.col("_n"), "_upto").select("user_id", (F.col("_upto") - F.col("_n")).alias("_base"))
    return out.join(base, "user_id").withColumn("session_id", F.col("_base") + F.col("session_nr")).drop("_base")


def session_table(events: DataFrame) -> DataFrame:
    """A row for each session; device is the first event's, or its region where events carry no device."""
    device = "device" if "device" in events.columns else "region_id"
    return events.groupBy("session_id").agg(F.min("user_id").alias("user_id"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count(F.lit(1)).alias("n_events"), F.min_by(device, F.struct("ts", "event_id")).alias("device"))


def repeat_purchases(events: DataFrame) -> DataFrame:
    """Every purchase of a pair but its first becomes a repeat purchase (10)."""
    buys = F.col("event_type") == 9
    nr = F.row_number().over(Window.partitionBy("user_id", "item_id", buys).orderBy("ts", "event_id"))
    repeat = buys & (nr > 1)
    return events.withColumn("is_repeat", repeat).withColumn("event_type", F.when(F.col("is_repeat"), 10).otherwise(F.col("event_type")))


def split_bounds(events: DataFrame, train: float = TRAIN, validation: float = VALIDATION) -> DataFrame:
    """One row (t1, t2): interpolated quantiles of time, in microseconds; null without events."""
    q = exact_quantiles(events, F.unix_micros("ts"), [train, train + validation])
    return q.select(F.get("q", F.lit(0)).cast("long").alias("t1"), F.get("q", F.lit(1)).cast("long").alias("t2"))


def temporal_split(events: DataFrame, train: float = TRAIN, validation: float = VALIDATION) -> DataFrame:
    """events with split: train, validation, test; later splits keep only users that train knows."""
    b = F.broadcast(split_bounds(events, train, validation))  # one row
    at = F.unix_micros("ts")
    cut = events.join(b).withColumn("split", F.when(at <= F.col("t1"), "train").when(at <= F.col("t2"), "validation").otherwise("test")).drop("t1", "t2")
    known = cut.where("split = 'train'").select("user_id").distinct()
    return cut.where("split = 'train'").unionByName(cut.where("split <> 'train'").join(known, "user_id", "left_semi"))


def leakage_report(split: DataFrame) -> DataFrame:
    """(earlier, later, ok): whether each earlier window ends before the later begins; empty windows pass."""
    ends = split.groupBy("split").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    one = ends.agg(*[F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{c}") for s in ("train", "validation", "test") for c in ("first", "last")])
    rows = [F.struct(F.lit(a).alias("earlier"), F.lit(b).alias("later"), F.coalesce(F.col(f"{a}_last") <= F.col(f"{b}_first"), F.lit(True)).alias("ok")) for a, b in (("train", "validation"), ("train", "test"), ("validation", "test"))]
    return one.select(F.inline(F.array(*rows)))


def split_summary(events: DataFrame, split: DataFrame) -> DataFrame:
    """Rows at the boundary and retained, with shares, and users, by split."""
    b = F.broadcast(split_bounds(events))
    at = F.unix_micros("ts")
    name = F.when(at <= F.col("t1"), "train").when(at <= F.col("t2"), "validation").otherwise("test")
    whole = events.join(b).groupBy(name.alias("split")).agg(F.count(F.lit(1)).alias("boundary_rows"))
    kept = split.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("user_id").alias("users"))
    w = Window.partitionBy(F.lit(1))
    share = lambda c: F.round(F.col(c) / F.sum(c).over(w), 6)
    return whole.join(kept, "split", "left").withColumn("boundary_share", share("boundary_rows")).withColumn("retained_share", share("rows"))
