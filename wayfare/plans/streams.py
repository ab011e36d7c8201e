"""Queries that run as streams over the events until all are read, and return what the sink then holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.plans.cleaning import SPLIT
from wayfare.operators import asof
from wayfare.plans.features import asof_sql, rounded_features, splits
from wayfare.plans.registry import query
from wayfare.sources.tables import BEHAVIOUR_SQL as A
from wayfare.sources.tables import behaviour, checkpointed, scratch
from wayfare.streaming import asof as live
from wayfare.streaming import events as S
from wayfare.streaming import sink


#: Files of a time range, which make a batch; live features take more for more events.
EACH, FILE_ROWS = 4, 524_288
COLUMNS = ("event_id", "ts", "user_id", "item_id", "event_type", "price_at_event", "vertical", "merchant_id")
#: The provider of keyed state that lies on disk.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _files(spark: SparkSession, df: DataFrame, where: str, files: int, nrs: range, each: int = EACH) -> None:
    """Write the time ranges nrs of `files`, one after the other; files are read in the order of their age."""
    us = F.unix_micros("ts")
    first, last = df.agg(F.min(us), F.max(us)).first()
    part = F.least(F.floor((us - first) * files / max(1, (last or 0) - (first or 0))), F.lit(files - 1))
    for nr in nrs:
        df.where(part == nr).select(*COLUMNS).repartition(each).write.mode("append").parquet(f"{where}/in")


def _drain(out: DataFrame, where: str, name: str, mode: str) -> DataFrame:
    """Run a stream until all files are read, from its checkpoint where there is one; returns what its sink holds."""
    q = out.writeStream.outputMode(mode).foreachBatch(sink.exactly_once(f"{where}/{name}")).option("checkpointLocation", f"{where}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return sink.committed(out.sparkSession, f"{where}/{name}", out.schema)


def _run(spark: SparkSession, d: str, build, files: int = 4, mode: str = "update") -> DataFrame:
    """Write the events as a few files, one time range after the other, stream them through build() into a table."""
    where = scratch(spark, "stream")
    _files(spark, behaviour(spark, d), where, files, range(files))
    return _drain(build(S.read_stream(spark, f"{where}/in", EACH)), where, "out", mode)


@query("st1_running_state", f"WITH {A} SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 9) AS purchases, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM a GROUP BY 1")
def running_state(spark, d):
    out = _run(spark, d, S.running_user_state)
    return out.groupBy("user_id").agg(F.max("events").alias("events"), F.max("purchases").alias("purchases"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


@query("st2_accepted_events", f"""WITH {SPLIT} SELECT CASE WHEN user_id NOT IN (SELECT user_id FROM tr) THEN 'unknown_user' WHEN item_id NOT IN (SELECT item_id FROM tr) THEN 'unknown_item' ELSE 'accepted' END AS reason, count(*) AS n FROM a GROUP BY 1""")
def accepted(spark, d):
    """Users and items of the training window are known."""
    train = splits(spark, d)[1]
    users, items = (checkpointed(train.select(c).distinct(), c) for c in ("user_id", "item_id"))
    out = _run(spark, d, lambda e: S.accept(e, users, items).select("event_id", "reason"), mode="append")
    return out.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# A last batch without rows moves the watermark to one hour before the last event; what ends by then has been written.
@query("st3_closed_sessions", f"""WITH {A}, l AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM a),
m AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM l)
SELECT user_id, min(ts) AS started_at, max(ts) + INTERVAL 30 MINUTE AS ended_at, count(*) AS n_events FROM m GROUP BY user_id, g HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM a) - INTERVAL 1 HOUR""")
def closed(spark, d):
    return _run(spark, d, S.closed_sessions, mode="append").drop("batch")


@query("st4_windowed_counts", f"""WITH {A}, w AS (SELECT date_trunc('day', ts) - to_days(range::int) AS b, event_type FROM a, range(7))
SELECT b::timestamp AS start, b::timestamp + INTERVAL 7 DAY AS "end", event_type, count(*) AS n FROM w GROUP BY 1, 2, 3 HAVING b::timestamp + INTERVAL 7 DAY <= (SELECT max(ts) FROM a) - INTERVAL 1 HOUR""")
def windowed(spark, d):
    return _run(spark, d, lambda e: S.windowed_counts(e, "7 days", "1 day", "1 hour"), mode="append").drop("batch")


@query("st5_merged_history", f"WITH {A} SELECT DISTINCT user_id, item_id FROM a")
def history(spark, d):
    e = behaviour(spark, d)
    old = checkpointed(e.where("event_id % 2 = 0"), "history")
    return S.merge_history(e.where("event_id % 2 = 1"), old)


def live_features(spark: SparkSession, events: DataFrame, files: int = 4, stop: int = 2) -> DataFrame:
    """events' point-in-time features from two streams, users' and items', both stopped after `stop` time ranges and started again."""
    where, before = scratch(spark, "stream"), spark.conf.get(*PROVIDER)
    rows = events.count()
    buckets, each = live.buckets_for(rows), max(EACH, -(-rows // (files * FILE_ROWS)))
    spark.conf.set(*PROVIDER)
    try:
        for nrs in (range(stop), range(stop, files)):
            _files(spark, events, where, files, nrs, each)
            sides = [_drain(f(S.read_stream(spark, f"{where}/in", each, S.LIVE_SCHEMA), buckets), where, f.__name__, "append").drop("batch") for f in (live.user_features, live.item_features)]
    finally:
        spark.conf.set(PROVIDER[0], before)
    return sides[0].join(sides[1], "event_id").select("event_id", *asof.FEATURES)


@query("st6_live_features", asof_sql())
def live_asof(spark, d):
    """The features of wn4 from keyed state that is read before it is changed, across a restart."""
    return rounded_features(live_features(spark, splits(spark, d)[0]), ["event_id"])
