"""Schemas, readers and writers of the behavioural tables."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RAW_EVENTS = "timestamp BIGINT, visitorid BIGINT, event STRING, itemid BIGINT, transactionid DOUBLE"
RAW_PROPERTIES = "timestamp BIGINT, itemid BIGINT, property STRING, value STRING"
RAW_CATEGORIES = "categoryid INT, parentid DOUBLE"
INTERACTIONS = (
    "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, item_id INT, session_id BIGINT, event_type INT, merchant_id INT, vertical INT, region_id INT, device INT, price_at_event DOUBLE, is_repeat BOOLEAN"
)

# Codes of event types and their weights.
EVENT_TYPES = {"impression": 0, "skip": 1, "click": 2, "view": 3, "search": 4, "wishlist": 5, "add_to_cart": 6, "remove_from_cart": 7, "rating": 8, "purchase": 9, "repeat_purchase": 10}
EVENT_WEIGHTS = {0: 0.1, 1: 0.05, 2: 1.0, 3: 1.5, 4: 2.0, 5: 2.5, 6: 4.0, 7: 1.5, 8: 3.0, 9: 8.0, 10: 12.0}
RAW_EVENT_CODES = {"view": 3, "addtocart": 6, "transaction": 9}
CONVERSIONS = (9, 10)
REPORT_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_map(codes: dict) -> F.Column:
    return F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Raw CSV events, typed: epoch milliseconds become timestamps, names become codes; an unknown name fails the job."""
    raw = spark.read.schema(RAW_EVENTS).option("header", True).csv(path)
    code = code_map(RAW_EVENT_CODES)[F.col("event")]
    code = F.coalesce(code, F.raise_error(F.concat(F.lit("unknown event: "), F.coalesce("event", F.lit("null")))).cast("int"))
    return raw.select(F.timestamp_millis("timestamp").alias("ts"), F.col("visitorid").alias("user_id"), F.col("itemid").alias("item_id"), code.alias("event_type"), F.col("transactionid").cast("long").alias("transaction_id"))


def read_item_properties(spark: SparkSession, *paths: str, properties=("categoryid", "available")) -> DataFrame:
    raw = spark.read.schema(RAW_PROPERTIES).option("header", True).csv(list(paths))
    return raw.where(F.col("property").isin(*properties)).select(F.timestamp_millis("timestamp").alias("ts"), F.col("itemid").alias("item_id"), "property", "value")


def read_category_tree(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(RAW_CATEGORIES).option("header", True).csv(path)
    return raw.select(F.col("categoryid").alias("category_id"), F.col("parentid").cast("int").alias("parent_id"))


def write_table(df: DataFrame, path: str, *by: str) -> None:
    """Parquet with zstd, partitioned where asked."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_features(df: DataFrame, path: str, version: str) -> None:
    """Feature rows with their schema version, partitioned by split."""
    write_table(df.withColumn("feature_version", F.lit(version)), path, "split")


def read_features(spark: SparkSession, path: str, version: str, columns: list[str]) -> DataFrame:
    """Features of exactly this version and these columns; anything else is refused."""
    df = spark.read.parquet(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"features lack {missing}")
    if found := [r[0] for r in df.select("feature_version").distinct().limit(2).collect() if r[0] != version]:
        raise ValueError(f"features have version {found[0]}, not {version}")
    return df.select("split", *columns)


def write_json_row(df: DataFrame, path: str) -> str:
    """A report of REPORT_ROWS rows at most as one JSON document; returns the text."""
    rows = df.toJSON().take(REPORT_ROWS + 1)
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report has at most {REPORT_ROWS} rows; write a table")
    text = json.dumps([json.loads(r) for r in rows])
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; where none is set, in a temporary one in local mode alone."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="wayfare-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where}/wayfare/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written to the shared folder and read back, which ends its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str = "cut") -> tuple[DataFrame, int]:
    """checkpointed(), and the number of its rows, which the write itself counts."""
    rows = Observation()
    out = checkpointed(df.observe(rows, F.count(F.lit(1)).alias("n")), name)
    return out, rows.get["n"]


def kept(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What build() gives, written once for each state of the files at source (their paths, sizes and times), and read back.

    Rows are written aside and then renamed, so readers find all of them or none; a changed source is another name.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(source)
    fs = at.getFileSystem(conf)
    files = fs.listStatus(at)
    state = sorted(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}" for f in files)
    made = scratch(spark, name)
    where = f"{made.rpartition('/')[0]}/{name}-{hashlib.sha256(chr(10).join(state).encode()).hexdigest()[:32]}"
    to = jvm.org.apache.hadoop.fs.Path(where)
    own = to.getFileSystem(conf)
    if not own.exists(to):
        build().write.parquet(made)
        if not own.rename(jvm.org.apache.hadoop.fs.Path(made), to) and not own.exists(to):
            raise OSError(f"can't rename {made}")
    return spark.read.parquet(where)


def behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `events` table as interactions; item from props, synthetic vertical, merchant and region by remainder."""
    codes = code_map({"error": 1, "click": 2, "view": 3, "signup": 6, "purchase": 9})
    item = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", item.alias("item_id"), codes[F.col("event_type")].alias("event_type"),
        (item % 6).alias("vertical"), (item % 8).alias("merchant_id"), (F.col("user_id") % 4).cast("int").alias("region_id"), F.col("value").alias("price_at_event"),
    )


BEHAVIOUR_SQL = r"""a AS (SELECT event_id, ts, user_id, item_id, CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 WHEN 'signup' THEN 6 WHEN 'purchase' THEN 9 END AS event_type,
  item_id % 6 AS vertical, item_id % 8 AS merchant_id, (user_id % 4)::int AS region_id, value AS price_at_event
  FROM (SELECT *, regexp_extract(props, '"k": *([0-9]+)', 1)::int AS item_id FROM events))"""


def orders_as_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders and lineitem as interactions with day-grained times, so with many ties."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    codes = code_map({"A": 6, "R": 7, "N": 9})
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), codes[F.col("l_returnflag")].alias("event_type"),
        F.col("l_suppkey").alias("merchant_id"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price_at_event"),
    )


ORDERS_SQL = """b AS (SELECT o_orderdate AS ts, o_custkey AS user_id, l_partkey AS item_id, CASE l_returnflag WHEN 'A' THEN 6 WHEN 'R' THEN 7 WHEN 'N' THEN 9 END AS event_type,
  l_suppkey AS merchant_id, l_extendedprice / l_quantity AS price_at_event FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
