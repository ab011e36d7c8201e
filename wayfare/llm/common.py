"""What the training-data operators share: word rules, staged tables, row keys."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Up to this many row keys (16 bytes each) are broadcast.
BROADCAST_KEYS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is configured, a temporary one in local mode alone."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="wayfare-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


#: With it Spark removes a query's shuffle files when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, columns stay prunable, shuffle files go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wayfare/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (writer.partitionBy(*by) if by else writer).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    fields = [f for f in df.schema.fields if f.name not in by] + [df.schema[c] for c in by]
    return spark.read.schema(type(df.schema)(fields)).parquet(path)


def unstaged(*tables: DataFrame) -> None:
    """Remove tables that staged() wrote and that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null and for blank texts."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    blank = F.lit("")
    edge = F.when(parts[0] == blank, 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == blank), 1).otherwise(0)
    return (F.size(parts) - edge).cast("long")


def row_key(df: DataFrame) -> tuple[Column, Column]:
    """A 128-bit hash of all columns of a row, nulls told apart; columns of maps are not hashed."""
    cols = [df[quoted(f.name)] for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    cols += [c.isNull() for c in cols]
    return F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols)


def keyed(df: DataFrame) -> DataFrame:
    """doc_id, text and the key (k1, k2) of each row."""
    k1, k2 = row_key(df)
    return df.select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))


def chosen_rows(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs with one row for each root of groups (doc_id, k1, k2, root), and those of its rows that have no doc_id.

    The row with the smallest (doc_id, k1, k2) stays.  The keys of what goes are counted: up to BROADCAST_KEYS of them
    are broadcast, so that texts are not shuffled.
    """
    p = free_prefix(docs)
    best = staged(groups.groupBy("root").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("best")), "best-rows")  # written, so that the join splits large groups
    stays = F.max(F.struct("doc_id", "k1", "k2") == F.col("best")).alias(f"{p}stays")
    rows = groups.join(best, "root").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias(f"{p}n"), stays)
    gone = staged(rows.where(~F.col(f"{p}stays") | (F.col(f"{p}n") > 1)).select(F.col("k1").alias(f"{p}k1"), F.col("k2").alias(f"{p}k2"), f"{p}stays"), "gone")
    unstaged(best)
    n, again = gone.agg(F.count(F.lit(1)), F.count(F.when(F.col(f"{p}stays"), 1))).first()
    near = F.broadcast if n <= BROADCAST_KEYS else lambda x: x
    k1, k2 = row_key(docs)
    same = docs["doc_id"].isNotNull() & (k1 == F.col(f"{p}k1")) & (k2 == F.col(f"{p}k2"))
    out = docs.join(near(gone), same, "left_anti")
    if again:  # equal rows: one of them stays
        few = docs.join(near(gone.where(F.col(f"{p}stays"))), same, "left_semi")
        out = out.unionByName(few.groupBy(*row_key(few)).agg(F.first(F.struct(*own_columns(few))).alias(f"{p}row")).select(f"{p}row.*"))
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of df, whatever their names: dots and backticks mean nothing in them."""
    return [F.col(quoted(c)) for c in df.columns]


def free_prefix(df: DataFrame) -> str:
    """Underscores that no column of df begins with: helper columns with it clash with none."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix
