"""A table that streams write exactly once: a batch's rows lie under its number, and count once its commit is written.

A batch that is replayed before its commit replaces what an interrupted attempt has left; one that is replayed after
its commit is known and writes nothing.  Batches are committed in order, so readers take all up to the last commit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def committed_batch(spark: SparkSession, path: str) -> int:
    """The number of the last committed batch; -1 before the first."""
    if not _exists(spark, f"{path}/commits"):
        return -1
    last = spark.read.schema("rows long, batch int").parquet(f"{path}/commits").agg(F.max("batch")).first()[0]
    return -1 if last is None else last


def write_rows(batch: DataFrame, nr: int, path: str) -> None:
    """The rows of batch nr, in place of those of an interrupted attempt."""
    batch.write.mode("overwrite").parquet(f"{path}/data/batch={nr}")


def commit(spark: SparkSession, nr: int, path: str, schema: T.StructType) -> None:
    """From now on readers see batch nr."""
    rows = spark.read.schema(schema).parquet(f"{path}/data/batch={nr}")
    rows.agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/commits/batch={nr}")


def exactly_once(path: str) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls."""

    def write(batch: DataFrame, nr: int) -> None:
        spark = batch.sparkSession
        if nr <= committed_batch(spark, path):
            return
        write_rows(batch, nr, path)
        commit(spark, nr, path, batch.schema)

    return write


def committed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all committed batches, with the batch's number; other batches' folders are not read."""
    whole = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])
    last = committed_batch(spark, path)
    if last < 0:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(f"{path}/data").where(F.col("batch") <= last)
