"""Running sums over all rows without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.sources.tables import checkpointed


def running_sum(df: DataFrame, order: list, value: Column, out: str) -> DataFrame:
    """df with `out`: the sum of value over the rows up to and including this one; order must be total.

    Rows are range-partitioned and summed within each part; parts are shifted by the totals of those before them, so
    only one row for each part meets in a task.  The ranged rows are written first: ranges are drawn from a sample.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.withColumn("_v", value).repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_p").agg(F.sum("_v").alias("_t"))
    shift = totals.select("_p", (F.sum("_t").over(Window.orderBy("_p")) - F.col("_t")).alias("_s"))
    own = F.sum("_v").over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranged.join(shift, "_p").withColumn(out, F.col("_s") + own).drop("_p", "_s", "_v")


def row_numbers(df: DataFrame, order: list, out: str) -> DataFrame:
    """df with `out`: its place in order, from 1."""
    return running_sum(df, order, F.lit(1), out)
