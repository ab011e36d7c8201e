"""Exact quantiles by rank selection over ranges: no task holds more than one range of a key's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.sources.tables import checkpointed


def ranges(df: DataFrame, by: list[str], order: str, sums: list[str]) -> tuple[DataFrame, DataFrame]:
    """df in ranges of (by, order), numbered as _p, and (by, _p, _<sum>, _<sum>_before, _<sum>_all): each range's sums and those of the ranges before it.

    The second table has a row for each range and key.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(parts, *by, order).withColumn("_p", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(*by, "_p").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    more = {f"_{c}_before": F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)) for c in sums} | {f"_{c}_all": F.sum(f"_{c}").over(Window.partitionBy(*by)) for c in sums}
    return ranged, totals.withColumns(more)


def running_counts(df: DataFrame, by: list[str], order: str, sums: list[str]) -> DataFrame:
    """df with upto_<sum>: the running sums over a key's rows in order; order must be total within a key."""
    ranged, totals = ranges(df, by, order, sums)
    own = Window.partitionBy(*by, "_p").orderBy(order)
    rows = ranged.withColumns({f"_own_{c}": F.sum(c).over(own) for c in sums}).join(totals, [*by, "_p"])
    return rows.select(*df.columns, *[(F.col(f"_{c}_before") + F.col(f"_own_{c}")).alias(f"upto_{c}") for c in sums])


def exact_quantiles(df: DataFrame, value: Column, shares: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, q): each key's quantiles of value at the shares, interpolated between neighbouring ranks; nulls don't count.

    Values are counted and put in ranges; the ranges' totals say which of them hold the ranks that are asked for, and
    only those are sorted.  Without by there is one row, with a null q for an empty df; keys must not be null.
    """
    keys = list(by)
    counts = df.select(*keys, value.alias("_x")).where(F.col("_x").isNotNull()).groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("n"))
    ranged, totals = ranges(counts, keys, "_x", ["n"])
    asked = F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("_n_all") - 1) * F.lit(float(p))).alias("at")) for i, p in enumerate(shares)])
    asked = totals.select(*keys, "_p", "_n", "_n_before", F.explode(asked).alias("a")).select(*keys, "_p", "_n", "_n_before", "a.i", "a.at")
    asked = asked.withColumn("rank", F.explode(F.array(F.floor("at"), F.ceil("at")))).where("rank >= _n_before AND rank < _n_before + _n").distinct()  # two rows for each share and key
    held = ranged.join(F.broadcast(asked.select(*keys, "_p").distinct()), [*keys, "_p"], "left_semi")
    held = held.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys, "_p").orderBy("_x")))
    hit = held.join(F.broadcast(asked), [*keys, "_p"]).where("_n_before + upto > rank AND _n_before + upto - n <= rank")
    x = F.col("_x").cast("double")
    ends = hit.groupBy(*keys, "i", "at").agg(F.min_by(x, "rank").alias("low"), F.max_by(x, "rank").alias("high"))
    between = (F.ceil("at") - F.col("at")) * F.col("low") + (F.col("at") - F.floor("at")) * F.col("high")
    ends = ends.withColumn("v", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between))
    out = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("all")).select(*keys, F.transform("all", lambda s: s["v"]).alias("q"))
    return out if keys else df.sparkSession.range(1).drop("id").join(F.broadcast(out), F.lit(True), "left").select(F.when(F.size("q") > 0, F.col("q")).alias("q"))
