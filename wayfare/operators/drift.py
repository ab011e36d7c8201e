"""Distribution drift and histogram percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.expr import digitize, finite
from wayfare.functions.quantiles import exact_quantiles, running_counts
from wayfare.sources.tables import checkpointed

# Severity limits of PSI, and the least share a bin counts as.
MINOR, MAJOR, FLOOR = 0.10, 0.25, 1e-6


def detect_drift(reference: DataFrame, current: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """(feature, psi, ks, js, reference_mean, current_mean, reference_n, current_n, severity) of all features in one job.

    Both windows are unpivoted to (feature, value); bins come from quantiles of the reference only, equal edges are
    merged and the outer bins are open.  Values that are not finite are left out; features empty on a side are dropped.
    """
    long = lambda df, side: df.select([F.col(f).cast("double").alias(f) for f in features]).unpivot([], features, "feature", "x").where(finite(F.col("x"))).withColumn("side", F.lit(side))
    rows = checkpointed(long(reference, 0).unionByName(long(current, 1)), "drift-values")
    q = exact_quantiles(rows.where("side = 0"), F.col("x"), [i / bins for i in range(bins + 1)], ("feature",))
    stats = rows.groupBy("feature").agg(
        *[F.avg(F.when(F.col("side") == s, F.col("x"))).alias(f"{n}_mean") for s, n in ((0, "reference"), (1, "current"))],
        *[F.count_if(F.col("side") == s).alias(f"{n}_n") for s, n in ((0, "reference"), (1, "current"))],
    ).where("reference_n > 0 AND current_n > 0").join(F.broadcast(q), "feature")
    edges = F.array_sort(F.array_distinct("q"))
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    stats = stats.select("feature", inner.alias("inner"), "reference_mean", "current_mean", "reference_n", "current_n")  # a constant has one open bin

    binned = rows.join(F.broadcast(stats.select("feature", "inner")), "feature").groupBy("feature", digitize(F.col("x"), F.col("inner")).alias("bin")).agg(F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("c"))
    every = stats.select("feature", "reference_n", "current_n", F.explode(F.sequence(F.lit(0), F.size("inner"))).alias("bin"))
    share = lambda n, total: F.greatest(F.coalesce(F.col(n), F.lit(0)) / F.col(total), F.lit(FLOOR))
    p = every.join(binned, ["feature", "bin"], "left").withColumn("e", share("r", "reference_n")).withColumn("a", share("c", "current_n"))
    half = (F.col("e") + F.col("a")) / 2
    psi = p.groupBy("feature").agg(F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))).alias("psi"), (F.sum(F.col("e") * F.log2(F.col("e") / half)) / 2 + F.sum(F.col("a") * F.log2(F.col("a") / half)) / 2).alias("js"))

    at = rows.groupBy("feature", "x").agg(F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("c"))
    ks = running_counts(at, ["feature"], "x", ["r", "c"]).join(F.broadcast(stats.select("feature", "reference_n", "current_n")), "feature")
    ks = ks.groupBy("feature").agg(F.max(F.abs(F.col("upto_r") / F.col("reference_n") - F.col("upto_c") / F.col("current_n"))).alias("ks"))
    severity = F.when(F.col("psi") >= MAJOR, "major").when(F.col("psi") >= MINOR, "minor").otherwise("stable")
    out = stats.drop("inner").join(psi, "feature").join(ks, "feature").withColumn("severity", severity)
    return out.select("feature", *[F.round(c, 6).alias(c) for c in ("psi", "ks", "js", "reference_mean", "current_mean")], "reference_n", "current_n", "severity").orderBy(F.desc("psi"), "feature")


def histogram(values: DataFrame, by: str, x: str, bounds: list[float]) -> DataFrame:
    """(by, upper, cumulative): cumulative counts at each bound, and one at infinity."""
    ladder = [*bounds, float("inf")]
    aggs = [F.count_if(F.col(x) <= b).alias(f"b{i}") for i, b in enumerate(ladder)]
    one = values.groupBy(by).agg(*aggs)
    return one.select(by, F.inline(F.array(*[F.struct(F.lit(float(b)).alias("upper"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(ladder)])))


def histogram_percentile(buckets: DataFrame, by: str, q: float) -> DataFrame:
    """(by, estimate): interpolated inside the bucket that reaches q; in the open bucket its lower bound; null if empty."""
    order = Window.partitionBy(by).orderBy("upper")
    rows = buckets.withColumn("low", F.coalesce(F.lag("upper").over(order), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("cumulative").over(order), F.lit(0)))
    rows = rows.withColumn("total", F.max("cumulative").over(Window.partitionBy(by))).where((F.col("cumulative") >= q * F.col("total")) & (F.col("total") > 0))
    hit = rows.groupBy(by).agg(F.min(F.struct("upper", "low", "below", "cumulative", "total")).alias("h")).select(by, "h.*")
    inside = F.col("low") + (q * F.col("total") - F.col("below")) / (F.col("cumulative") - F.col("below")) * (F.col("upper") - F.col("low"))
    estimate = F.when(F.col("upper") == float("inf"), F.col("low")).when(F.col("cumulative") <= F.col("below"), F.col("upper")).otherwise(inside)
    return buckets.select(by).distinct().join(hit.select(by, F.round(estimate, 6).alias("estimate")), by, "left")
