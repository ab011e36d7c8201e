"""Column expressions of the engine."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.sources.tables import CONVERSIONS, EVENT_WEIGHTS, code_map

DAY = 86_400_000_000


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts))


def weight(code: Column, missing: float) -> Column:
    """Event weight by code."""
    return F.coalesce(code_map(EVENT_WEIGHTS)[code], F.lit(missing))


def converts(code: str = "event_type") -> Column:
    return F.col(code).isin(*CONVERSIONS)


def hour_bucket(hour: Column) -> Column:
    """Night, breakfast, late morning, afternoon, dinner, evening as 0 to 5; hours outside a day count as 0."""
    at = F.lit(0)
    for code, start in ((1, 6), (2, 10), (3, 14), (4, 17), (5, 21)):
        at = F.when(hour.between(start, 23), code).otherwise(at)
    return at.cast("int")


def digitize(x: Column, edges: Column) -> Column:
    """Number of edges not above x."""
    return F.size(F.filter(edges, lambda e: e <= x)).cast("int")


def unit_scale(x: str, window) -> Column:
    """Min-max to [0, 1] within a window; 0 where all are equal."""
    low, high = F.min(x).over(window), F.max(x).over(window)
    return F.when(high > low, (F.col(x) - low) / (high - low)).otherwise(F.lit(0.0))


def log1p0(x: Column) -> Column:
    return F.log1p(F.coalesce(x.cast("double"), F.lit(0.0)))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def relative_change(new: Column, old: Column) -> Column:
    """(new - old) / old; from 0: 0 if both are 0, else infinite."""
    return F.when(old != 0, (new - old) / old).when(new == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def with_uniform(df: DataFrame, id_col: str, seed: int, salt: Column | int, out: str) -> DataFrame:
    """df with a uniform of [0, 1) hashed from an id: SplitMix64's finalizer on id + seed + salt, upper 53 bits.

    Products wrap at 64 bits, which ANSI arithmetic refuses; the column is analysed with ANSI off.
    """
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        x = F.col(id_col).cast("long") + F.lit(seed & 0xFFFFFFFF) + (salt if isinstance(salt, Column) else F.lit(salt)).cast("long")
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
            x = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
            if factor:
                df = df.withColumn("_x", x * F.lit(factor - 2**64))
                x = F.col("_x")
        return df.withColumn(out, F.shiftrightunsigned(x, 11).cast("double") / F.lit(float(2**53))).drop("_x")
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def inverse_cdf(u: Column, weights: list[float]) -> Column:
    """Category number by inverse-CDF sampling of a uniform."""
    total, upto, edges = sum(weights), 0.0, []
    for w in weights:
        upto += w / total
        edges.append(upto)
    return F.least(digitize(u, F.array(*[F.lit(e) for e in edges])), F.lit(len(weights) - 1))


def zipf(n: int, s: float) -> list[float]:
    raw = [1.0 / r**s for r in range(1, n + 1)]
    return [x / math.fsum(raw) for x in raw]
