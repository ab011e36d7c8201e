"""Exact quantiles and running counts against NumPy; what is kept follows the state of its source."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.functions.quantiles import exact_quantiles, running_counts
from wayfare.sources.tables import kept, scratch

SHARES = [0.0, 0.1, 0.25, 0.5, 0.7, 0.85, 1.0]


@pytest.mark.parametrize("kind", ["double", "long"])
def test_quantiles_of_keys(spark, kind):
    rng = np.random.default_rng(3)
    data = {"hot": np.round(rng.normal(size=3000), 2) * 100, "same": np.full(50, 7.0), "one": np.array([3.0]), "two": np.array([1.0, 4.0])}
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").withColumn("x", F.col("x").cast(kind)).repartition(7)
    got = {r.k: r.q for r in exact_quantiles(df, F.col("x"), SHARES, ("k",)).collect()}
    old = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("x", F.array(*map(F.lit, SHARES))).alias("q")).where("q IS NOT NULL").collect()}
    assert got == old and set(got) == set(data)  # bit by bit
    want = np.quantile(data["hot"].astype("int64" if kind == "long" else float), SHARES)
    np.testing.assert_allclose(got["hot"], want)


def test_quantiles_without_key_and_of_nothing(spark):
    df = spark.range(101).withColumn("x", F.col("id") * 3)
    assert [r.q for r in exact_quantiles(df, F.col("x"), [0.5, 0.333]).collect()] == [[150.0, pytest.approx(99.9)]]
    assert [r.q for r in exact_quantiles(df.limit(0), F.col("x"), [0.5]).collect()] == [None]


def test_running_counts(spark):
    rng = np.random.default_rng(4)
    rows = [(k, int(x), int(n)) for k in "abc" for x, n in zip(rng.permutation(400), rng.integers(0, 9, 400), strict=True)]
    got = running_counts(spark.createDataFrame(rows, "k string, x int, n int"), ["k"], "x", ["n"]).collect()
    assert len(got) == len(rows)
    for k in "abc":
        own = sorted((x, n) for c, x, n in rows if c == k)
        upto = np.cumsum([n for _, n in own])
        assert [r.upto_n for r in sorted((r for r in got if r.k == k), key=lambda r: r.x)] == upto.tolist()


def test_kept_rows_follow_their_source(spark):
    where, calls = scratch(spark, "source"), []

    def build():
        calls.append(1)
        return spark.read.parquet(where).withColumn("twice", F.col("id") * 2)

    spark.range(5).write.parquet(where)
    assert kept(spark, where, "twice", build).count() == 5 and kept(spark, where, "twice", build).count() == 5 and len(calls) == 1
    spark.range(7).write.mode("append").parquet(where)
    assert kept(spark, where, "twice", build).count() == 12 and len(calls) == 2
