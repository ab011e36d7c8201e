"""A kept linear projection: equal to NumPy on rows that were not fitted, saved, versioned."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.operators import projection as P
from wayfare.sources.tables import scratch


def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")


def test_fitted_on_half_projected_on_the_other(spark):
    v = vectors(spark)
    odd = spark.createDataFrame([(-2, None), (-4, [1.0, 2.0]), (-6, [float("nan")] * 64), (-8, [None] * 64)], "id long, embedding array<float>")
    model = P.fit_projection(v.unionByName(odd).where("id % 2 = 0"))
    path = scratch(spark, "basis")
    P.save_projection(spark, model, path)
    again = P.load_projection(spark, path)
    x = {r.id: np.array(r.embedding, float) for r in v.collect()}
    fit = np.array([e for i, e in x.items() if i % 2 == 0])
    _, _, axes = np.linalg.svd(fit - fit.mean(0), full_matrices=False)
    basis = axes[:3].T * np.sign(axes[:3].T[np.abs(axes[:3].T).argmax(0), np.arange(3)])
    assert model.rows == len(fit)
    np.testing.assert_allclose(again.basis, basis, atol=1e-6)
    got = P.project(v.unionByName(odd), again).collect()
    assert {r.id for r in got} == set(x)
    p = (fit - fit.mean(0)) @ basis
    centre = (p.min(0) + p.max(0)) / 2
    radius = np.linalg.norm(p - centre, axis=1).max()
    for r in got:
        want = (x[r.id] - fit.mean(0)) @ basis
        np.testing.assert_allclose(r.p, want, atol=1e-6)
        np.testing.assert_allclose(r.u, (want - centre) / radius, atol=1e-6)
    assert max(np.linalg.norm(r.u) for r in got if r.id % 2 == 0) == pytest.approx(1.0)


def test_other_versions_are_refused_and_nothing_is_fitted_on_nothing(spark):
    path = scratch(spark, "basis")
    P.save_projection(spark, P.fit_projection(vectors(spark)), path)
    spark.read.parquet(path).withColumn("version", F.lit("0")).write.parquet(path + "-old")
    with pytest.raises(ValueError, match="version"):
        P.load_projection(spark, path + "-old")
    none = P.fit_projection(vectors(spark).limit(0))
    assert none.rows == 0 and P.project(vectors(spark), none).count() == 0
