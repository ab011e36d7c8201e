"""Projections of vectors to few dimensions: a linear one that is fitted, saved and applied to any vectors, and a map of neighbourhoods."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.expr import finite
from wayfare.operators.vectors import _matrix

BASIS_VERSION = "1"


@dataclass
class Projection:
    """Principal components: (x - mean) @ basis, and that less centre, over radius, in the unit sphere of the rows it was fitted on."""

    mean: np.ndarray
    basis: np.ndarray
    centre: np.ndarray
    radius: float
    rows: int

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.basis


def _whole(vectors: DataFrame, size: int | None = None) -> DataFrame:
    """Rows whose vectors are complete and finite, of one size where it is given."""
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: finite(x.cast("double")))
    return vectors.where(ok if size is None else ok & (F.size("embedding") == size)).withColumn("embedding", F.col("embedding").cast("array<double>"))


def _moments(vectors: DataFrame, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and products of components; a task sends size * (size + 1) numbers, whatever its rows."""

    def run(batches):
        n, total, products = 0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                n, total, products = n + len(x), total + x.sum(0), products + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1), pa.int32()), pa.array([[float(n), *total], *[[0.0, *row] for row in products]], pa.list_(pa.float64()))], ["place", "sums"])

    parts = vectors.select("embedding").mapInArrow(run, "place int, sums array<double>").select("place", F.posexplode("sums").alias("i", "v"))
    sums = np.zeros((size + 1, size + 1))
    for r in parts.groupBy("place", "i").agg(F.sum("v").alias("v")).collect():  # (size + 1)^2 rows
        sums[r.place, r.i] = r.v
    return int(sums[0, 0]), sums[0, 1:], sums[1:, 1:]


def fit_projection(vectors: DataFrame, dims: int = 3) -> Projection:
    """The principal components of vectors (id, embedding), by their moments; the first vector's size counts.

    Null, incomplete and not finite vectors, and those of another size, teach nothing.  Each component's largest
    weight is positive, so refits agree in sign.  Without rows the basis is empty.
    """
    rows = _whole(vectors)
    first = rows.select(F.size("embedding").alias("n")).first()
    if first is None:
        return Projection(np.zeros(0), np.zeros((0, dims)), np.zeros(dims), 1.0, 0)
    rows = rows.where(F.size("embedding") == first.n)
    n, total, products = _moments(rows, first.n)
    mean = total / n
    values, axes = np.linalg.eigh(products / n - np.outer(mean, mean))
    basis = axes[:, np.argsort(-values, kind="stable")[:dims]]
    basis = basis * np.sign(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])])
    found = Projection(mean, basis, np.zeros(basis.shape[1]), 1.0, n)
    places = project(rows, found, ())
    ends = places.agg(*[f(F.col("p")[i]).alias(f"{name}{i}") for i in range(basis.shape[1]) for name, f in (("l", F.min), ("h", F.max))]).first()
    found.centre = np.array([(ends[f"l{i}"] + ends[f"h{i}"]) / 2 for i in range(basis.shape[1])])
    far = places.agg(F.max(F.aggregate(_shifted("p", found.centre), F.lit(0.0), lambda s, x: s + x * x)).alias("r")).first().r
    found.radius = float(np.sqrt(far)) or 1.0
    return found


def _shifted(column: str, centre: np.ndarray) -> Column:
    return F.zip_with(column, F.array(*[F.lit(float(c)) for c in centre]), lambda x, c: x - c)


def project(vectors: DataFrame, model: Projection, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keep, p, u): principal components, and those less the centre over the radius; u of rows that were not fitted may leave the sphere.

    Vectors of another size, and incomplete or not finite ones, drop out.
    """
    rows = _whole(vectors, len(model.mean))
    size, dims = len(model.mean), model.basis.shape[1]

    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        p = model.apply(np.asarray(x.flatten().to_numpy(zero_copy_only=False), float).reshape(len(x), size))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, max(1, dims)), pa.int32()), pa.array(p.reshape(-1)))

    placed = rows.select(*keep, run(F.col("embedding")).alias("p"))
    return placed.withColumn("u", F.transform(_shifted("p", model.centre), lambda x: x / model.radius))


def save_projection(spark: SparkSession, model: Projection, path: str) -> None:
    row = (BASIS_VERSION, model.mean.tolist(), model.basis.tolist(), model.centre.tolist(), model.radius, model.rows)
    spark.createDataFrame([row], "version string, mean array<double>, basis array<array<double>>, centre array<double>, radius double, rows long").write.mode("overwrite").parquet(path)


def load_projection(spark: SparkSession, path: str) -> Projection:
    """A saved projection; another version is refused."""
    r = spark.read.parquet(path).first()
    if r.version != BASIS_VERSION:
        raise ValueError(f"projection of version {r.version}, this reads {BASIS_VERSION}")
    return Projection(np.array(r.mean), np.array(r.basis).reshape(len(r.mean), -1), np.array(r.centre), r.radius, r.rows)
