"""The layered proximity graph: links, beams, recall against exact search, fewer comparisons than the inverted file, versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.operators import evaluate, graph, vectors
from wayfare.sources.tables import scratch


def units(rng, n, d, groups=0):
    x = rng.normal(size=(n, d))
    if groups:
        x = 0.35 * x + rng.normal(size=(groups, d))[rng.integers(0, groups, n)]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_neighbours_and_pruning_by_brute_force():
    x = units(np.random.default_rng(0), 300, 8)
    near = graph.nearest(x, 10)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    assert (near == np.argsort(-s, axis=1, kind="stable")[:, :10]).all()
    keep = graph.pruned(x, near, 4)
    for i in range(300):
        stay = []
        for j in near[i]:
            if len(stay) < 4 and not any(graph.HIDE * (1 - x[j] @ x[k]) < 1 - x[i] @ x[j] for k in stay):
                stay.append(j)
        assert near[i][keep[i]].tolist() == stay
    links = graph.both_ways(near, keep)
    pairs = {(a, b) for a in range(300) for b in links[a] if b >= 0}
    assert pairs == {(b, a) for a, b in pairs} and {(i, j) for i in range(300) for j in near[i][keep[i]]} <= pairs


def test_beams_find_the_nearest_and_count_comparisons():
    rng = np.random.default_rng(1)
    x = units(rng, 3000, 16, 40)
    layers = graph.layered(x, rng.permutation(3000))
    assert [len(a) for a, _ in layers] == [3000, 187, 11]
    rows, score, looked = graph.beam_search(x, layers, x[:50], 48)
    s = x[:50] @ x.T
    exact = np.argsort(-s, axis=1, kind="stable")[:, :10]
    assert np.mean([len(set(a[:10].tolist()) & set(b.tolist())) for a, b in zip(rows, exact, strict=True)]) >= 9.3
    assert (np.diff(score, axis=1) <= 0).all() and looked.max() < 1500 and all(len(set(r.tolist())) == len(r) for r in rows)
    np.testing.assert_allclose(score[0], x[rows[0]] @ x[0])


def test_recall_on_every_hundredth_row_with_fewer_comparisons(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    asked = v.where("id % 100 = 0")
    got = {r["index"]: r for r in graph.compare(v, asked, scratch(spark, "indexes"), vectors.cosine_topk(asked, v, 10), 10).collect()}
    assert got["graph"].recall >= 0.9 and got["graph"].looked < got["lists"].looked


def test_clustered_rows_in_shards(spark):
    x = units(np.random.default_rng(2), 4000, 24, 60)
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, embedding array<double>").repartition(6)
    path = scratch(spark, "graph")
    graph.build_graph(v, path, shard_rows=1000)
    g = graph.load_graph(spark, path)
    assert g.count() == 4 and g.agg(F.sum("n")).first()[0] == 4000
    asked = v.where("id % 100 = 0")
    found = graph.search_graph(g, asked, 10)
    recall = evaluate.overlap_at_k(found, vectors.cosine_topk(asked, v, 10), 10).agg(F.avg("recall")).first()[0]
    assert recall >= 0.9 and found.agg(F.max("looked")).first()[0] < 2400
    assert found.where("query = id").isEmpty() and found.groupBy("query").count().where("count <> 10").isEmpty()


def test_small_odd_and_foreign(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [0.0, 2.0]), (5, [float("nan"), 1.0]), (6, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    path = scratch(spark, "graph")
    graph.build_graph(v, path)
    got = graph.search_graph(graph.load_graph(spark, path), v, 5).collect()
    assert sorted((r.query, r.rank, r.id) for r in got) == [(1, 1, 6), (1, 2, 4), (4, 1, 6), (4, 2, 1), (6, 1, 1), (6, 2, 4)]
    graph.build_graph(v.limit(0), path + "-empty")
    assert graph.search_graph(graph.load_graph(spark, path + "-empty"), v, 5).count() == 0
    graph.build_graph(v.where("id = 1"), path + "-one")
    assert graph.search_graph(graph.load_graph(spark, path + "-one"), v, 5).where("query = 4").first().id == 1
    spark.read.schema(graph.ROW).parquet(path).withColumn("version", F.lit("0")).write.parquet(path + "-old")
    with pytest.raises(ValueError, match="version"):
        graph.load_graph(spark, path + "-old")
