"""NN-descent against exact search, fuzzy weights by their definition, and neighbourhoods kept better than by principal components."""

import numpy as np
from pyspark.sql import functions as F

from wayfare.operators import evaluate, neighbours, vectors
from wayfare.operators.projection import fit_projection, project


def table(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")


def test_graph_and_map(spark):
    v = table(spark)
    graph = neighbours.checkpointed(neighbours.neighbour_graph(v, 10, 500), "graph")
    exact = vectors.cosine_topk(v, v, 10)
    recall = evaluate.overlap_at_k(graph.select(F.col("id").alias("query"), F.col("near").alias("id")), exact, 10).agg(F.avg("recall")).first()[0]
    assert recall >= 0.9 and graph.groupBy("id").count().where("count <> 10").isEmpty() and graph.where("id = near").isEmpty()

    rows = vectors.unit(v)
    model = fit_projection(rows)
    flat = project(rows, model)
    start = flat.select("id", F.transform("p", lambda x: x * (10 / model.radius)).alias("p"))
    places = neighbours.neighbour_map(neighbours.fuzzy_edges(graph), start, block_nodes=700)  # three blocks
    asked = v.select("id").where("id % 5 = 0")
    kept, by_axes = (neighbours.preserved(graph, p, asked, 10).agg(F.avg("share")).first()[0] for p in (places, flat.select("id", "p")))
    assert places.count() == 2000 and kept > 2 * by_axes


def test_weights_sum_to_log2_and_are_the_same_both_ways(spark):
    rng = np.random.default_rng(0)
    graph = [(i, int(j), float(s)) for i in range(30) for j, s in zip(rng.choice([x for x in range(30) if x != i], 8, replace=False), rng.uniform(size=8), strict=True)]
    got = {(r.id, r.near): r.weight for r in neighbours.fuzzy_edges(spark.createDataFrame(graph, neighbours.GRAPH)).collect()}
    one = {}
    for i in range(30):
        own = sorted(((1 - s, j) for a, j, s in graph if a == i))
        gap = np.array([d - own[0][0] for d, _ in own])
        low, high = 1e-9, 1e3
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (low, mid) if np.exp(-gap / mid).sum() > 3 else (mid, high)
        one |= {(i, j): float(np.exp(-g / mid)) for g, (_, j) in zip(gap, own, strict=True)}
    want = {k for a, b in one for k in ((a, b), (b, a))}
    assert set(got) == want
    for a, b in want:
        x, y = one.get((a, b), 0.0), one.get((b, a), 0.0)
        assert abs(got[a, b] - (x + y - x * y)) < 1e-4 and got[a, b] == got[b, a]


def test_small_and_odd_tables(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [0.0, 2.0]), (5, [float("nan"), 1.0]), (6, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    assert sorted((r.id, r.near) for r in neighbours.neighbour_graph(v, 1).collect()) in ([(1, 6), (4, 6), (6, 1)], [(1, 6), (4, 6), (6, 4)])
    assert neighbours.map_vectors(v, 2, 2).count() == 3
    assert neighbours.neighbour_graph(v.limit(0)).count() == 0


def test_returned_scores_are_exact_though_rounds_carry_16_bits(spark):
    x = np.random.default_rng(3).normal(size=(300, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    packed = vectors.unit(v).repartition(1).sortWithinPartitions("id").mapInArrow(neighbours._packed, "u long, packed binary").toArrow()
    assert np.abs(neighbours._unpacked(packed.column("packed")) - unit[packed.column("u").to_numpy()]).max() < 2e-5
    got = neighbours.neighbour_graph(v, 5, 100).collect()
    assert len(got) == 1500 and max(abs(r.score - float(unit[r.id] @ unit[r.near])) for r in got) < 1e-12


def test_epochs_of_the_map_do_not_grow_with_blocks(spark, monkeypatch):
    edges = [(a, b, 0.5) for a in range(40) for b in (a - 1, a + 1) if 0 <= b < 40]
    start = [(i, [float(i % 7), float(i % 5)]) for i in range(41)]  # the last node has no edge
    moves, move = [], neighbours._move
    monkeypatch.setattr(neighbours, "_move", lambda *how: moves.append(how) or move(*how))
    places = neighbours.neighbour_map(spark.createDataFrame(edges, "id long, near long, weight double"), spark.createDataFrame(start, "id long, p array<double>"), epochs=2, passes=3, block_nodes=5)
    got = {r.id: r.p for r in places.collect()}
    assert len(moves) == 2 and set(got) == set(range(41)) and got[40] == [5.0, 0.0]
