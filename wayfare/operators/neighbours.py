"""Nearest-neighbour graphs by NN-descent, and maps that keep neighbourhoods.

A graph starts from exact neighbours within hashed blocks.  In each round the neighbours of a node, its own and those
it is one of, are introduced to each other; pairs that beat what a node has replace it.  Introductions carry vectors as 16-bit
numbers, so scores within the rounds are off by some 1e-5; those that are returned are exact.  The map moves nodes along weighted
edges and away from drawn others; a task holds a block of them and the other ends of its edges, whatever the table's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.expr import dot
from wayfare.operators.graph import nearest
from wayfare.operators.projection import fit_projection, project
from wayfare.operators.vectors import _matrix, unit
from wayfare.sources.tables import checkpointed

#: Neighbours kept at the end, and how many times as many until then; rows of a starting block, and ways of dealing them; links of each kind that a node introduces in a round; partners that a member gets from an introduction; rounds at most, and the share of changed links that ends them.
NEAR, WIDE, START_ROWS, STARTS, SAMPLE, PARTNERS, ROUNDS, SETTLED = 15, 2, 1000, 2, 30, 10, 6, 0.01
#: Rows of introductions that a task takes together; bytes of a task's share of a round, which is sorted in memory.
CHUNK, PART_BYTES = 8192, 16_000_000
#: Nodes of a block of the map; epochs, passes over a round's edges, negatives for each edge, the first step's size.
BLOCK_NODES, EPOCHS, PASSES, NEGATIVES, STEP = 20_000, 5, 40, 5, 1.0
# The curve 1 / (1 + A d^2B) of edges in the map, which fits a least distance of 0.1.
A, B = 1.577, 0.895
GRAPH = "id long, near long, score double"
SCALE = 32767


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "near"))
    return found.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def _parts(rows: int, size: int) -> int:
    return max(1, -(-rows * size // PART_BYTES))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, packed): each vector as its largest size, of 32 bits, and 16-bit shares of it."""
    for batch in batches:
        x = _matrix(batch.column(1))
        if len(x):
            most = np.abs(x).max(1, keepdims=True).astype("<f4")
            codes = np.rint(x / most * SCALE).clip(-SCALE, SCALE).astype("<i2")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.tobytes() + c.tobytes() for m, c in zip(most, codes, strict=True)], pa.binary())], ["u", "packed"])


def _unpacked(column: pa.ChunkedArray) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.ascontiguousarray(raw[:, 4:]).view("<i2").astype(np.float32) * (np.ascontiguousarray(raw[:, :4]).view("<f4") / np.float32(SCALE))


def _start(rows: DataFrame, k: int, start_rows: int, total: int) -> DataFrame:
    """Exact neighbours within hashed blocks, of STARTS ways of hashing, so that blocks of one way are linked by another."""
    n = max(1, -(-total // start_rows))

    def run(got: pa.Table) -> pa.Table:
        ids, x = got.column("id").to_numpy(), _matrix(got.column("embedding"))
        near = nearest(x, k)
        at = np.repeat(np.arange(len(ids)), near.shape[1])
        to = near.reshape(-1)
        return pa.table([pa.array(ids[at]), pa.array(ids[to]), pa.array(np.einsum("nd,nd->n", x[at], x[to]))], ["id", "near", "score"])

    ways = F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1 if n > 1 else 0)))
    dealt = rows.withColumn("way", ways).withColumn("g", F.pmod(F.xxhash64("id", "way", F.lit(11)), F.lit(n)))
    found = dealt.groupBy("way", "g").applyInArrow(run, GRAPH).repartition(_parts(total * STARTS * k, 32), "id")
    return _top(found.groupBy("id", "near").agg(F.max("score").alias("score")), k)


def _sampled(links: DataFrame, turn: int, sample: int) -> DataFrame:
    """About `sample` of the links (v, u) of each v, by hash; a limit on the hash keeps well-known nodes from meeting whole."""
    u = F.pmod(F.xxhash64("v", "u", F.lit(turn)), F.lit(2**31)) / float(2**31)
    sizes = links.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    few = links.withColumn("h", u).join(sizes, "v").where(F.col("h") * F.col("n") <= 2 * sample)
    return few.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("h", "u"))).where(F.col("r") <= sample).select("v", "u")


def _introductions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, near, score) of members of one v that beat id's worst neighbour; rows (v, u, worst, packed) come sorted by v."""
    held: list[pa.RecordBatch] = []

    def meet(rows: pa.Table) -> pa.RecordBatch:
        v, u, worst = (rows.column(c).to_numpy() for c in ("v", "u", "worst"))
        x = _unpacked(rows.column("packed"))
        starts = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        sizes = np.diff(np.append(starts, len(v)))
        out = []
        for m in np.unique(sizes[sizes > 1]):  # groups of one size together
            at = starts[sizes == m][:, None] + np.arange(m)
            s = np.matmul(x[at], x[at].transpose(0, 2, 1)).astype(float)
            s[u[at][:, :, None] == u[at][:, None, :]] = -np.inf
            top = np.argsort(-s, axis=2, kind="stable")[:, :, :PARTNERS]
            best = np.take_along_axis(s, top, 2)
            g, i, j = np.nonzero(best > worst[at][:, :, None])
            out.append((u[at[g, i]], u[at[g, top[g, i, j]]], best[g, i, j]))
        a, b, s = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        _, first = np.unique(np.stack([a, b], 1), axis=0, return_index=True) if len(a) else (None, np.zeros(0, int))
        return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(s[first])], ["id", "near", "score"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            rows = pa.Table.from_batches(held)
            v = rows.column("v").to_numpy()
            last = int(np.flatnonzero(v != v[-1]).max(initial=-1)) + 1  # the last group may go on
            if last:
                yield meet(rows.slice(0, last))
                held = rows.slice(last).to_batches()
    if held and (rows := pa.Table.from_batches(held)).num_rows:
        yield meet(rows)


def neighbour_graph(vectors: DataFrame, k: int = NEAR, start_rows: int = START_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """(id, near, score): about the k nearest others by cosine of each row of vectors (id, embedding).

    Rows without a direction (null, zero, not finite) drop out; ids must differ; ties go to smaller ids; fewer than k
    others give fewer rows, an empty table none.
    """
    rows = checkpointed(unit(vectors).select(F.col("id").cast("long").alias("id"), "embedding"), "unit-vectors")
    total = rows.count()
    few, k = k, WIDE * k if total > start_rows else k
    graph = checkpointed(_start(rows, k, start_rows, total), "neighbours")
    if total <= start_rows:
        return graph
    packed = checkpointed(rows.mapInArrow(_packed, "u long, packed binary"), "packed-vectors")
    size = 48 + (packed.agg(F.max(F.length("packed"))).first()[0] or 0)
    for turn in range(rounds):
        worst = graph.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(-2.0)).alias("worst")).withColumnRenamed("id", "u")
        own = graph.select(F.col("id").alias("v"), F.col("near").alias("u"))
        links = own if k <= SAMPLE else _sampled(own, turn, SAMPLE)
        links = links.unionByName(_sampled(own.select(F.col("u").alias("v"), F.col("v").alias("u")), turn, SAMPLE)).repartition("u").distinct()
        members = links.join(worst, "u").join(packed, "u").select("v", "u", "worst", "packed")
        met = members.repartition(_parts(2 * SAMPLE * total, size), "v").sortWithinPartitions("v", "u").mapInArrow(_introductions, GRAPH)
        both = graph.withColumn("new", F.lit(0)).unionByName(met.withColumn("new", F.lit(1)))
        both = both.repartition(_parts(2 * SAMPLE * PARTNERS * total, 32), "id")  # once, for the pairs and for their order
        both = both.groupBy("id", "near").agg(F.max("score").alias("score"), F.min("new").alias("new"))
        better = checkpointed(_top(both, k), "neighbours")
        changed = better.agg(F.sum("new")).first()[0] or 0
        graph = better.drop("new")
        if changed <= SETTLED * k * total:
            break
    return _exact(checkpointed(_top(graph, few).select("id", "near"), "neighbours"), rows, total * few)


def _exact(pairs: DataFrame, rows: DataFrame, number: int) -> DataFrame:
    """(id, near, score) of about so many pairs (id, near), by the vectors themselves."""
    there = pairs.join(rows.select(F.col("id").alias("near"), F.col("embedding").alias("b")), "near")
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    both = there.repartition(_parts(number, 48 + 8 * width), "id").join(rows, "id")
    return both.select("id", "near", dot(F.col("embedding"), F.col("b")).alias("score"))


def fuzzy_edges(graph: DataFrame) -> DataFrame:
    """(id, near, weight): how surely two nodes are neighbours, both ways alike.

    From each node, distances beyond the nearest fade so that the weights sum to log2 of their number; a + b - ab
    joins the two views of an edge.
    """
    kinds = "id long, near array<long>, weight array<double>"

    def run(batches):
        for batch in batches:
            near, scores = batch.column(1), batch.column(2)
            out = []
            for s in scores:
                d = np.maximum(1 - s.values.to_numpy(), 0)
                gap, low, high, aim = d - d.min(), 0.0, np.inf, max(math.log2(len(d)), 1e-3)
                width = 1.0
                for _ in range(48):  # bisection
                    if np.exp(-gap / width).sum() > aim:
                        high, width = width, (low + width) / 2
                    else:
                        low, width = width, width * 2 if high == np.inf else (width + high) / 2
                    if width < 1e-9 or width > 1e9:
                        break
                out.append(np.exp(-gap / max(width, 1e-9)))
            yield pa.RecordBatch.from_arrays([batch.column(0), near, pa.array(out, pa.list_(pa.float64()))], ["id", "near", "weight"])

    lists = graph.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "near", "score"))).alias("all"))  # k entries at most
    one = lists.select("id", F.transform("all", lambda x: x["near"]).alias("near"), F.transform("all", lambda x: x["score"]).alias("score")).mapInArrow(run, kinds)
    one = one.select("id", F.explode(F.arrays_zip("near", "weight")).alias("e")).select("id", "e.near", "e.weight")
    both = one.unionByName(one.select(F.col("near").alias("id"), F.col("id").alias("near"), "weight"))
    return both.groupBy("id", "near").agg((F.sum("weight") - F.when(F.count(F.lit(1)) > 1, F.product("weight")).otherwise(F.lit(0.0))).alias("weight"))


def _move(step: float, passes: int, negatives: int, most: float, seed: int):
    """One block's share of an epoch: new positions of the heads; kinds 0, 1, 2 are heads, tails and edges."""

    def run(got: pa.Table) -> pa.Table:
        kind = got.column("kind").to_numpy()
        heads, tails, edges = (got.filter(pa.array(kind == k)).sort_by([("id", "ascending"), ("near", "ascending")]) for k in (0, 1, 2))
        ids = heads.column("id").to_numpy()
        p, q = _matrix(heads.column("p")), _matrix(tails.column("p"))
        if edges.num_rows and len(ids):
            rng = np.random.default_rng(seed)
            own = np.searchsorted(ids, edges.column("id").to_numpy())
            to = np.searchsorted(tails.column("id").to_numpy(), edges.column("near").to_numpy())
            same = tails.column("id").to_numpy()
            chance = edges.column("weight").to_numpy() / most
            for n in range(passes):
                rate = step * (1 - n / passes) if passes > 1 else step
                at = np.flatnonzero(rng.uniform(size=len(own)) < chance)
                a, b = own[at], to[at]
                diff = p[a] - q[b]
                d2 = np.maximum((diff**2).sum(1), 1e-12)
                pull = -2 * A * B * d2 ** (B - 1) / (1 + A * d2**B)
                move = np.zeros_like(p)
                np.add.at(move, a, np.clip(pull[:, None] * diff, -4, 4))
                a = np.repeat(a, negatives)
                b = rng.integers(0, len(q), len(a))
                diff = p[a] - q[b]
                d2 = (diff**2).sum(1)
                push = np.where(ids[a] == same[b], 0.0, 2 * B / ((0.001 + d2) * (1 + A * d2**B)))
                np.add.at(move, a, np.clip(push[:, None] * diff, -4, 4))
                p = p + rate * np.clip(move, -4, 4) / 4
        return pa.table({"id": pa.array(ids), "p": pa.array(list(p), pa.list_(pa.float64()))})

    return run


def neighbour_map(edges: DataFrame, start: DataFrame, epochs: int = EPOCHS, passes: int = PASSES, negatives: int = NEGATIVES, step: float = STEP, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(id, p): positions in which neighbours lie together; edges: (id, near, weight) both ways, start: (id, p).

    Nodes are hashed into blocks; in each epoch the heads of a block meet all their edges and those edges' other ends
    in one task, and only heads move, so epochs need no locks, and their number does not grow with the blocks'.
    Negatives are drawn from the other ends of the block.
    """
    n = max(1, -(-start.count() // block_nodes))
    block = F.pmod(F.xxhash64("id", F.lit(13)), F.lit(n)).cast("int").alias("g")
    links = checkpointed(edges.select(block, "id", "near", "weight"), "map-edges")
    ends = checkpointed(links.select("g", F.col("near").alias("id")).distinct(), "map-ends")
    most = links.agg(F.max("weight")).first()[0] or 1.0
    places = checkpointed(start.select("id", "p"), "map")
    row = lambda kind, near=F.lit(0).cast("long"), weight=F.lit(0.0), p=F.col("p"): (F.lit(kind).alias("kind"), "id", near.alias("near"), weight.alias("weight"), p.alias("p"))
    for turn in range(epochs):
        heads = places.select(block, *row(0))
        tails = ends.join(places, "id").select("g", *row(1))
        between = links.select("g", *row(2, F.col("near"), F.col("weight"), F.array().cast("array<double>")))
        move = _move(step * (1 - turn / epochs), passes, negatives, most, turn)
        places = checkpointed(heads.unionByName(tails).unionByName(between).groupBy("g").applyInArrow(move, "id long, p array<double>"), "map")
    return places


def map_vectors(vectors: DataFrame, dims: int = 3, k: int = NEAR, **how) -> DataFrame:
    """(id, p) of vectors (id, embedding): the map of their neighbour graph, started from their principal components."""
    rows = unit(vectors).select(F.col("id").cast("long").alias("id"), "embedding")
    model = fit_projection(rows, dims)
    spread = 10.0 / max(model.radius, 1e-9)
    start = project(rows, model).select("id", F.transform("p", lambda x: x * spread).alias("p"))
    return neighbour_map(fuzzy_edges(checkpointed(neighbour_graph(vectors, k), "neighbours")), start, **how)


def preserved(graph: DataFrame, places: DataFrame, asked: DataFrame, k: int = NEAR) -> DataFrame:
    """(id, share): which part of a node's neighbours are among its k nearest in the places (id, p); asked: (id)."""
    from wayfare.operators.vectors import inner_topk

    # |a - b|^2 orders as a . b - |b|^2 / 2: one more component makes it an inner product.
    half = F.aggregate("p", F.lit(0.0), lambda s, x: s + x * x) / -2
    there = places.select("id", F.concat("p", F.array(half)).alias("embedding"))
    queries = places.join(asked, "id", "left_semi").select("id", F.concat("p", F.array(F.lit(1.0))).alias("embedding"))
    found = inner_topk(queries, there, k, digits=None).select(F.col("query").alias("id"), F.col("id").alias("near"), F.lit(1).alias("hit"))
    return graph.join(asked, "id", "left_semi").join(found, ["id", "near"], "left").groupBy("id").agg((F.count("hit") / F.count(F.lit(1))).alias("share"))
