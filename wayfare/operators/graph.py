"""A layered proximity graph for vector search: built by shards, saved under a version, searched by beams, merged.

Rows are dealt over shards by hash, and each shard builds its own graph in one task, of bounded size.  Each layer above the
lowest holds a hashed sixteenth of the one below.  A node keeps those of its nearest neighbours that no closer kept one
hides, and links go both ways.  A search walks down from the top layer and widens its beam on the lowest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.operators.vectors import BLOCK_BYTES, ROUND, _best, _matrix, _ranked, blocks, full, load_index, search_index, unit
from wayfare.sources.tables import checkpointed

#: Rows of a shard, on average; neighbours looked at and links kept from each node; the share of a layer that is in the next, as 1 / THIN.
SHARD_ROWS, NEAR, LINKS, THIN = 20_000, 48, 16, 16
#: A neighbour is hidden by a kept one that is nearer to it than 1 / HIDE of its distance.
HIDE = 1.2
#: The beam is as wide as a shard's own trial searches need for so much recall of TRIAL_K neighbours of TRIALS of its rows; nodes opened in a step; queries walked together.
RECALL, TRIAL_K, TRIALS, BEAMS, OPEN, TOGETHER = 0.95, 10, 64, (16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 1024), 4, 256
GRAPH_VERSION = "1"
ROW = "version string, shard int, n int, width int, beam int, ids binary, matrix binary, layers array<struct<nodes:binary,degree:int,links:binary>>"


def nearest(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's k nearest other rows by inner product, in blocks."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), max(k, 0)), np.int32)
    for i in range(0, len(x) if k > 0 else 0, 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[i : i + 1024] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
    return out


def pruned(x: np.ndarray, near: np.ndarray, links: int) -> np.ndarray:
    """Which of the neighbours stay: nearest first, unless one that stays hides it; all rows together, a neighbour at a time."""
    keep = np.zeros(near.shape, bool)
    for i in range(0, len(near), 2048):
        own, far = near[i : i + 2048], np.arange(i, min(i + 2048, len(near)))
        v = x[own]
        away = 1 - np.einsum("nd,nkd->nk", x[far], v)
        stay = np.zeros(own.shape, bool)
        for j in range(own.shape[1]):
            between = 1 - np.einsum("nd,nkd->nk", v[:, j], v[:, :j]) if j else np.zeros((len(own), 0))
            hidden = (stay[:, :j] & (HIDE * between < away[:, j, None])).any(1)
            stay[:, j] = ~hidden & (stay.sum(1) < links)
        keep[i : i + 2048] = stay
    return keep


def both_ways(near: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Padded links of each node (-1 where none), with the reverse of each."""
    a, j = np.nonzero(keep)
    b = near[a, j]
    pairs = np.unique(np.concatenate([np.stack([a, b], 1), np.stack([b, a], 1)]), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    degree = np.bincount(pairs[:, 0], minlength=len(near))
    out = np.full((len(near), max(1, int(degree.max(initial=0)))), -1, np.int32)
    out[pairs[:, 0], np.arange(len(pairs)) - np.repeat(np.cumsum(degree) - degree, degree)] = pairs[:, 1]
    return out


def layered(x: np.ndarray, rank: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(nodes, links) of each layer, the lowest first; rank is a hash of each row, links are places in nodes."""
    order = np.argsort(rank, kind="stable")
    out, nodes = [], np.arange(len(x))
    while True:
        own = x[nodes]
        near = nearest(own, NEAR)
        out.append((nodes.astype(np.int32), both_ways(near, pruned(own, near, LINKS))))
        if len(nodes) <= 4 * THIN:
            return out
        nodes = np.sort(order[: len(nodes) // THIN])


def beam_search(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, scores, looked): the beam of each query, best first (-1 where it is not full), and how many rows it was compared with."""
    n = len(q)
    rows = np.zeros((n, 1), np.int64)  # the top layer's first node
    looked = np.zeros(n, np.int64)
    score = np.zeros((n, 1))
    every = np.arange(n)[:, None]
    for depth, (nodes, links) in reversed(list(enumerate(layers))):
        width = beam if depth == 0 else min(beam, 4)
        place = np.searchsorted(nodes, nodes[rows] if depth == len(layers) - 1 else rows)
        score = np.einsum("nd,nkd->nk", q, x[nodes[place]])
        if depth == len(layers) - 1:
            looked += 1
        seen, opened = np.zeros((n, len(nodes) + 1), bool), np.zeros((n, len(nodes) + 1), bool)
        seen[every, place] = True
        seen[:, -1] = opened[:, -1] = True  # stands for places that are empty
        if place.shape[1] < width:
            gap = width - place.shape[1]
            place, score = np.pad(place, ((0, 0), (0, gap)), constant_values=len(nodes)), np.pad(score, ((0, 0), (0, gap)), constant_values=-np.inf)
        while True:
            closed = opened[every, place]
            if closed.all():
                break
            best = np.argsort(np.where(closed, np.inf, -score), axis=1, kind="stable")[:, :OPEN]
            at = np.where(np.take_along_axis(closed, best, 1), len(nodes), np.take_along_axis(place, best, 1))
            opened[every, at] = True
            new = np.where((at < len(nodes))[:, :, None], links[np.minimum(at, len(nodes) - 1)], -1).reshape(n, -1)
            new = np.where(new < 0, len(nodes), new)
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = len(nodes)
            new = np.where(seen[every, new], len(nodes), new)
            seen[every, new] = True
            fresh = new < len(nodes)
            looked += fresh.sum(1)
            if not fresh.any():
                continue
            i, j = np.nonzero(fresh)
            s = np.full(new.shape, -np.inf)
            s[i, j] = np.einsum("kd,kd->k", q[i], x[nodes[new[i, j]]])
            place, score = np.hstack([place, new]), np.hstack([score, s])
            top = np.argsort(-score, axis=1, kind="stable")[:, :width]
            place, score = np.take_along_axis(place, top, 1), np.take_along_axis(score, top, 1)
        rows = np.where(place < len(nodes), nodes[np.minimum(place, len(nodes) - 1)], nodes[0])
        if depth:
            rows = rows[:, : max(1, int((place < len(nodes)).sum(1).min()))]
    return np.where(place < len(nodes), rows, -1), score, looked


def needed_beam(x: np.ndarray, layers: list, rank: np.ndarray, recall: float) -> int:
    """The narrowest beam that finds `recall` of the TRIAL_K nearest other rows of TRIALS rows of the shard."""
    k = min(TRIAL_K, len(x) - 1)
    if k < 1:
        return BEAMS[0]
    asked = np.argsort(rank, kind="stable")[-TRIALS:]
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    exact = np.argpartition(-s, k - 1, axis=1)[:, :k]
    for beam in BEAMS:
        rows, _, _ = beam_search(x, layers, x[asked], beam)
        hits = sum(len(set(a.tolist()) & set(b[b != own].tolist()[:k])) for a, b, own in zip(exact, rows, asked, strict=True))
        if hits >= recall * exact.size:
            return beam
    return BEAMS[-1]


def build_graph(vectors: DataFrame, path: str, shard_rows: int = SHARD_ROWS, recall: float = RECALL) -> None:
    """Write a graph of vectors (id, embedding) below `path`: a row for each shard.

    Rows without a direction (null, zero or not finite) are left out; repeated ids are rows each; an empty table gives
    no shards.
    """
    rows = checkpointed(unit(vectors), "unit-vectors")
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.select(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(shards)).cast("int").alias("shard"), F.col("id").cast("long").alias("id"), F.xxhash64("id", F.lit(3)).alias("rank"), "embedding")

    def run(got: pa.Table) -> pa.Table:
        got = got.sort_by([("id", "ascending"), ("rank", "ascending")])
        x, rank = _matrix(got.column("embedding")), got.column("rank").to_numpy()
        layers = layered(x, rank)
        beam = needed_beam(x, layers, rank, recall)
        packed = [{"nodes": a.tobytes(), "degree": links.shape[1], "links": links.tobytes()} for a, links in layers]
        row = {"version": GRAPH_VERSION, "shard": got.column("shard")[0].as_py(), "n": len(x), "width": x.shape[1], "beam": beam, "ids": got.column("id").to_numpy().tobytes(), "matrix": x.tobytes(), "layers": packed}
        return pa.Table.from_pylist([row], _schema())

    dealt.groupBy("shard").applyInArrow(run, ROW).write.mode("overwrite").parquet(path)


def _schema() -> pa.Schema:
    layer = pa.struct([("nodes", pa.binary()), ("degree", pa.int32()), ("links", pa.binary())])
    return pa.schema([("version", pa.string()), ("shard", pa.int32()), ("n", pa.int32()), ("width", pa.int32()), ("beam", pa.int32()), ("ids", pa.binary()), ("matrix", pa.binary()), ("layers", pa.list_(layer))])


def load_graph(spark: SparkSession, path: str) -> DataFrame:
    """A saved graph; another version is refused."""
    graph = spark.read.schema(ROW).parquet(path)
    if found := {r.version for r in graph.select("version").distinct().collect()} - {GRAPH_VERSION}:
        raise ValueError(f"graph of version {sorted(found)}, this reads {GRAPH_VERSION}")
    return graph


def search_graph(graph: DataFrame, queries: DataFrame, k: int, others: bool = True) -> DataFrame:
    """Approximate cosine top-k: (query, id, score, rank, looked); looked is how many rows the query was compared with, in all shards.

    Queries come to the shards in rounds of ROUND blocks of BLOCK_BYTES, and each shard's best are merged.  With
    `others` a row is no answer to itself.
    """
    asked = checkpointed(full(checkpointed(blocks(unit(queries)), "query-blocks")), "query-blocks")
    names = [r.block for r in asked.select("block").orderBy("block").collect()]  # one for each BLOCK_BYTES

    def run(batches):
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):  # copies one shard at a time
                ids, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["matrix"]).reshape(r["n"], r["width"])
                layers = [(np.frombuffer(a["nodes"], np.int32), np.frombuffer(a["links"], np.int32).reshape(-1, a["degree"])) for a in r["layers"]]
                q_ids, qs = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_matrix"]).reshape(r["q_n"], -1)
                for i in range(0, len(q_ids), TOGETHER):
                    own = q_ids[i : i + TOGETHER]
                    rows, score, looked = beam_search(x, layers, qs[i : i + TOGETHER], max(r["beam"], k + 1))
                    score = np.where(rows < 0, -np.inf, np.round(score, 6))
                    found = ids[np.maximum(rows, 0)]
                    if others:
                        score = np.where(found == own[:, None], -np.inf, score)
                    for n in range(len(own)):
                        _, col = _best(score[n : n + 1], found[n], k)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(col), own[n])), pa.array(found[n, col]), pa.array(score[n, col]), pa.array(np.full(len(col), looked[n])), pa.array(np.full(len(col), r["shard"], np.int32))], ["query", "id", "score", "looked", "shard"])

    parts = []
    for i in range(0, len(names), ROUND):
        now = asked.where(F.col("block").between(names[i], names[min(i + ROUND, len(names)) - 1])).select(*[F.col(c).alias(f"q_{c}") for c in ("n", "ids", "matrix")])
        cells = graph.crossJoin(F.broadcast(now))  # each shard meets each block of the round: ROUND * BLOCK_BYTES are sent
        found = checkpointed(cells.mapInArrow(run, "query long, id long, score double, looked long, shard int"), "graph-answers")
        sums = found.groupBy("query", "shard").agg(F.max("looked").alias("looked")).groupBy("query").agg(F.sum("looked").alias("looked"))
        parts.append(_ranked(found.drop("looked", "shard"), k).join(sums, "query").select("query", "id", "score", "rank", "looked"))
    if not parts:
        return queries.sparkSession.createDataFrame([], "query long, id long, score double, rank int, looked long")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def looked_by_lists(index: tuple[DataFrame, DataFrame], queries: DataFrame) -> DataFrame:
    """(query, looked): the centres and rows that the inverted file compares each query with."""
    lists, _ = index
    rows = sorted(lists.collect(), key=lambda r: r.list)  # a row for each list
    centres, sizes, n = np.array([r.centre for r in rows]), np.array([r.rows for r in rows]), rows[0].probe if rows else 0

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            near = np.argsort(-(x @ centres.T - (centres**2).sum(1) / 2), axis=1, kind="stable")[:, :n] if len(x) else np.zeros((0, n), int)
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), pa.array(sizes[near].sum(1).astype(np.int64) + len(centres))], ["query", "looked"])

    return unit(queries).mapInArrow(run, "query long, looked long")


def compare(vectors: DataFrame, queries: DataFrame, path: str, exact: DataFrame, k: int) -> DataFrame:
    """(index, recall, looked, p95_looked) of the graph and of an inverted file over the same rows: shares of the rows that a query is compared with."""
    from wayfare.operators.evaluate import overlap_at_k
    from wayfare.operators.vectors import build_index

    spark = vectors.sparkSession
    build_graph(vectors, f"{path}/graph")
    build_index(vectors, f"{path}/lists")
    index = load_index(spark, f"{path}/lists")
    n = F.lit(float(max(1, vectors.count())))
    found = checkpointed(search_graph(load_graph(spark, f"{path}/graph"), queries, k), "graph-found")
    out = None
    for name, got, looked in (("graph", found, found.select("query", "looked").distinct()), ("lists", search_index(index, queries, k), looked_by_lists(index, queries))):
        one = overlap_at_k(got, exact, k).agg(F.avg("recall").alias("recall")).join(looked.agg((F.avg("looked") / n).alias("looked"), (F.percentile_approx("looked", 0.95) / n).alias("p95_looked")))
        one = one.select(F.lit(name).alias("index"), "recall", "looked", "p95_looked")
        out = one if out is None else out.unionByName(one)
    return out
