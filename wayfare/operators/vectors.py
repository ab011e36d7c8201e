"""Vector search: exact top-k in blocks, and an inverted-file index that is saved, loaded and searched by joins."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.operators.evaluate import overlap_at_k
from wayfare.sources.tables import checkpointed

#: Bytes of vectors in a block; blocks that are broadcast in one round.
BLOCK_BYTES, ROUND = 8_000_000, 8
#: The index is fitted on at most so many rows, and has at most so many lists of about LIST_ROWS rows; larger ones are dealt over shards.
FIT_ROWS, MOST_LISTS, LIST_ROWS, SHARD_ROWS = 50_000, 4096, 64, 20_000
#: Rows that a task of the fit takes, on average.
PART_ROWS = 1000
#: How many lists a query probes is set when an index is built: as many as give so much recall of PROBE_K to PROBE_QUERIES rows.
RECALL, PROBE_K, PROBE_QUERIES = 0.95, 10, 256
INDEX_VERSION = "1"


def unit(vectors: DataFrame) -> DataFrame:
    """(id, embedding) with embeddings of length 1; rows without a direction (null, zero, not finite) drop out."""
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding"), size.alias("_n"))
    rows = rows.where((F.col("_n") > 0) & (F.col("_n") < float("inf")))
    return rows.select("id", F.transform("embedding", lambda x: x / F.nullif(F.col("_n"), F.lit(0.0))).alias("embedding"))


def _matrix(column) -> np.ndarray:
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return chunk.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(chunk), -1) if len(chunk) else np.zeros((0, 0))


def blocks(vectors: DataFrame) -> DataFrame:
    """(block, n, ids, matrix): vectors of one size, in blocks of about BLOCK_BYTES."""

    def run(batches):
        part, number, ids, rows, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([(part << 24) + number]), pa.array([sum(map(len, ids))], pa.int32()), pa.array([np.concatenate(ids).tobytes()]), pa.array([np.concatenate(rows).tobytes()])], ["block", "n", "ids", "matrix"])

        for batch in batches:
            m, own = _matrix(batch.column(1)), batch.column(0).to_numpy().astype(np.int64)
            step = max(1, BLOCK_BYTES // max(8, 8 * m.shape[1]))
            for i in range(0, len(own), step):
                ids.append(own[i : i + step])
                rows.append(m[i : i + step])
                size += rows[-1].nbytes
                if size >= BLOCK_BYTES:
                    yield flush()
                    number, ids, rows, size = number + 1, [], [], 0
        if ids:
            yield flush()

    return vectors.select("id", "embedding").mapInArrow(run, "block long, n int, ids binary, matrix binary")


def full(found: DataFrame) -> DataFrame:
    """blocks() put together to about BLOCK_BYTES: each part of a table leaves a block of its own, however small, and rounds count blocks."""
    total = found.agg(F.sum(F.length("matrix"))).first()[0] or 0

    def run(batches):
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            columns = [[(part << 24) + number], [sum(r["n"] for r in held)], [b"".join(r["ids"] for r in held)], [b"".join(r["matrix"] for r in held)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "n", "ids", "matrix"])

        for batch in batches:
            for i in range(batch.num_rows):
                held += batch.slice(i, 1).to_pylist()
                size += len(held[-1]["matrix"])
                if size >= BLOCK_BYTES:
                    yield flush()
                    number, held, size = number + 1, [], 0
        if held:
            yield flush()

    return found.repartition(max(1, -(-total // BLOCK_BYTES)), "block").mapInArrow(run, "block long, n int, ids binary, matrix binary")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k best, ties to smaller ids."""
    n = min(k, scores.shape[1])
    if n < scores.shape[1]:  # all that tie with the k-th are looked at
        edge = np.partition(scores, scores.shape[1] - n, axis=1)[:, -n]
        row, col = np.nonzero((scores >= edge[:, None]) & np.isfinite(scores))
    else:
        row, col = np.nonzero(np.isfinite(scores))
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, row, "left")
    keep = np.arange(len(row)) - first < n
    return row[keep], col[keep]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def inner_topk(queries: DataFrame, vectors: DataFrame, k: int, digits: int | None = 6, others: bool = True) -> DataFrame:
    """Exact top-k by inner product: (query, id, score, rank), ties to the smaller id; both sides (id, embedding) of one length.

    The side with more blocks stays where it is; the other comes to it in rounds of ROUND broadcast blocks, so a
    round sends ROUND * BLOCK_BYTES whatever the tables' sizes.  Scores are rounded before they are ranked.  With
    `others` a row is no answer to itself.
    """
    q, v = checkpointed(blocks(queries), "query-blocks"), checkpointed(blocks(vectors), "vector-blocks")
    names = {side: [r.block for r in df.select("block").orderBy("block").collect()] for side, df in (("q", q), ("v", v))}  # one for each BLOCK_BYTES
    few = "q" if len(names["q"]) <= len(names["v"]) else "v"
    sent, stay = (q, v) if few == "q" else (v, q)
    if len(names[few]) > 1:
        sent = checkpointed(full(sent), "sent-blocks")
        names[few] = [r.block for r in sent.select("block").orderBy("block").collect()]

    def run(batches):
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):  # copies one cell at a time
                side = {p: (np.frombuffer(r[f"{p}ids"], np.int64), np.frombuffer(r[f"{p}matrix"]).reshape(r[f"{p}n"], -1)) for p in ("", "s_")}
                (q_ids, qs), (ids, x) = (side["s_"], side[""]) if few == "q" else (side[""], side["s_"])
                for i in range(0, len(q_ids), 1024):
                    scores = qs[i : i + 1024] @ x.T
                    if digits is not None:
                        scores = np.round(scores, digits)
                    if others:
                        scores[q_ids[i : i + 1024, None] == ids[None, :]] = -np.inf
                    row, col = _best(scores, ids, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[i + row]), pa.array(ids[col]), pa.array(scores[row, col])], ["query", "id", "score"])

    parts = None
    for i in range(0, len(names[few]), ROUND):
        now = sent.where(F.col("block").between(names[few][i], names[few][min(i + ROUND, len(names[few])) - 1]))
        cells = stay.crossJoin(F.broadcast(now.select(*[F.col(c).alias(f"s_{c}") for c in ("n", "ids", "matrix")])))  # each block meets each of the round
        found = _ranked(cells.mapInArrow(run, "query long, id long, score double"), k)
        if len(names[few]) > ROUND:  # each round by itself, and only its best go on
            found = checkpointed(found.drop("rank"), "round-best")
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        return queries.sparkSession.createDataFrame([], "query long, id long, score double, rank int")
    return parts if "rank" in parts.columns else _ranked(parts, k)


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact cosine top-k: (query, id, score, rank)."""
    return inner_topk(unit(queries), unit(vectors), k)


def lists_to_probe(placed: DataFrame, centres: np.ndarray, recall: float = RECALL, k: int = PROBE_K, queries: int = PROBE_QUERIES) -> int:
    """The fewest nearest lists that hold `recall` of the exact top k of so many rows in hash order; placed: (list, id, embedding)."""
    asked = placed.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(queries).select("id", "embedding")
    exact = inner_topk(asked, placed.select("id", "embedding"), k).join(placed.select("id", "list"), "id").select("query", "list").collect()
    if not exact:
        return len(centres)
    place = {}
    for r in asked.collect():
        near = np.argsort(-(centres @ np.array(r.embedding) - (centres**2).sum(1) / 2), kind="stable")
        place[r.id] = np.argsort(near)
    deep = np.sort([place[r.query][r.list] for r in exact])
    return int(deep[min(len(deep) - 1, int(np.ceil(recall * len(deep))) - 1)]) + 1


def build_index(vectors: DataFrame, path: str, lists: int | None = None, recall: float = RECALL, seed: int = 7) -> DataFrame:
    """Write an inverted-file index below `path` and return its rows: (version, list, shard, id, embedding).

    Centres come from k-means on at most FIT_ROWS rows in hash order; every row is then put in the list of its nearest
    centre.  Lists over SHARD_ROWS rows are dealt over shards by hash.  The number of lists to probe is measured
    against exact search, so it grows where vectors do not cluster.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    rows = checkpointed(unit(vectors), "unit-vectors")
    n = rows.count()
    lists = lists or int(min(MOST_LISTS, max(1, n // LIST_ROWS)))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS)
    # A limit leaves one part, in which one task would compare all these rows with all centres.
    sample = checkpointed(sample.repartition(max(1, min(n, FIT_ROWS) // PART_ROWS), "id"), "fit-vectors").select(array_to_vector("embedding").alias("features"))
    # In blocks: the row solver compares all centres with each other in every iteration, which grows with the square of the lists.
    centres = np.array(KMeans(k=lists, seed=seed, maxIter=20, solver="block").fit(sample).clusterCenters()) if n else np.zeros((0, 0))
    kind, half = "version string, list int, id long, embedding array<double>", (centres**2).sum(1) / 2

    def place(batches):
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            parts = [(x[i : i + 1024] @ centres.T - half).argmax(1) for i in range(0, len(x), 1024)]
            near = np.concatenate(parts) if parts else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array([INDEX_VERSION] * len(x)), pa.array(near.astype(np.int32)), batch.column("id").cast(pa.int64()), batch.column("embedding")], ["version", "list", "id", "embedding"])

    placed = checkpointed(rows.mapInArrow(place, kind), "placed-vectors")
    sizes = placed.groupBy("list").agg(F.count(F.lit(1)).alias("rows")).withColumn("shards", F.ceil(F.col("rows") / SHARD_ROWS).cast("int"))
    sizes = checkpointed(sizes, "list-sizes")  # one row for each list
    out = placed.join(F.broadcast(sizes.select("list", "shards")), "list").withColumn("shard", F.pmod(F.xxhash64("id"), "shards").cast("int"))
    out.select("version", "list", "shard", "id", "embedding").write.mode("overwrite").parquet(f"{path}/vectors")
    probe = lists_to_probe(placed, centres, recall) if n else 0
    centre = spark.createDataFrame([(i, [float(y) for y in c]) for i, c in enumerate(centres)], "list int, centre array<double>")
    centre.join(sizes, "list", "left").select(F.lit(INDEX_VERSION).alias("version"), F.lit(probe).alias("probe"), "list", "centre", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("shards", F.lit(0)).alias("shards")).write.mode("overwrite").parquet(f"{path}/lists")
    return spark.read.parquet(f"{path}/vectors")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lists, vectors) of a saved index; another version is refused."""
    lists, vectors = spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/vectors")
    if found := {r.version for r in lists.select("version").distinct().collect()} - {INDEX_VERSION}:
        raise ValueError(f"index of version {sorted(found)}, this reads {INDEX_VERSION}")
    return lists, vectors


def search_index(index: tuple[DataFrame, DataFrame], queries: DataFrame, k: int) -> DataFrame:
    """Approximate cosine top-k: (query, id, score, rank); each query probes the lists with the nearest centres."""
    lists, vectors = index
    rows = sorted(lists.collect(), key=lambda r: r.list)  # MOST_LISTS at most
    if not rows:
        return queries.sparkSession.createDataFrame([], "query long, id long, score double, rank int")
    centres, shards = np.array([r.centre for r in rows]), np.array([r.shards for r in rows])
    n = rows[0].probe

    def near(batches):
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            best = np.argsort(-(x @ centres.T - (centres**2).sum(1) / 2), axis=1, kind="stable")[:, :n] if len(x) else np.zeros((0, n), int)
            at, to = np.repeat(np.arange(len(x)), n), best.reshape(-1)
            at, to, times = np.repeat(at, shards[to]), np.repeat(to, shards[to]), shards[to]
            shard = np.concatenate([np.arange(t) for t in times]) if len(times) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(shard.astype(np.int32)), batch.column("id").cast(pa.int64()).take(pa.array(at)), batch.column("embedding").take(pa.array(at))], ["list", "shard", "query", "embedding"])

    asked = unit(queries).mapInArrow(near, "list int, shard int, query long, embedding array<double>")

    def score(q: pa.Table, v: pa.Table) -> pa.Table:
        cols: list = [[], [], []]
        if q.num_rows and v.num_rows:
            x, ids, q_ids, qs = _matrix(v.column("embedding")), v.column("id").to_numpy(), q.column("query").to_numpy(), _matrix(q.column("embedding"))
            for i in range(0, len(q_ids), 1024):
                s = np.round(qs[i : i + 1024] @ x.T, 6)
                s[q_ids[i : i + 1024, None] == ids[None, :]] = -np.inf
                row, col = _best(s, ids, k)
                for c, part in zip(cols, (q_ids[i + row], ids[col], s[row, col]), strict=True):
                    c.append(part)
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table([pa.array(np.concatenate(c) if c else e) for c, e in zip(cols, empty, strict=True)], ["query", "id", "score"])

    pairs = asked.groupBy("list", "shard").cogroup(vectors.select("list", "shard", "id", "embedding").groupBy("list", "shard"))
    return _ranked(pairs.applyInArrow(score, "query long, id long, score double"), k)


def benchmark(vectors: DataFrame, queries: DataFrame, path: str, k: int = 10) -> DataFrame:
    """One row: (vectors, lists, probed, queries, build_s, exact_ms, search_ms, recall); times are a query's share of a whole search."""
    spark = vectors.sparkSession
    clock = [time.time()]
    build_index(vectors, path)
    clock.append(time.time())
    index = load_index(spark, path)
    found = checkpointed(search_index(index, queries, k), "found")
    clock.append(time.time())
    exact = checkpointed(cosine_topk(queries, vectors, k), "exact")
    clock.append(time.time())
    n = max(1, queries.count())
    build, search, whole = np.diff(clock).tolist()
    recall = overlap_at_k(found, exact, k).agg(F.avg("recall")).first()[0]
    row = (vectors.count(), index[0].count(), index[0].first().probe, n, build, 1000 * whole / n, 1000 * search / n, recall)
    return spark.createDataFrame([row], "vectors long, lists long, probed long, queries long, build_s double, exact_ms double, search_ms double, recall double")
