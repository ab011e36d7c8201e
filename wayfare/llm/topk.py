"""Exact top-k inner products by MaxScore.

Vectors become integers and are laid out in shards, which stay where they are: each keeps, for every dimension, its
postings in order of their values.  Queries come to the shards in rounds of bounded blocks.  For a query, the bounds
of its terms' contributions and the score to beat split the terms: those whose bounds together can't reach that score
are non-essential.  The essential terms' postings are walked from their high ends as far as a row can still win; the
rows found are summed over the essential terms, and the other terms are probed only while a row is competitive.  The
score to beat is first the k-th best of the seed shards (each partition's first rows), so later shards send little.
Each shard sends its k best at most, and those are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table

K, EVERY, SCALE = 5, 50, 256
#: Rows in a seed shard; bytes in another shard and in a block of queries; blocks of queries that are broadcast in one round.
SEED_ROWS, SHARD_BYTES, BLOCK_BYTES, ROUND = 2048, 8_000_000, 8_000_000, 8
#: Steps in which non-essential terms are probed.
STEPS = 4
EXACT = 2.0**53
LONG = 2**63 - 1


def layout(vectors: DataFrame, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """(kind, block, n, d, small, ids, none, rows, matrix): integer vectors in shards, and those of the queries again in blocks.

    Vectors that are null or hold null or non-finite components are left out; shorter ones are filled with 0.  ids are
    vec_ids (none marks null ones), rows number the table's rows; matrix holds 32-bit integers where they fit, else
    the components as they came.
    """
    ok = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))

    def run(batches):
        part, seen, number = TaskContext.get().partitionId(), 0, 0
        held: dict[str, list] = {"shard": [], "query": []}
        limit = {"shard": SHARD_BYTES, "query": BLOCK_BYTES}

        def flush(kind, name):
            nonlocal number
            got, held[kind] = held[kind], []
            d = max(len(v) for _, _, v in got)
            m = np.zeros((len(got), d))
            for i, (_, _, v) in enumerate(got):
                m[i, : len(v)] = v
            with np.errstate(over="ignore"):
                whole = np.floor(m * scale)
            small = bool(np.abs(whole).max(initial=0) < 2**31)
            number += 1
            ids = np.array([i or 0 for i, _, _ in got], np.int64)
            none = np.array([i is None for i, _, _ in got], np.uint8)
            at = np.array([r for _, r, _ in got], np.int64)
            values = ([name], [(part << 24) + number], [len(got)], [d], [small], [ids.tobytes()], [none.tobytes()], [at.tobytes()], [(whole.astype(np.int32) if small else m).tobytes()])
            types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], COLUMNS)

        size, first = {"shard": 0, "query": 0}, True
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = (i, (part << 32) + seen, v.values.to_numpy(zero_copy_only=False).astype(float))
                seen += 1
                for kind in ("shard", "query") if i is not None and i % every == 0 else ("shard",):
                    held[kind].append(row)
                    size[kind] += 4 * len(row[2])
                    full = kind == "shard" and first and len(held[kind]) == SEED_ROWS
                    if full or size[kind] >= limit[kind]:
                        yield flush(kind, "seed" if kind == "shard" and first else kind)
                        size[kind] = 0
                        first = first and kind != "shard"
        for kind in ("shard", "query"):
            if held[kind]:
                yield flush(kind, "seed" if kind == "shard" and first else kind)

    return rows.mapInArrow(run, "kind string, block long, n int, d int, small boolean, ids binary, none binary, rows binary, matrix binary")


COLUMNS = ["kind", "block", "n", "d", "small", "ids", "none", "rows", "matrix"]


class Shard:
    """Rows as columns of integers, and each dimension's postings in order of their values."""

    def __init__(self, x: np.ndarray):
        self.x = np.ascontiguousarray(x.T, dtype=float)
        self.order = np.argsort(self.x, axis=1, kind="stable").astype(np.int32)
        self.low, self.high = (self.x.min(1), self.x.max(1)) if x.size else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
        self.n = len(x)

    def postings(self, d: int, least: float, up: bool) -> np.ndarray:
        """The rows whose value in d is at least (or at most) that."""
        order, values = self.order[d], self.x[d]
        at, end = 0, self.n
        while at < end:
            mid = (at + end) // 2
            at, end = (mid + 1, end) if (values[order[mid]] < least if up else values[order[mid]] <= least) else (at, mid)
        return order[at:] if up else order[:at]


def max_score(shard, q: np.ndarray, k: int, own: np.ndarray, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of all rows of the shard that can be among the k best for q with a score of `least` or more.

    own: rows that may not count.  Sums are of integers below 2^53, so floating-point arithmetic is exact.
    """
    shard = shard if isinstance(shard, Shard) else Shard(shard)
    low, high = np.minimum(shard.low * q, shard.high * q), np.maximum(shard.low * q, shard.high * q)
    spread, need = high - low, least - low.sum()
    order = np.argsort(-spread, kind="stable")
    rest = np.append(spread[order][::-1].cumsum()[::-1], 0.0)  # what the terms from each place on can add
    # Non-essential: the longest tail of terms that can't reach the score by itself.
    cut = int(np.argmax(rest < need)) if rest[-1] < need else len(order)
    if need > rest[0]:
        return np.zeros(0, np.int64), np.zeros(0)
    essential, other = order[:cut], order[cut:]
    # A row that wins has this share of the spread of one essential term at least.
    share = (need - rest[cut]) / max(rest[0] - rest[cut], 1e-300) - 1e-9
    mask = np.zeros(shard.n, bool)
    if share <= 0 or not len(essential):
        mask[:] = True
    else:
        for d in essential:
            if spread[d]:
                up = q[d] > 0
                edge = shard.low[d] + share * (shard.high[d] - shard.low[d]) if up else shard.high[d] - share * (shard.high[d] - shard.low[d])
                mask[shard.postings(d, edge, up)] = True
    mask[own] = False
    alive = np.flatnonzero(mask)
    whole = len(alive) == shard.n
    partial = q[essential] @ (shard.x[essential] if whole else shard.x[np.ix_(essential, alive)])
    for step in np.array_split(other, STEPS) if len(other) else []:
        if len(partial) > k:
            least = max(least, np.partition(partial, -k)[-k] + low[other].sum())
        keep = partial + high[other].sum() >= least
        alive, partial = alive[keep], partial[keep]
        if len(step):
            partial = partial + q[step] @ shard.x[np.ix_(step, alive)]
            other = other[len(step) :]
    if len(partial) > k:
        least = max(least, np.partition(partial, -k)[-k])
    keep = partial >= least
    return alive[keep], partial[keep]


def all_scores(x: np.ndarray, q: np.ndarray) -> list[int]:
    """Exact scores of integers of any size, held within a long's range."""
    scores = x.dot(q) if x.size else [0] * len(x)
    return [max(-LONG - 1, min(LONG, int(s))) for s in scores]


def _matrix(r: dict, scale: int, p: str = "") -> np.ndarray:
    """The integers as floats; infinite beyond their range."""
    m = np.frombuffer(r[f"{p}matrix"], np.int32 if r[f"{p}small"] else np.float64).reshape(r[f"{p}n"], r[f"{p}d"]).astype(np.float64)
    with np.errstate(over="ignore"):
        return m if r[f"{p}small"] else np.floor(m * scale)


def _integers(r: dict, scale: int, width: int, p: str = "") -> np.ndarray:
    """The integers as Python's, which have no range; components from 2^53 on are integers themselves."""
    m = np.frombuffer(r[f"{p}matrix"], np.int32 if r[f"{p}small"] else np.float64).reshape(r[f"{p}n"], r[f"{p}d"])
    one = int if r[f"{p}small"] else lambda x: int(x) * scale if abs(x) >= EXACT else math.floor(x * scale)
    out = np.full((len(m), width), 0, dtype=object)
    out[:, : m.shape[1]] = [[one(x) for x in row] for row in m.tolist()]
    return out


def search(shards: DataFrame, queries: DataFrame, k: int, scale: int = SCALE) -> DataFrame:
    """(block, row, query_id, vec_id, score): the k best of each shard for each query, unless they can't win; queries: few blocks, with thetas.

    Each shard meets each block of the round: a stated query set in ROUND blocks of BLOCK_BYTES at most, against all rows.
    """
    cols = ["n", "d", "small", "ids", "rows", "matrix", "block", "thetas"]
    cells = shards.crossJoin(F.broadcast(queries.select(*[F.col(c).alias(f"q_{c}") for c in cols])))

    def run(batches):
        held, last = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                x, qs = _matrix(r, scale), _matrix(r, scale, "q_")
                d = max(x.shape[1], qs.shape[1])
                x, qs = (np.pad(m, ((0, 0), (0, d - m.shape[1]))) for m in (x, qs))
                if last != (r["block"], d):
                    held, last = Shard(x), (r["block"], d)
                ids, none, number = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["none"], np.uint8), np.frombuffer(r["rows"], np.int64)
                q_ids, q_rows = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_rows"], np.int64)
                where = {n: j for j, n in enumerate(number.tolist())}
                theta = dict(zip(r["q_thetas"]["rows"], r["q_thetas"]["scores"], strict=True)) if r["q_thetas"] else {}
                most = np.abs(x).max(initial=0)
                out, exact = [], None
                for j, (row, query, v) in enumerate(zip(q_rows.tolist(), q_ids.tolist(), qs, strict=True)):
                    own = where.get(row)
                    if max(most, 1) * np.abs(v).sum() < EXACT and most < np.inf:
                        alive, score = max_score(held, v, k, np.array([] if own is None else [own], int), theta.get(row, -np.inf))
                        score = score.astype(np.int64)
                        best = np.lexsort((ids[alive], none[alive], -score))[:k]
                        found = zip(alive[best].tolist(), score[best].tolist(), strict=True)
                    else:
                        exact = exact or (_integers(r, scale, d), _integers(r, scale, d, "q_"))
                        score = all_scores(exact[0], exact[1][j])
                        found = [(i, score[i]) for i in sorted((i for i in range(len(score)) if i != own), key=lambda i: (-score[i], none[i], ids[i]))[:k]]
                    out += [(r["q_block"], row, query, None if none[i] else int(ids[i]), s) for i, s in found]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], ["block", "row", "query_id", "vec_id", "score"])

    return cells.mapInArrow(run, "block long, row long, query_id long, vec_id long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, its k best other rows.

    Ties go to the smaller vec_id, null vec_ids last; a repeated vec_id is a candidate and a query each time it
    occurs.  Fewer than k other vectors give fewer rows; an empty table gives none.  Empty vectors score 0.  Scores
    beyond a long's range are held at its ends and tie there.  Columns other than vec_id and embedding are not read.
    """
    laid = staged(layout(vectors, every, scale), "vector-shards")
    blocks = [r.block for r in laid.where("kind = 'query'").select("block").orderBy("block").collect()]  # one for each BLOCK_BYTES of queries
    parts = []
    for i in range(0, len(blocks), ROUND):
        queries = laid.where(F.col("kind") == "query").where(F.col("block").between(blocks[i], blocks[min(i + ROUND, len(blocks)) - 1]))
        none = F.lit(None).cast("struct<rows:array<bigint>,scores:array<bigint>>")
        seeds = staged(best(search(laid.where("kind = 'seed'"), queries.withColumn("thetas", none), k, scale), k), "seed-scores")
        least = seeds.where(F.col("rank") == k).groupBy("block").agg(F.struct(F.collect_list("row").alias("rows"), F.collect_list("score").alias("scores")).alias("thetas"))
        with_least = queries.join(least, "block", "left")
        found = search(laid.where("kind = 'shard'"), with_least, k, scale).unionByName(seeds.drop("rank"))
        parts.append(staged(best(found, k).select("query_id", "rank", "vec_id", "score"), "best-scores"))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def op8_maxscore_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH v AS (SELECT vec_id, [floor(x::double * 256) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
