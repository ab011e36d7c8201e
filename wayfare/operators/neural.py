"""Distributed stochastic gradient descent over blocks, BPR factorisation by it, and top-k lists of factors.

Users and items are hashed into equally many blocks.  In each of as many rounds, user block u meets item block
(u + round) mod blocks in one task, with the pairs between the two: no two tasks touch the same row, so steps need no
locks, and an epoch has seen every pair.  Pairs are written once by round, and a round reads its own.  Category
vectors that several tasks need travel with each, and their copies are averaged by use.  Rows carry their optimiser's
state with their factors, so it outlives rounds.  The driver holds dense weights only, whose size does not depend on the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.operators.vectors import inner_topk
from wayfare.sources.tables import checkpointed, scratch

#: Pairs that meet in a task, on average.
GROUP_PAIRS = 200_000
USER, ITEM, PAIR, WEIGHTS, CATEGORY = range(5)
ROW = "kind int, id long, other long, f array<double>, x array<double>, c array<long>"


def empty(kind: str):
    return F.array().cast(f"array<{kind}>")


def start_rows(rows: DataFrame, kind: int, size: int, seed: int, state: float | None = None) -> DataFrame:
    """(kind, id, other, f, x, c) of rows (id[, x][, c]) with hashed small factors, and as many places of optimiser state where it is given."""
    draw = lambda j: (F.pmod(F.xxhash64(F.lit(seed + kind), F.col("id"), j), F.lit(2**31)) / float(2**31) - 0.5) * 0.35
    f = F.transform(F.sequence(F.lit(1), F.lit(size)), draw)
    if state is not None:
        f = F.concat(f, F.array_repeat(F.lit(state), size))
    x, c = (F.col(n) if n in rows.columns else empty(t) for n, t in (("x", "double"), ("c", "long")))
    return rows.select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), F.lit(0).cast("long").alias("other"), f.alias("f"), x.alias("x"), c.alias("c"))


def _stack(t: pa.Table, column: str) -> np.ndarray:
    """A list column of one length as a matrix."""
    if not t.num_rows:
        return np.zeros((0, 0))
    flat = t.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(t.num_rows, -1)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.reshape(-1).astype(float)))


def _trainer(step: Callable, weights: np.ndarray | None, seed: int):
    """One task's share of a round, as a function of the rows that meet."""

    def run(got: pa.Table) -> pa.Table:
        kind = got.column("kind").to_numpy()
        part = {k: got.filter(pa.array(kind == k)).sort_by([("id", "ascending"), ("other", "ascending")]) for k in (USER, ITEM, PAIR, CATEGORY)}
        side = {k: {"ids": part[k].column("id").to_numpy(), "f": _stack(part[k], "f"), "x": _stack(part[k], "x")} for k in (USER, ITEM, CATEGORY)}
        for k in (USER, ITEM):
            side[k]["c"] = np.searchsorted(side[CATEGORY]["ids"], _stack(part[k], "c").astype(np.int64))
        p = part[PAIR]
        both = {"u": np.searchsorted(side[USER]["ids"], p.column("id").to_numpy()), "i": np.searchsorted(side[ITEM]["ids"], p.column("other").to_numpy()), "x": _stack(p, "x")}
        new, used = weights, np.zeros(len(side[CATEGORY]["ids"]))
        if p.num_rows:
            side[USER]["f"], side[ITEM]["f"], side[CATEGORY]["f"], new = step(side[USER], side[ITEM], side[CATEGORY], both, weights, seed)
            for k, at in ((USER, both["u"]), (ITEM, both["i"])):
                np.add.at(used, side[k]["c"][at].reshape(-1).astype(np.int64), 1.0)
        out = [pa.table({"kind": pa.array([k] * part[k].num_rows, pa.int32()), "id": part[k].column("id"), "other": part[k].column("other"), "f": _lists(side[k]["f"]), "x": part[k].column("x") if k != CATEGORY else _lists(used[:, None]), "c": part[k].column("c")}) for k in (USER, ITEM, CATEGORY) if part[k].num_rows]
        if new is not None and p.num_rows:
            out.append(pa.table({"kind": pa.array([WEIGHTS], pa.int32()), "id": pa.array([p.num_rows], pa.int64()), "other": pa.array([0], pa.int64()), "f": pa.array([new], pa.list_(pa.float64())), "x": pa.array([[]], pa.list_(pa.float64())), "c": pa.array([[]], pa.list_(pa.int64()))}))
        return pa.concat_tables(out) if out else got.select(["kind", "id", "other", "f", "x", "c"]).slice(0, 0)

    return run


def _averaged(copies: DataFrame) -> DataFrame:
    """Category rows: the mean of their copies, by how many pairs used each; x holds that number."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    mean = vector_to_array(Summarizer.mean(array_to_vector("f"), F.col("x")[0] + 1e-6))
    return copies.groupBy("id").agg(mean.alias("f")).select(F.lit(CATEGORY).alias("kind"), "id", F.lit(0).cast("long").alias("other"), "f", empty("double").alias("x"), empty("long").alias("c"))


def train_blocks(state: DataFrame, pairs: DataFrame, step: Callable, epochs: int, weights: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray | None]:
    """The state, and the dense weights, after so many epochs; state: ROW of users, items and categories, pairs: (id, other[, x]).

    step(users, items, categories, pairs, weights, seed) trains one task's share, with tables of columns ids, f, x and c (places
    of a row's categories), and returns the new factors of all three and the new weights; the tasks' weights are averaged after each round.
    """
    x = F.col("x") if "x" in pairs.columns else empty("double")
    spark = pairs.sparkSession
    rows = checkpointed(pairs.select(F.lit(PAIR).alias("kind"), F.col("id").cast("long").alias("id"), F.col("other").cast("long").alias("other"), empty("double").alias("f"), x.alias("x"), empty("long").alias("c")), "pairs")
    n = max(1, math.ceil(math.sqrt(rows.count() / GROUP_PAIRS)))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    where = scratch(spark, "pairs-by-round")
    rows.withColumn("g", block("id")).withColumn("round", F.pmod(block("other") - block("id"), F.lit(n))).write.partitionBy("round").parquet(where)
    meeting = spark.read.parquet(where)
    state = checkpointed(state, "factors")
    with_categories = not state.where(F.col("kind") == CATEGORY).isEmpty()
    cols = ["kind", "id", "other", "f", "x", "c", "g"]
    for turn in range(epochs * n):
        shift = turn % n
        own = state.where(F.col("kind") != CATEGORY).withColumn("g", F.when(F.col("kind") == USER, block("id")).otherwise(F.pmod(block("id") - F.lit(shift), F.lit(n))))
        meet = own.unionByName(meeting.where(F.col("round") == shift).select(*cols))
        if with_categories:
            needed = own.select("g", F.explode("c").alias("id")).distinct()
            meet = meet.unionByName(state.where(F.col("kind") == CATEGORY).join(needed, "id").select(*cols))
        out = checkpointed(meet.groupBy("g").applyInArrow(_trainer(step, weights, turn), ROW), "factors")
        state = out.where(F.col("kind").isin(USER, ITEM))
        if with_categories:
            state = checkpointed(state.unionByName(_averaged(out.where(F.col("kind") == CATEGORY))), "factors")
        if weights is not None and (found := out.where(F.col("kind") == WEIGHTS).select("id", "f").collect()):  # a row for each task
            weights = np.average([r.f for r in found], axis=0, weights=[r.id for r in found])
    return state, weights


def factors(state: DataFrame, kind: int) -> DataFrame:
    return state.where(F.col("kind") == kind).select("id", F.col("f").alias("embedding"), "x")


def bpr_step(rate: float, decay: float, negatives: int, passes: int) -> Callable:
    def step(users, items, categories, pairs, weights, seed):
        rng = np.random.default_rng(seed)
        f, g, n = users["f"].copy(), items["f"].copy(), len(items["ids"])
        known = np.unique(pairs["u"] * n + pairs["i"])
        for _ in range(passes):
            a, p = np.repeat(pairs["u"], negatives), np.repeat(pairs["i"], negatives)
            q = rng.integers(0, n, len(a))
            fresh = ~np.isin(a * n + q, known)
            a, p, q = a[fresh], p[fresh], q[fresh]
            for part in np.array_split(rng.permutation(len(a)), max(1, len(a) // 1024)):
                u, i, j = a[part], p[part], q[part]
                w = 1 / (1 + np.exp((f[u] * (g[i] - g[j])).sum(1)))[:, None]
                du, di, dj = w * (g[i] - g[j]) - decay * f[u], w * f[u] - decay * g[i], -w * f[u] - decay * g[j]
                du[:, -1] = 0  # the users' last place is 1, so the items' is a bias
                np.add.at(f, u, rate * du)
                np.add.at(g, i, rate * di)
                np.add.at(g, j, rate * dj)
        return f, g, categories["f"], weights

    return step


def fit_bpr(pairs: DataFrame, dim: int = 32, epochs: int = 5, passes: int = 4, rate: float = 0.05, decay: float = 1e-4, negatives: int = 4, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Bayesian personalised ranking of pairs (user_id, item_id): (id, embedding) of users and of items, last place the bias.

    Negatives are drawn uniformly from the items of the pair's block; known pairs are rejected.
    """
    pairs = pairs.select(F.col("user_id").alias("id"), F.col("item_id").alias("other")).distinct()
    users, items = start_rows(pairs.select("id").distinct(), USER, dim + 1, seed), start_rows(pairs.select(F.col("other").alias("id")).distinct(), ITEM, dim + 1, seed)
    users = users.withColumn("f", F.concat(F.slice("f", 1, dim), F.array(F.lit(1.0))))
    items = items.withColumn("f", F.concat(F.slice("f", 1, dim), F.array(F.lit(0.0))))
    state, _ = train_blocks(users.unionByName(items), pairs, bpr_step(rate, decay, negatives, passes), epochs)
    return factors(state, USER).drop("x"), factors(state, ITEM).drop("x")


FACTORS_VERSION = "1"


def save_factors(users: DataFrame, items: DataFrame, path: str) -> None:
    """The vectors (id, embedding) of both sides, under a version."""
    for side, rows in (("user", users), ("item", items)):
        rows.select(F.lit(FACTORS_VERSION).alias("version"), F.lit(side).alias("side"), "id", "embedding").write.mode("overwrite" if side == "user" else "append").parquet(path)


def load_factors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Saved vectors of users and of items; another version is refused."""
    rows = spark.read.parquet(path)
    if found := {r.version for r in rows.select("version").distinct().collect()} - {FACTORS_VERSION}:
        raise ValueError(f"factors of version {sorted(found)}, this reads {FACTORS_VERSION}")
    return rows.where("side = 'user'").select("id", "embedding"), rows.where("side = 'item'").select("id", "embedding")


def factor_topk(users: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(user_id, item_id, score, rank): each user's k best items; both sides (id, embedding).  Users without a vector get no rows."""
    found = inner_topk(users, items, k, digits=9, others=False)
    return found.select(F.col("query").alias("user_id"), F.col("id").alias("item_id"), "score", "rank")
