"""Listwise boosted trees, grown by distributed sums over binned features, and exact Shapley values of their scores.

Rows are laid out once in blocks that hold whole groups: labels, and each feature's bin.  For each level of a tree
every block replays the trees so far, takes the gradients of its groups' pairs, and sends sums by node, feature and
bin.  Only those sums reach the driver, which picks the splits; their number does not depend on the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.sources.tables import checkpointed

#: Bins of a feature besides the one of undefined values; rows of a block, on average; entries of a batch of pairs.
BINS, BLOCK_ROWS, PAIR_ENTRIES = 63, 50_000, 2_000_000
#: Trees, their depth, the step, the ridge of leaves, the least rows and curvature of a leaf, the steepness of pairs.
TREES, DEPTH, RATE, RIDGE, LEAST_ROWS, LEAST_CURVATURE, SIGMA = 20, 3, 0.1, 1.0, 10, 1e-3, 1.0
#: Scores are written anew after so many trees, so that replays stay short.
SAVE_EVERY = 10
TREES_VERSION = "1"


@dataclass
class Tree:
    """A tree in heap order: node i has the children 2i + 1 and 2i + 2.  Leaves have feature -1.

    Values up to `threshold` go left, undefined ones always do; value is a leaf's, cover counts the rows that passed.
    """

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray


@dataclass
class Forest:
    """Boosted trees over named features: a row's score is the sum of its leaves."""

    features: list[str]
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[Tree] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of raw features; undefined ones are NaN."""
        return sum((t.value[places(t, x)] for t in self.trees), np.zeros(len(x)))


def places(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    at, every = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(int(np.log2(len(tree.feature) + 1)) - 1):
        f = tree.feature[at]
        right = x[every, np.maximum(f, 0)] > tree.threshold[at]  # comparisons with NaN are false
        at = np.where(f >= 0, 2 * at + 1 + right, at)
    return at


def bin_edges(rows: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Each feature's distinct approximate quantiles, bins - 1 at most."""
    steps = [i / bins for i in range(1, bins)]
    one = rows.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), steps, 10_000).alias(f"q{i}") for i, c in enumerate(features)]).first()
    return [np.unique(np.array(q, float)) if q else np.zeros(0) for q in one]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin 0 holds undefined values; bin b > 0 those above edge b - 2 and up to edge b - 1."""
    return np.stack([np.where(np.isnan(v), 0, np.searchsorted(e, v, "left") + 1) for v, e in zip(x.T, edges, strict=True)], 1).astype(np.uint8) if x.size else np.zeros(x.shape, np.uint8)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles; nulls become NaN."""
    return np.array(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), width)


def _vector(features: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])


def lay_out(rows: DataFrame, features: list[str], edges: list[np.ndarray], group: str, label: str) -> DataFrame:
    """(block, ends, label, bins, score): whole groups in blocks; group sizes are bounded where candidates are retrieved."""
    n = max(1, -(-rows.count() // BLOCK_ROWS))
    dealt = rows.select(F.xxhash64(group).alias("g"), F.col(label).cast("double").alias("y"), _vector(features).alias("x")).repartition(n, "g").sortWithinPartitions("g")

    def run(batches):
        held = list(batches)  # BLOCK_ROWS on average
        if held and (all_ := pa.Table.from_batches(held)).num_rows:
            g = all_.column("g").to_numpy()
            ends = np.append(np.flatnonzero(g[1:] != g[:-1]) + 1, len(g)).astype(np.int64)
            x = _matrix(all_.column("x").combine_chunks(), len(features))
            values = [ends, all_.column("y").to_numpy().astype(float), binned(x, edges), np.zeros(len(g))]
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()]) for v in values], ["ends", "label", "bins", "score"])

    return checkpointed(dealt.mapInArrow(run, "ends binary, label binary, bins binary, score binary"), "tree-blocks")


def listwise_gradients(score: np.ndarray, label: np.ndarray, ends: np.ndarray, sigma: float = SIGMA) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of each group's pair losses, weighted by what a swap would change in NDCG.

    Groups of one size are taken together; ties in score keep their order; groups without two labels give zeros.  Only
    rows that are labelled higher than another of their group meet the group's rows, so few positives make few pairs.
    """
    g, h = np.zeros(len(score)), np.zeros(len(score))
    starts = np.append(0, ends[:-1])
    sizes = ends - starts
    for m in np.unique(sizes[sizes > 1]):
        own = starts[sizes == m]
        above = label[own[:, None] + np.arange(m)]
        high = (above > above.min(1, keepdims=True)).sum(1)
        own, high = own[high > 0], high[high > 0]
        part = np.cumsum(high * m) // PAIR_ENTRIES
        for cut in np.split(own, np.flatnonzero(np.diff(part)) + 1) if len(own) else []:
            at = cut[:, None] + np.arange(m)
            s, y = score[at], label[at]
            row, col, weight = higher_weights(s, y)
            rho = 1 / (1 + np.exp(np.clip(sigma * (s[row, col][:, None] - s[row]), -500, 500)))
            push = sigma * rho * weight
            bend = sigma * sigma * rho * (1 - rho) * weight
            first = np.flatnonzero(np.diff(row, prepend=-1))  # each group has a row at least
            gg, hh = np.add.reduceat(push, first, 0), np.add.reduceat(bend, first, 0)
            gg[row, col] -= push.sum(1)
            hh[row, col] += bend.sum(1)
            g[at], h[at] = gg, hh
    return g, h


def swap_weights(s: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(groups, i, j): the change in NDCG if i and j swapped places, where i is labelled higher; else 0."""
    row, col, weight = higher_weights(s, y)
    out = np.zeros((*s.shape, s.shape[1]))
    out[row, col] = weight
    return out


def higher_weights(s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(groups, rows i, (rows, j)): swap_weights() of the rows that are labelled higher than another of their group."""
    m = s.shape[1]
    place = np.empty(s.shape, np.int64)
    np.put_along_axis(place, np.argsort(-s, axis=1, kind="stable"), np.arange(m)[None, :], axis=1)
    discount, gain = 1 / np.log2(place + 2), 2.0**y - 1
    ideal = (-np.sort(-gain, axis=1) / np.log2(np.arange(m) + 2)).sum(1)
    row, col = np.nonzero(y > y.min(1, keepdims=True))
    change = np.abs((gain[row, col][:, None] - gain[row]) * (discount[row, col][:, None] - discount[row])) / np.maximum(ideal[row], 1e-12)[:, None]
    return row, col, np.where(y[row, col][:, None] > y[row], change, 0.0)


def _read(r: dict, width: int) -> tuple[np.ndarray, ...]:
    ends, label, score = np.frombuffer(r["ends"], np.int64), np.frombuffer(r["label"]), np.frombuffer(r["score"])
    return ends, label, np.frombuffer(r["bins"], np.uint8).reshape(-1, width), score


def histograms(blocks: DataFrame, since: list[Tree], growing: Tree, level: range, width: int, sigma: float) -> dict[int, np.ndarray]:
    """node -> (features, bins, 3): sums of gradients, curvatures and rows of the nodes of a level; trees are over bins."""
    slots = BINS + 2

    def run(batches):
        total = np.zeros((len(level), width, slots, 3))
        for batch in batches:
            for r in batch.to_pylist():
                ends, label, bins, score = _read(r, width)
                x = bins.astype(float)
                score = score + sum((t.value[places(t, x)] for t in since), np.zeros(len(x)))
                g, h = listwise_gradients(score, label, ends, sigma)
                node = places(growing, x) - level.start
                inside = (node >= 0) & (node < len(level))
                for f in range(width):
                    key = node[inside] * slots + bins[inside, f]
                    for c, v in enumerate((g[inside], h[inside], None)):
                        total[:, f, :, c] += np.bincount(key, v, len(level) * slots).reshape(len(level), slots)
        for n, own in enumerate(total):
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([level.start + n], pa.int32()), pa.array([own.reshape(-1)], pa.list_(pa.float64()))], ["node", "sums"])

    n = width * slots * 3
    parts = blocks.mapInArrow(run, "node int, sums array<double>").select("node", F.posexplode("sums").alias("i", "v")).where("v <> 0")
    found = {k: np.zeros(n) for k in level}
    for r in parts.groupBy("node", "i").agg(F.sum("v").alias("v")).collect():  # at most 2^depth * features * bins * 3 rows
        found[r.node][r.i] = r.v
    return {k: v.reshape(width, slots, 3) for k, v in found.items()}


def best_split(sums: np.ndarray, ridge: float, least_rows: int) -> tuple[float, int, int]:
    """(gain, feature, last bin of the left side) of the best split; gain 0 where none is allowed."""
    left = sums.cumsum(1)
    whole = left[:, -1:, :]
    right = whole - left
    worth = lambda x: x[..., 0] ** 2 / (x[..., 1] + ridge)
    gain = worth(left) + worth(right) - worth(whole)
    allowed = (np.minimum(left[..., 2], right[..., 2]) >= least_rows) & (np.minimum(left[..., 1], right[..., 1]) >= LEAST_CURVATURE)
    gain = np.where(allowed, gain, 0.0)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return (float(gain[f, b]), int(f), int(b)) if gain[f, b] > 1e-12 else (0.0, -1, 0)


def grow(blocks: DataFrame, since: list[Tree], edges: list[np.ndarray], depth: int, rate: float, ridge: float, least_rows: int, sigma: float) -> Tree:
    """The next tree over bins, level by level."""
    n = 2 ** (depth + 1) - 1
    tree = Tree(np.full(n, -1), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n))
    open_ = {0}
    for d in range(depth + 1):
        level = range(2**d - 1, 2 ** (d + 1) - 1)
        found = histograms(blocks, since, tree, level, len(edges), sigma)
        split = []
        for k in sorted(open_):
            g, h, rows = found[k][0].sum(0)
            tree.value[k], tree.cover[k] = -rate * g / (h + ridge), rows
            gain, f, b = best_split(found[k], ridge, least_rows) if d < depth else (0.0, -1, 0)
            if f >= 0:
                tree.feature[k], tree.threshold[k], tree.gain[k] = f, b, gain
                split.append(k)
        if not split:
            break
        open_ = {c for k in split for c in (2 * k + 1, 2 * k + 2)}
    tree.value[tree.feature >= 0] = 0.0
    return tree


def fit_listwise(rows: DataFrame, features: list[str], group: str = "user_id", label: str = "label", trees: int = TREES, depth: int = DEPTH, rate: float = RATE, ridge: float = RIDGE, least_rows: int = LEAST_ROWS, sigma: float = SIGMA, bins: int = BINS) -> Forest:
    """Boosted trees that order the rows of each group by their labels.

    Undefined features are a bin of their own, left of all others.  Groups with one label teach nothing; an empty
    table gives no trees.
    """
    edges = bin_edges(rows, features, bins)
    forest = Forest(list(features), edges)
    blocks = lay_out(rows, features, edges, group, label)
    since: list[Tree] = []
    width = len(features)
    for n in range(trees):
        tree = grow(blocks, since, edges, depth, rate, ridge, least_rows, sigma)
        if tree.feature[0] < 0:
            break
        since.append(tree)
        back = np.array([edges[f][int(b) - 1] if f >= 0 and 0 < b <= len(edges[f]) else -np.inf if f >= 0 else 0.0 for f, b in zip(tree.feature, tree.threshold, strict=True)])
        forest.trees.append(Tree(tree.feature, back, tree.value, tree.cover, tree.gain))
        if len(since) >= SAVE_EVERY and n + 1 < trees:
            blocks, since = checkpointed(_with_scores(blocks, since, width), "tree-blocks"), []
    return forest


def _with_scores(blocks: DataFrame, since: list[Tree], width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                _, _, bins, score = _read(r, width)
                x = bins.astype(float)
                score = score + sum((t.value[places(t, x)] for t in since), np.zeros(len(x)))
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (r["ends"], r["label"], r["bins"], score.tobytes())], ["ends", "label", "bins", "score"])

    return blocks.mapInArrow(run, "ends binary, label binary, bins binary, score binary")


def scores(forest: Forest) -> Column:
    """The score of a row, from its features' columns."""
    width = len(forest.features)

    @F.arrow_udf("double")
    def run(x: pa.Array) -> pa.Array:
        return pa.array(forest.score(_matrix(x, width)))

    return run(_vector(forest.features))


def gains(forest: Forest) -> list[tuple[str, float]]:
    """(feature, share of all splits' gain), largest first."""
    total = np.zeros(len(forest.features))
    for t in forest.trees:
        np.add.at(total, t.feature[t.feature >= 0], t.gain[t.feature >= 0])
    return sorted(zip(forest.features, (total / max(total.sum(), 1e-300)).tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def leaf_paths(tree: Tree) -> list[tuple[int, float, list[tuple[int, list[tuple[int, bool]], float]]]]:
    """For each leaf: (node, value, steps); a step is a feature, its (node, goes right) splits, and the share of rows that take them."""
    out = []

    def walk(at: int, steps: dict[int, tuple[list, float]]) -> None:
        f = int(tree.feature[at])
        if f < 0:
            out.append((at, float(tree.value[at]), [(k, s, share) for k, (s, share) in steps.items()]))
            return
        for right in (False, True):
            child = 2 * at + 1 + right
            splits, share = steps.get(f, ([], 1.0))
            walk(child, {**steps, f: ([*splits, (at, right)], share * tree.cover[child] / max(tree.cover[at], 1e-300))})

    walk(0, {})
    return out


def shapley(forest: Forest, x: np.ndarray) -> tuple[float, np.ndarray]:
    """(base, (rows, features)): exact Shapley values where a split on an unknown feature is passed by the share of rows.

    Along a leaf's path only its own m features matter.  The number of ways in which k of the others are known is a
    coefficient of the product of (share + passes * z) over them, and k!(m - k - 1)!/m! weighs it.  All rows are taken
    together, so the steps are few array operations for each leaf.
    """
    out, base = np.zeros((len(x), len(forest.features))), 0.0
    for tree in forest.trees:
        goes_right = {int(k): x[:, tree.feature[k]] > tree.threshold[k] for k in np.flatnonzero(tree.feature >= 0)}
        for _, value, steps in leaf_paths(tree):
            base += value * float(np.prod([share for *_, share in steps]))
            passes = [np.logical_and.reduce([goes_right[k] == right for k, right in splits]).astype(float) for _, splits, _ in steps]
            m = len(steps)
            for i, (f, _, share) in enumerate(steps):
                ways = [np.ones(len(x))]  # by how many of the others are known
                for j, (*_, other) in enumerate(steps):
                    if j != i:
                        ways = [(ways[k] * other if k < len(ways) else 0.0) + (ways[k - 1] * passes[j] if k else 0.0) for k in range(len(ways) + 1)]
                weight = sum(w * (factorial(k) * factorial(m - k - 1) / factorial(m)) for k, w in enumerate(ways))
                out[:, f] += value * (passes[i] - share) * weight
    return base, out


def explain(rows: DataFrame, forest: Forest, top: int, keys: tuple[str, ...] = ("user_id", "item_id")) -> DataFrame:
    """(keys, base, rest, reasons): the `top` features by what they add to a row's score, and what the others add together.

    base, rest and the reasons' values add up to the score.
    """
    width, names = len(forest.features), forest.features
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for batch in batches:
            base, parts = shapley(forest, _matrix(batch.column(len(keys)), width))
            best = np.argsort(-np.abs(parts), axis=1, kind="stable")[:, :top]
            values = np.take_along_axis(parts, best, 1)
            reasons = pa.StructArray.from_arrays([pa.array(np.array(names)[best.reshape(-1)], pa.string()), pa.array(values.reshape(-1))], ["feature", "value"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, best.size + 1, max(1, best.shape[1])), pa.int32()), reasons)
            rest = parts.sum(1) - values.sum(1)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(np.full(len(parts), base)), pa.array(rest), lists], [*keys, "base", "rest", "reasons"])

    return rows.select(*keys, _vector(names).alias("x")).mapInArrow(run, f"{kinds}, base double, rest double, reasons array<struct<feature:string,value:double>>")


def save_forest(spark: SparkSession, forest: Forest, path: str) -> None:
    """A row for each node, under a version."""
    nodes = [(TREES_VERSION, n, k, int(t.feature[k]), float(t.threshold[k]), float(t.value[k]), float(t.cover[k]), float(t.gain[k])) for n, t in enumerate(forest.trees) for k in range(len(t.feature))]
    spark.createDataFrame(nodes, "version string, tree int, node int, feature int, threshold double, value double, cover double, gain double").write.mode("overwrite").parquet(f"{path}/nodes")
    names = [(TREES_VERSION, i, c) for i, c in enumerate(forest.features)]
    spark.createDataFrame(names, "version string, place int, feature string").write.mode("overwrite").parquet(f"{path}/features")


def load_forest(spark: SparkSession, path: str) -> Forest:
    """A saved forest; another version is refused."""
    names = spark.read.parquet(f"{path}/features").orderBy("place").collect()
    if found := {r.version for r in names} - {TREES_VERSION}:
        raise ValueError(f"trees of version {sorted(found)}, this reads {TREES_VERSION}")
    forest = Forest([r.feature for r in names])
    by: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect():  # trees of bounded depth
        by.setdefault(r.tree, []).append(r)
    for rows in by.values():
        forest.trees.append(Tree(*[np.array([getattr(r, c) for r in rows]) for c in ("feature", "threshold", "value", "cover", "gain")]))
    return forest
