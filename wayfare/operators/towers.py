"""A two-tower encoder: id and category vectors and numbers through two normalised layers, trained in blocks on Spark.

Each category value has a vector of its own in a table, found by a hash of its field and value, so neither plans nor
dense weights grow with the number of values.  A step updates only the vectors it meets, and their Adagrad state
lies beside them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.operators.neural import CATEGORY, ITEM, USER, start_rows, train_blocks
from wayfare.sources.tables import checkpointed

#: Adagrad's state at the start; what keeps a constant layer from dividing by zero.
FRESH, EPS = 1e-2, 1e-5
#: Rows that a task encodes, on average.
ENCODE_ROWS = 10_000
TOWERS_VERSION = "2"


def category(field: str, value: Column | str) -> Column:
    """The key of a category value; null is a value of its own."""
    value = F.col(value) if isinstance(value, str) else value
    return F.xxhash64(F.lit(field), value.cast("string"), value.isNull())


def in_batch_loss(q: np.ndarray, c: np.ndarray, items: np.ndarray, logq: np.ndarray, temperature: float = 0.05, known: np.ndarray | None = None):
    """Softmax loss over a batch's own items, corrected by sampling odds; repeats and known positives are masked out.

    Returns (mean loss, probabilities).
    """
    logits = q @ c.T / temperature - logq[None, :]
    mask = items[None, :] == items[:, None]
    if known is not None:
        mask |= known
    np.fill_diagonal(mask, False)
    logits = np.where(mask, -1e9, logits)
    logits -= logits.max(1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(1, keepdims=True)
    return float(-np.log(np.maximum(np.diag(p), 1e-12)).mean()), p


class Tower:
    """Two layers of affine map, normalisation over a row's places with gain and offset, and ReLU; then an affine map to length 1."""

    def __init__(self, inputs: int, hidden: int, dim: int):
        self.shapes = [(inputs, hidden), (hidden,), (hidden,), (hidden,), (hidden, hidden), (hidden,), (hidden,), (hidden,), (hidden, dim), (dim,)]
        self.size = sum(int(np.prod(s)) for s in self.shapes)

    def start(self, rng) -> np.ndarray:
        parts = [rng.normal(0, 1 / np.sqrt(max(1, s[0])), s) if len(s) > 1 else np.zeros(s) for s in self.shapes]
        parts[2][:] = parts[6][:] = 1.0  # gains
        return np.concatenate([p.reshape(-1) for p in parts])

    def parts(self, flat: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([0] + [int(np.prod(s)) for s in self.shapes])
        return [flat[a:b].reshape(s) for a, b, s in zip(ends[:-1], ends[1:], self.shapes, strict=True)]

    def encode(self, flat: np.ndarray, inputs: np.ndarray) -> tuple[np.ndarray, tuple]:
        w = self.parts(flat)
        seen, h = [], inputs
        for k in (0, 4):
            z = h @ w[k] + w[k + 1]
            std = np.sqrt(z.var(1, keepdims=True) + EPS)
            unit = (z - z.mean(1, keepdims=True)) / std
            out = np.maximum(unit * w[k + 2] + w[k + 3], 0)
            seen.append((h, unit, std, out))
            h = out
        raw = h @ w[8] + w[9]
        norm = np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)
        return raw / norm, (seen, h, raw / norm, norm)

    def gradient(self, flat: np.ndarray, seen: tuple, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the weights and of the inputs, for the gradient d of the outputs."""
        layers, h, out, norm = seen
        w = self.parts(flat)
        d = (d - out * (d * out).sum(1, keepdims=True)) / norm
        found: list = [None] * 8 + [h.T @ d, d.sum(0)]
        back = d @ w[8].T
        for k, (inputs, unit, std, active) in zip((4, 0), reversed(layers), strict=True):
            back = back * (active > 0)
            found[k + 2], found[k + 3] = (back * unit).sum(0), back.sum(0)
            back = back * w[k + 2]
            back = (back - back.mean(1, keepdims=True) - unit * (back * unit).mean(1, keepdims=True)) / std
            found[k], found[k + 1] = inputs.T @ back, back.sum(0)
            back = back @ w[k].T
        return np.concatenate([x.reshape(-1) for x in found]), back


def _inputs(f: np.ndarray, categories: np.ndarray, places: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A row's id vector, its categories' vectors and its numbers side by side."""
    return np.hstack([f, categories[places].reshape(len(f), -1), x]) if places.size else np.hstack([f, x])


def batch_gradients(towers: tuple[Tower, Tower], w: np.ndarray, f: np.ndarray, g: np.ndarray, e: np.ndarray, users: dict, items: dict, part: dict, temperature: float, known: np.ndarray | None):
    """(loss, gradients of the weights, of users', items' and categories' vectors) for a batch of pairs."""
    cut, u, i = towers[0].size, part["u"], part["i"]
    cu, ci = users["c"][u], items["c"][i]
    q, back_q = towers[0].encode(w[:cut], _inputs(f[u], e, cu, part["x"]))
    c, back_c = towers[1].encode(w[cut:], _inputs(g[i], e, ci, items["x"][i, :-1]))
    loss, p = in_batch_loss(q, c, i, items["x"][i, -1], temperature, known)
    d = (p - np.eye(len(u))) / temperature / len(u)
    (dw_u, di_u), (dw_i, di_i) = towers[0].gradient(w[:cut], back_q, d @ c), towers[1].gradient(w[cut:], back_c, d.T @ q)
    df, dg, de = np.zeros_like(f), np.zeros_like(g), np.zeros_like(e)
    for rows, to, back, places in ((u, df, di_u, cu), (i, dg, di_i, ci)):
        n = to.shape[1]
        np.add.at(to, rows, back[:, :n])
        if places.size:
            np.add.at(de, places.reshape(-1), back[:, n : n + places.shape[1] * e.shape[1]].reshape(-1, e.shape[1]))
    return loss, np.concatenate([dw_u, dw_i]), df, dg, de


def tower_step(towers: tuple[Tower, Tower], rate: float, temperature: float, batch: int, passes: int, clip: float = 5.0) -> Callable:
    """Adagrad on the in-batch softmax; an item's x ends with the log of its sampling odds; rows and weights carry their state behind them."""

    def step(users, items, categories, pairs, weights, seed):
        rng = np.random.default_rng(seed)
        halves = [np.split(m.copy(), 2, axis=1) if m.size else (m, m) for m in (users["f"], items["f"], categories["f"])]
        (f, seen_f), (g, seen_g), (e, seen_e) = halves
        w, seen_w = np.split(weights.copy(), 2)
        n = len(items["ids"])
        known = np.unique(pairs["u"] * n + pairs["i"])
        for _ in range(passes):
            for at in np.array_split(rng.permutation(len(pairs["u"])), max(1, len(pairs["u"]) // batch)):
                part = {k: v[at] for k, v in pairs.items()}
                taken = np.isin(part["u"][:, None] * n + part["i"][None, :], known)
                _, dw, df, dg, de = batch_gradients(towers, w, f, g, e, users, items, part, temperature, taken)
                scale = min(1.0, clip / max(1e-12, float(np.sqrt(sum((d**2).sum() for d in (dw, df, dg, de))))))
                rows = [slice(None), np.unique(part["u"]), np.unique(part["i"]), np.unique(np.concatenate([users["c"][part["u"]].reshape(-1), items["c"][part["i"]].reshape(-1)]).astype(np.int64))]
                for x, dx, seen, own in zip((w, f, g, e), (dw, df, dg, de), (seen_w, seen_f, seen_g, seen_e), rows, strict=True):
                    step_ = dx[own] * scale  # only what the batch has met
                    seen[own] += step_**2
                    x[own] -= rate * step_ / np.sqrt(seen[own])
        return np.hstack([f, seen_f]), np.hstack([g, seen_g]), np.hstack([e, seen_e]) if e.size else categories["f"], np.concatenate([w, seen_w])

    return step


@dataclass
class TwoTower:
    """Trained towers: id vectors of users and items, category vectors (id, embedding), dense weights of both."""

    users: DataFrame
    items: DataFrame
    categories: DataFrame
    towers: tuple[Tower, Tower]
    weights: np.ndarray
    dims: tuple[int, int, int]

    def encode(self, rows: DataFrame, side: int) -> DataFrame:
        """(id, embedding) of rows (id, x[, c]): what tower `side` makes of them and their id vectors; ids without one get no rows."""
        c = F.col("c") if "c" in rows.columns else F.array().cast("array<long>")
        known = (self.users, self.items)[side]
        n = max(1, -(-known.count() // ENCODE_ROWS))
        ids = known.repartition(n, "id").join(rows.select("id", "x", c.alias("c")).repartition(n, "id"), "id")
        some = ids.select("id", F.posexplode("c").alias("place", "key")).join(self.categories.select(F.col("id").alias("key"), F.col("embedding").alias("e")), "key", "left")
        none = F.array_repeat(F.lit(0.0), self.dims[2])  # values that training has not met
        joined = some.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("e", none).alias("e")))).alias("all"))
        flat = F.flatten(F.transform("all", lambda s: s["e"]))
        both = ids.join(joined.select("id", flat.alias("e")), "id", "left").select("id", F.concat("embedding", F.coalesce("e", F.array().cast("array<double>")), "x").alias("inputs"))
        tower, cut = self.towers[side], self.towers[0].size
        weights = self.weights[:cut] if side == 0 else self.weights[cut:]

        def run(batches):
            for b in batches:
                if b.num_rows:
                    flat_ = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    out, _ = tower.encode(weights, flat_)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(out), pa.list_(pa.float64()))], ["id", "embedding"])

        return both.mapInArrow(run, "id long, embedding array<double>")


def fit_two_tower(pairs: DataFrame, items: DataFrame, dim: int = 16, hidden: int = 32, epochs: int = 4, passes: int = 3, rate: float = 0.05, temperature: float = 0.1, batch: int = 256, seed: int = 42, category_dim: int = 8) -> TwoTower:
    """Towers from pairs (user_id, item_id, x[, c]) and items (item_id, x[, c]); c are keys of category().

    A pair's x is what was known of the user before it; an item's x are its features, then the log of its sampling
    odds.  A user's categories are those of any of their pairs with the greatest keys.  Known positives of a user count as no negatives.
    """
    none = F.array().cast("array<long>")
    pairs = pairs.select(F.col("user_id").alias("id"), F.col("item_id").alias("other"), "x", (F.col("c") if "c" in pairs.columns else none).alias("c"))
    items = items.select(F.col("item_id").alias("id"), "x", (F.col("c") if "c" in items.columns else none).alias("c"))
    sizes = [df.agg(F.max(F.size("x")).alias("x"), F.max(F.size("c")).alias("c")).first() for df in (pairs, items)]
    (xu, cu), (xi, ci) = [(r.x or 0, r.c or 0) for r in sizes]
    towers = (Tower(dim + cu * category_dim + xu, hidden, dim), Tower(dim + ci * category_dim + max(0, xi - 1), hidden, dim))
    rng = np.random.default_rng(seed)
    weights = np.concatenate([t.start(rng) for t in towers])
    weights = np.concatenate([weights, np.full(len(weights), FRESH)])
    users = pairs.groupBy("id").agg(F.max("c").alias("c"))
    values = users.select(F.explode("c").alias("id")).unionByName(items.select(F.explode("c").alias("id"))).distinct()
    state = start_rows(users, USER, dim, seed, FRESH).unionByName(start_rows(items, ITEM, dim, seed, FRESH)).unionByName(start_rows(values, CATEGORY, category_dim, seed, FRESH))
    state, weights = train_blocks(state, pairs, tower_step(towers, rate, temperature, batch, passes), epochs, weights)
    of = lambda kind, size: state.where(F.col("kind") == kind).select("id", F.slice("f", 1, size).alias("embedding"))
    return TwoTower(of(USER, dim), of(ITEM, dim), of(CATEGORY, category_dim), towers, weights[: len(weights) // 2], (dim, hidden, category_dim))


def save_towers(model: TwoTower, path: str) -> None:
    """The vectors as tables, the dense weights as one row, under a version."""
    spark = model.users.sparkSession
    for name in ("users", "items", "categories"):
        getattr(model, name).write.mode("overwrite").parquet(f"{path}/{name}")
    row = (TOWERS_VERSION, [t.shapes[0][0] for t in model.towers], list(model.dims), model.weights.tolist())
    spark.createDataFrame([row], "version string, inputs array<int>, dims array<int>, weights array<double>").write.mode("overwrite").parquet(f"{path}/weights")


def load_towers(spark: SparkSession, path: str) -> TwoTower:
    """Saved towers; another version is refused."""
    r = spark.read.parquet(f"{path}/weights").first()
    if r.version != TOWERS_VERSION:
        raise ValueError(f"towers of version {r.version}, this reads {TOWERS_VERSION}")
    dim, hidden, category_dim = r.dims
    towers = tuple(Tower(n, hidden, dim) for n in r.inputs)
    return TwoTower(*[spark.read.parquet(f"{path}/{name}") for name in ("users", "items", "categories")], towers, np.array(r.weights), (dim, hidden, category_dim))


def two_tower_loss(model: TwoTower, pairs: DataFrame, items: DataFrame, temperature: float = 0.1, batch: int = 256, batches: int = 20) -> float:
    """The mean in-batch loss of `batches` hashed batches of pairs (user_id, item_id, x[, c]): a figure to watch, of bounded size."""
    n = batch * batches
    some = checkpointed(pairs.orderBy(F.xxhash64("user_id", "item_id"), "user_id", "item_id").limit(n), "loss-pairs")
    c = lambda df: F.col("c") if "c" in df.columns else F.array().cast("array<long>")
    keyed = some.select(F.monotonically_increasing_id().alias("row"), "user_id", "item_id", "x", c(some).alias("c"))
    keyed = checkpointed(keyed, "loss-pairs")
    # Each pair is a row of its own, with its user's vector: what was known of a user changes from pair to pair.
    own = TwoTower(keyed.select(F.col("row"), F.col("user_id").alias("id")).join(model.users, "id").select(F.col("row").alias("id"), "embedding"), model.items, model.categories, model.towers, model.weights, model.dims)
    q = {r.id: np.array(r.embedding) for r in own.encode(keyed.select(F.col("row").alias("id"), "x", "c"), 0).collect()}  # n rows
    wanted = keyed.select(F.col("item_id").alias("id")).distinct()
    rows = items.select(F.col("item_id").alias("id"), F.slice("x", 1, F.size("x") - 1).alias("x"), F.element_at("x", -1).alias("logq"), c(items).alias("c")).join(wanted, "id")
    v = {r.id: np.array(r.embedding) for r in model.encode(rows, 1).collect()}
    odds = {r.id: r.logq for r in rows.select("id", "logq").collect()}
    keys = [(r["row"], r.item_id) for r in keyed.select("row", "item_id").collect() if r["row"] in q and r.item_id in v]
    losses = []
    for k in range(0, len(keys), batch):
        part = keys[k : k + batch]
        losses.append(in_batch_loss(np.array([q[a] for a, _ in part]), np.array([v[b] for _, b in part]), np.array([b for _, b in part]), np.array([odds[b] for _, b in part]), temperature)[0])
    return float(np.mean(losses)) if losses else float("nan")
