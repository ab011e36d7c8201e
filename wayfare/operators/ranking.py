"""Ranking and reranking: datasets, pairwise models with exact attributions, filters, adjustments, diversity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MERCHANT_CAP, CATEGORY_CAP = 2, 3


def ranking_dataset(candidates: DataFrame, truth: DataFrame, features: list[str]) -> DataFrame:
    """(user_id, item_id, label, features): candidates with labels, for users with a positive only.

    Missing feature columns raise; undefined features stay null.
    """
    if missing := [c for c in features if c not in candidates.columns]:
        raise ValueError(f"candidates lack {missing}")
    hits = truth.select("user_id", "item_id").distinct().withColumn("label", F.lit(1))
    rows = candidates.select("user_id", "item_id", *features).join(hits, ["user_id", "item_id"], "left").fillna(0, ["label"])
    positive = F.sum("label").over(Window.partitionBy("user_id")) > 0
    return rows.withColumn("_p", positive).where("_p").drop("_p")


def pairwise(dataset: DataFrame, features: list[str], score: str) -> DataFrame:
    """(user_id, weight, label, d_<feature>): each positive against each negative of its user, both ways round.

    A pair weighs what swapping its two places (by `score`) would change in NDCG.  Candidates per user are capped where
    they are retrieved, so a user's pairs are bounded.
    """
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(score), "item_id"))
    rows = dataset.withColumn("_place", place)
    rows = rows.select("user_id", "label", "_place", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    p, n = rows.where("label = 1").alias("p"), rows.where("label = 0").alias("n")
    gain = F.abs(1 / F.log2(F.col("p._place") + 1) - 1 / F.log2(F.col("n._place") + 1))
    pairs = p.join(n, "user_id").select("user_id", gain.alias("weight"), *[(F.col(f"p.{c}") - F.col(f"n.{c}")).alias(f"d_{c}") for c in features])
    back = pairs.select("user_id", "weight", F.lit(0.0).alias("label"), *[(-F.col(f"d_{c}")).alias(f"d_{c}") for c in features])
    return pairs.withColumn("label", F.lit(1.0)).unionByName(back)


def fit_pairwise(pairs: DataFrame, features: list[str], reg: float = 0.01):
    """A linear LambdaRank: logistic regression on feature differences, weighted by their NDCG change. Returns coefficients."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=[f"d_{c}" for c in features], outputCol="x").transform(pairs.where("weight > 0"))
    model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", fitIntercept=False, regParam=reg, maxIter=50).fit(data)
    return dict(zip(features, model.coefficients.toArray().tolist(), strict=True))


def linear_rank(dataset: DataFrame, coefficients: dict[str, float], k: int) -> DataFrame:
    score = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in coefficients.items()), F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id"))
    return dataset.withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= k)


def _filled(rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with x, the vector of their features; undefined ones are -1, which trees can part from all others."""
    from pyspark.ml.functions import array_to_vector

    return rows.withColumn("x", array_to_vector(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in features])))


def fit_trees(dataset: DataFrame, features: list[str], trees: int = 20, depth: int = 4, rate: float = 0.1, seed: int = 42):
    """Gradient-boosted regression trees of the labels, a pointwise ranker: Spark's model."""
    from pyspark.ml.regression import GBTRegressor

    data = _filled(dataset, features).select("x", F.col("label").cast("double").alias("label"))
    return GBTRegressor(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed, minInstancesPerNode=10, subsamplingRate=0.8).fit(data)


def tree_rank(dataset: DataFrame, model, features: list[str], k: int) -> DataFrame:
    """The k best candidates of each user, ties to smaller ids."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id"))
    scored = model.setPredictionCol("score").transform(_filled(dataset, features)).drop("x")
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def gain_importance(model, features: list[str]) -> list[tuple[str, float]]:
    """(feature, share of all splits' gain), largest first."""
    return sorted(zip(features, map(float, model.featureImportances.toArray()), strict=True), key=lambda x: (-x[1], x[0]))


def tree_nodes(model, path: str) -> dict[int, dict[int, tuple]]:
    """tree -> node -> (feature, threshold, left, right, prediction) of a boosted model, read from its saved form; leaves have feature -1."""
    model.write().overwrite().save(path)
    rows = SparkSession.active().read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()  # trees of bounded depth
    out: dict[int, dict[int, tuple]] = {}
    for r in rows:
        threshold = r.split.leftCategoriesOrThreshold[0] if r.leftChild >= 0 else 0.0
        out.setdefault(r.treeID, {})[r.id] = (r.split.featureIndex if r.leftChild >= 0 else -1, threshold, r.leftChild, r.rightChild, r.prediction)
    return out


def explain_trees(ranked: DataFrame, model, features: list[str], top: int, path: str) -> DataFrame:
    """(user_id, item_id, base, reasons): the `top` features by what they add to a row's score.

    Along a row's path through each tree, the change of the mean prediction at a split is its feature's.  All
    contributions and the base, the trees' mean, add up to the score.
    """
    import numpy as np
    import pyarrow as pa

    nodes, weights, n = tree_nodes(model, path), [float(w) for w in model.treeWeights], len(features)
    base = float(sum(w * nodes[t][0][4] for t, w in enumerate(weights)))
    tables = [[np.array([nodes[t][k][c] if k in nodes[t] else kind(0) for k in range(max(nodes[t]) + 1)]) for c, kind in enumerate((int, float, int, int, float))] for t in range(len(weights))]
    kinds = {c: ranked.schema[c].dataType.simpleString() for c in ("user_id", "item_id")}

    def run(batches):
        for batch in batches:
            rows = np.array(batch.column(2).to_pylist(), float).reshape(batch.num_rows, n)
            parts = np.zeros((len(rows), n))
            every = np.arange(len(rows))
            for w, (feature, threshold, left, right, value) in zip(weights, tables, strict=True):
                at = np.zeros(len(rows), np.int64)
                while (inner := feature[at] >= 0).any():  # a level at a time, all rows together
                    f = np.maximum(feature[at], 0)
                    to = np.where(inner, np.where(rows[every, f] <= threshold[at], left[at], right[at]), at)
                    parts[every, f] += np.where(inner, w * (value[to] - value[at]), 0.0)
                    at = to
            best = np.argsort(-np.abs(parts), axis=1, kind="stable")[:, :top]
            reasons = [[{"feature": features[j], "value": float(parts[i, j])} for j in row] for i, row in enumerate(best)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([base] * len(rows)), pa.array(reasons, pa.list_(pa.struct([("feature", pa.string()), ("value", pa.float64())])))], ["user_id", "item_id", "base", "reasons"])

    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in features])
    return ranked.select("user_id", "item_id", x.alias("x")).mapInArrow(run, f"user_id {kinds['user_id']}, item_id {kinds['item_id']}, base double, reasons array<struct<feature:string,value:double>>")


def rank_candidates(candidates: DataFrame, coefficients: dict[str, float] | None, k: int) -> DataFrame:
    """The k best candidates of each user by a linear ranker, or by their fused score while there is none."""
    return linear_rank(candidates, coefficients or {"fused": 1.0}, k)


def importance(dataset: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """(feature, importance): each feature's share of the score's spread, |w| times its standard deviation."""
    spread = dataset.agg(*[(abs(w) * F.stddev_pop(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))).alias(c) for c, w in coefficients.items()])
    whole = Window.partitionBy(F.lit(1))  # a row for each feature
    return spread.unpivot([], list(coefficients), "feature", "v").select("feature", (F.col("v") / F.sum("v").over(whole)).alias("importance"))


def explain_linear(ranked: DataFrame, background: DataFrame, coefficients: dict[str, float], top: int) -> DataFrame:
    """(user_id, item_id, reasons): the `top` contributions w * (x - mean), the exact Shapley values of a linear score."""
    means = background.agg(*[F.coalesce(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), F.lit(0.0)).alias(f"_m_{c}") for c in coefficients])
    parts = F.array(*[F.struct((-F.abs(w * (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.col(f"_m_{c}")))).alias("k"), F.lit(c).alias("feature"), (w * (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.col(f"_m_{c}"))).alias("value")) for c, w in coefficients.items()])
    reasons = F.transform(F.slice(F.array_sort(parts), 1, top), lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value")))
    return ranked.join(F.broadcast(means)).select("user_id", "item_id", reasons.alias("reasons"))


def hard_filters(items: DataFrame, max_minutes: float) -> DataFrame:
    """items with reason: unavailable first, then too slow; nulls pass both. Kept rows have no reason."""
    reason = F.when(~F.coalesce("is_available", F.lit(True)), "unavailable").when(F.col("delivery_minutes") > max_minutes, "delivery_time")
    return items.withColumn("reason", reason)


def adjust(items: DataFrame, sponsored: float = 0.0, popularity: float = 0.0) -> DataFrame:
    """items with final and adjustments: boosts are added to, never put in place of, the model's score; zeros are unrecorded.

    final is rounded to 9 places, so that sums in another order tie alike.
    """
    boost = F.when(F.coalesce("is_sponsored", F.lit(False)), F.lit(sponsored)).otherwise(F.lit(0.0))
    penalty = F.when(F.col("popularity_rank").isNotNull(), -popularity * (1 - F.col("popularity_rank"))).otherwise(F.lit(0.0))
    deltas = F.map_filter(F.create_map(F.lit("sponsored"), boost, F.lit("popularity"), penalty), lambda _, v: v != 0)
    return items.withColumn("adjustments", deltas).withColumn("final", F.round(F.col("score") + F.aggregate(F.map_values("adjustments"), F.lit(0.0), lambda a, x: a + x), 9))


def diversify(items: DataFrame, k: int, merchant_cap: int = MERCHANT_CAP, category_cap: int = CATEGORY_CAP, group: str = "user_id") -> DataFrame:
    """(group, position, item_id, relaxed): greedy by final score under both caps; what the caps hold back fills the end.

    A fold over each group's sorted candidates (bounded by retrieval) carries what is chosen and what is held back; an item
    held back by one cap uses no place of the other; nulls are never capped.
    """
    kind = "struct<o:double,item_id:{},merchant_id:{},category_id:{}>".format(*[items.schema[c].dataType.simpleString() for c in ("item_id", "merchant_id", "category_id")])
    one = F.struct((-F.col("final")).cast("double").alias("o"), "item_id", "merchant_id", "category_id")
    lists = items.groupBy(group).agg(F.array_sort(F.collect_list(one)).alias("c"))
    empty = F.array().cast(f"array<{kind}>")
    used = lambda chosen, c, x: F.when(x[c].isNull(), 0).otherwise(F.size(F.filter(chosen, lambda y: y[c] == x[c])))

    def step(acc, x):
        fits = (F.size(acc["chosen"]) < k) & (used(acc["chosen"], "merchant_id", x) < merchant_cap) & (used(acc["chosen"], "category_id", x) < category_cap)
        return F.struct(F.when(fits, F.concat(acc["chosen"], F.array(x))).otherwise(acc["chosen"]).alias("chosen"), F.when(fits, acc["held"]).otherwise(F.concat(acc["held"], F.array(x))).alias("held"))

    acc = F.aggregate("c", F.struct(empty.alias("chosen"), empty.alias("held")), step)
    both = lists.select(group, acc.alias("a"))
    tag = lambda c, relaxed: F.transform(F.col(f"a.{c}"), lambda x: F.struct(x["item_id"].alias("item_id"), F.lit(relaxed).alias("relaxed")))
    return both.select(group, F.posexplode(F.slice(F.concat(tag("chosen", False), tag("held", True)), 1, k)).alias("i", "x")).select(group, (F.col("i") + 1).alias("position"), "x.item_id", "x.relaxed")


def rerank(items: DataFrame, k: int, max_minutes: float, sponsored: float = 0.0, popularity: float = 0.0) -> DataFrame:
    kept = hard_filters(items, max_minutes).where("reason IS NULL").drop("reason")
    return diversify(adjust(kept, sponsored, popularity), k)
