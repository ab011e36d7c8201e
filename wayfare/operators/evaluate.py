"""Ranking metrics, paired experiments and the promotion gate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.distributed import row_numbers
from wayfare.functions.expr import relative_change

KS = (5, 10, 20)


def novel_truth(evaluation: DataFrame, history: DataFrame) -> DataFrame:
    """(user_id, item_id): what users did that they had not done before; users left without any drop out."""
    return evaluation.select("user_id", "item_id").distinct().join(history.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def user_metrics(recommended: DataFrame, truth: DataFrame, ks=KS) -> DataFrame:
    """Metrics of each user with truth; recommended: (user_id, rank, item_id), of repeated items the first counts.

    Users without recommendations score 0.  Precision divides by k; AP by min(k, relevant); MRR has no cut.
    """
    first = recommended.groupBy("user_id", "item_id").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("rank"))
    hits = first.withColumn("pos", place).join(truth.withColumn("hit", F.lit(1)), ["user_id", "item_id"], "left").fillna(0, ["hit"])
    hits = hits.withColumn("cum", F.sum("hit").over(Window.partitionBy("user_id").orderBy("pos")))
    aggs = []
    for k in ks:
        within = (F.col("pos") <= k) & (F.col("hit") == 1)
        aggs += [F.count_if(within).alias(f"h{k}"), F.sum(F.when(within, 1 / F.log2(F.col("pos") + 1.0))).alias(f"dcg{k}"), F.sum(F.when(within, F.col("cum") / F.col("pos"))).alias(f"ap{k}")]
    own = hits.groupBy("user_id").agg(F.min(F.when(F.col("hit") == 1, F.col("pos"))).alias("first_hit"), *aggs)
    rows = truth.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rel")).join(own, "user_id", "left")
    out = [F.col("user_id"), F.coalesce(1 / F.col("first_hit"), F.lit(0.0)).alias("mrr")]
    for k in ks:
        ideal = F.element_at(F.array(*[F.lit(float(sum(1 / np.log2(i + 1) for i in range(1, m + 1)))) for m in range(1, k + 1)]), F.least(F.lit(k), "n_rel").cast("int"))
        h = F.coalesce(f"h{k}", F.lit(0))
        out += [(h / k).alias(f"precision_{k}"), (h / F.col("n_rel")).alias(f"recall_{k}"), F.when(h > 0, 1.0).otherwise(0.0).alias(f"hit_rate_{k}"), (F.coalesce(f"dcg{k}", F.lit(0.0)) / ideal).alias(f"ndcg_{k}"), (F.coalesce(f"ap{k}", F.lit(0.0)) / F.least(F.lit(k), "n_rel")).alias(f"map_{k}")]
    return rows.select(*out)


def mean_metrics(per_user: DataFrame) -> DataFrame:
    """(metric, value, users): means over users, rounded to 6 places."""
    names = [c for c in per_user.columns if c != "user_id"]
    one = per_user.agg(F.count(F.lit(1)).alias("users"), *[F.round(F.avg(c), 6).alias(c) for c in names])
    return one.unpivot(["users"], names, "metric", "value")


def beyond_accuracy(recommended: DataFrame, catalogue: DataFrame, categories: DataFrame, popularity: DataFrame) -> DataFrame:
    """One row: coverage, distinct items, gini (over recommended items only), intra-list diversity, mean popularity rank.

    catalogue: (item_id); categories: (item_id, category_id); popularity: (item_id, n), items without count 0.
    """
    counts = recommended.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    g = row_numbers(counts, ["n", "item_id"], "i").agg(F.count(F.lit(1)).alias("distinct_items"), (2 * F.sum(F.col("i") * F.col("n")) / (F.count(F.lit(1)) * F.sum("n")) - (F.count(F.lit(1)) + 1) / F.count(F.lit(1))).alias("gini"))
    size = catalogue.select("item_id").distinct().agg(F.count(F.lit(1)).alias("catalogue"))
    lists = recommended.join(categories, "item_id", "left").groupBy("user_id").agg((F.countDistinct("category_id") / F.count(F.lit(1))).alias("d"), F.count(F.lit(1)).alias("c"))
    diversity = lists.agg(F.avg(F.when(F.col("c") >= 2, F.col("d"))).alias("diversity"))
    pop = catalogue.select("item_id").distinct().join(popularity, "item_id", "left").fillna(0, ["n"])
    places = row_numbers(pop, [F.desc("n"), F.asc("item_id")], "p").join(F.broadcast(size))
    places = places.select("item_id", ((F.col("p") - 1) / F.greatest(F.col("catalogue") - 1, F.lit(1))).alias("r"))
    ranks = recommended.join(places, "item_id").groupBy("user_id").agg(F.avg("r").alias("r")).agg(F.avg("r").alias("popularity_rank"))
    return g.join(size).join(diversity).join(ranks).select(F.round(F.col("distinct_items") / F.col("catalogue"), 6).alias("coverage"), "distinct_items", F.round("gini", 6).alias("gini"), F.round("diversity", 6).alias("diversity"), F.round("popularity_rank", 6).alias("popularity_rank"))


def list_recall(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """(user_id, recall) of truth users among unordered candidates."""
    hit = truth.join(candidates.select("user_id", "item_id").distinct().withColumn("h", F.lit(1)), ["user_id", "item_id"], "left")
    return hit.groupBy("user_id").agg((F.count("h") / F.count(F.lit(1))).alias("recall"))


def overlap_at_k(approximate: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(query, recall): share of the exact top k that the approximate list holds."""
    hit = exact.join(approximate.select("query", "id").withColumn("h", F.lit(1)), ["query", "id"], "left")
    return hit.groupBy("query").agg((F.count("h") / k).alias("recall"))


def first_context(events: DataFrame) -> DataFrame:
    """(user_id, hour, weekday, region_id, vertical) at each user's first event; Monday is 0."""
    x = F.min_by(F.struct(F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"), "region_id", "vertical"), F.struct("ts", "event_id"))
    return events.groupBy("user_id").agg(x.alias("x")).select("user_id", "x.*")


def sample_users(users: DataFrame, n: int, seed: int) -> DataFrame:
    """n users in hash order: the same ones on every run."""
    return users.select("user_id").distinct().orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("user_id").cast("string"))), "user_id").limit(n)


def shared_users(control: DataFrame, treatment: DataFrame, truth: DataFrame) -> DataFrame:
    """(user_id): users with truth to whom both variants recommend something."""
    users = truth.select("user_id").distinct()
    return users.join(control, "user_id", "left_semi").join(treatment, "user_id", "left_semi")


def paired(control: DataFrame, treatment: DataFrame, metric: str) -> DataFrame:
    """(user_id, diff) over users measured in both."""
    c, t = control.select("user_id", F.col(metric).alias("c")), treatment.select("user_id", F.col(metric).alias("t"))
    return c.join(t, "user_id").select("user_id", "c", "t", (F.col("t") - F.col("c")).alias("diff"))


def lift(pairs: DataFrame) -> DataFrame:
    """(users, control, treatment, absolute, relative): relative is 0 where control is."""
    one = pairs.agg(F.count(F.lit(1)).alias("users"), F.avg("c").alias("control"), F.avg("t").alias("treatment"))
    return one.select("users", *[F.round(c, 6).alias(c) for c in ("control", "treatment")], F.round(F.col("treatment") - F.col("control"), 6).alias("absolute"), F.when(F.col("control") != 0, F.round((F.col("treatment") - F.col("control")) / F.col("control"), 6)).otherwise(0.0).alias("relative"))


# The distribution function of Poisson(1).
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974020]


def resampled(pairs: DataFrame, samples: int, seed: int) -> DataFrame:
    """(sample, n, total): for each resample how many draws there were and the sum of their differences.

    Each user enters each resample a hashed Poisson(1) number of times; a task adds up its users' draws, so it sends
    `samples` rows whatever the number of users.
    """

    def run(batches):
        every = np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        n, total = np.zeros(samples, np.int64), np.zeros(samples)
        for batch in batches:
            h, diff = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for i in range(0, len(h), 500):
                x = h[i : i + 500, None] + every[None, :]
                x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
                times = np.searchsorted(POISSON, (x ^ x >> np.uint64(31)) / 2.0**64, "right")
                n += times.sum(0)
                total += diff[i : i + 500] @ times
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(samples)), pa.array(n), pa.array(total)], ["sample", "n", "total"])

    hashed = pairs.where("diff IS NOT NULL").select(F.xxhash64(F.lit(seed), "user_id").alias("h"), F.col("diff").cast("double").alias("diff"))
    sums = hashed.mapInArrow(run, "sample long, n long, total double")
    return sums.groupBy("sample").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def bootstrap(pairs: DataFrame, samples: int = 2000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(lower, upper, p_value) of the mean difference under resampling of users.

    A Poisson bootstrap, so resampling needs no collected vector.  The p-value is doubled, corrected by one and at
    most 1; no users give (0, 0, 1).
    """
    means = resampled(pairs, samples, seed).select((F.col("total") / F.greatest("n", F.lit(1))).alias("m"))
    half = (1 - confidence) / 2
    observed = pairs.agg(F.avg("diff").alias("o")).where("o IS NOT NULL")
    one = means.join(F.broadcast(observed)).groupBy("o").agg(F.percentile("m", half).alias("lower"), F.percentile("m", 1 - half).alias("upper"), F.count_if(F.col("m") <= 0).alias("_low"), F.count_if(F.col("m") >= 0).alias("_high"))
    p = F.least(F.lit(1.0), 2.0 * (F.when(F.col("o") >= 0, F.col("_low")).otherwise(F.col("_high")) + 1) / (samples + 1))
    full = one.select("lower", "upper", p.alias("p_value"))
    return full.agg(F.coalesce(F.max("lower"), F.lit(0.0)).alias("lower"), F.coalesce(F.max("upper"), F.lit(0.0)).alias("upper"), F.coalesce(F.max("p_value"), F.lit(1.0)).alias("p_value"))


# The gate's thresholds.
GATE = {"primary_regression": 0.02, "coverage_floor": 0.05, "coverage_regression": 0.25, "gini_ceiling": 0.95, "latency_ms": 150.0, "cold_regression": 0.10}


def promotion_gate(metrics: DataFrame, limits: dict = GATE) -> DataFrame:
    """(check_name, verdict, value, threshold, promoted); metrics: (metric, candidate, incumbent), null where unmeasured.

    Required measures that are missing are inconclusive, which does not promote; without an incumbent the comparative
    checks pass, the absolute ones still hold.
    """
    one = metrics.agg(*[F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{m}_{side}") for m in ("ndcg", "coverage", "gini", "latency", "cold") for side in ("candidate", "incumbent")])

    def check(name, metric, value, threshold, ok, required=True):
        got = F.col(f"{metric}_candidate")
        verdict = F.when(got.isNull(), "inconclusive" if required else "skipped").when(ok, "pass").otherwise("fail")
        return F.struct(F.lit(name).alias("check_name"), verdict.alias("verdict"), F.when(got.isNotNull(), value.cast("double")).alias("value"), F.lit(float(threshold)).alias("threshold"))

    change = lambda m: relative_change(F.col(f"{m}_candidate"), F.col(f"{m}_incumbent"))
    new = lambda m: F.col(f"{m}_incumbent").isNull()
    c = lambda m: F.col(f"{m}_candidate")
    rows = [
        check("primary", "ndcg", change("ndcg"), -limits["primary_regression"], new("ndcg") | (change("ndcg") >= -limits["primary_regression"])),
        check("coverage_floor", "coverage", c("coverage"), limits["coverage_floor"], c("coverage") >= limits["coverage_floor"]),
        check("coverage_change", "coverage", change("coverage"), -limits["coverage_regression"], new("coverage") | (change("coverage") >= -limits["coverage_regression"])),
        check("gini", "gini", c("gini"), limits["gini_ceiling"], c("gini") <= limits["gini_ceiling"], False),
        check("latency", "latency", c("latency"), limits["latency_ms"], c("latency") <= limits["latency_ms"]),
        check("cold_start", "cold", change("cold"), -limits["cold_regression"], new("cold") | (change("cold") >= -limits["cold_regression"]), False),
    ]
    checks = one.select(F.inline(F.array(*rows)))
    good = F.min(F.col("verdict").isin("pass", "skipped")).over(Window.partitionBy(F.lit(1)))
    return checks.withColumn("promoted", good)
