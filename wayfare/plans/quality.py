"""Queries over evaluation, experiments, the gate, drift and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfare.functions.expr import hour_bucket
from wayfare.operators import drift, evaluate
from wayfare.operators import retrieval as R
from wayfare.plans.cleaning import SPLIT
from wayfare.plans.features import POP_SQL, pop_scores, splits
from wayfare.plans.registry import query
from wayfare.plans.retrieval import CF_SQL, cf
from wayfare.sources.tables import BEHAVIOUR_SQL as A
from wayfare.sources.tables import behaviour, checkpointed

_IDEAL = "[" + ", ".join(repr(sum(1 / __import__("math").log2(i + 1) for i in range(1, m + 1))) for m in range(1, 21)) + "]"


def _metrics_sql(recs: str, name: str) -> str:
    """CTEs that end in `name`: per-user metrics of recs (user_id, rank, item_id) against tt."""
    per_k = ", ".join(
        f"coalesce(h{k}, 0) / {k}.0::double AS precision_{k}, coalesce(h{k}, 0)::double / n_rel AS recall_{k}, (CASE WHEN h{k} > 0 THEN 1 ELSE 0 END)::double AS hit_rate_{k}, coalesce(g{k}, 0) / ({_IDEAL}[least({k}, n_rel)])::double AS ndcg_{k}, coalesce(a{k}, 0) / least({k}, n_rel)::double AS map_{k}"
        for k in evaluate.KS
    )
    aggs = ", ".join(f"count(*) FILTER (hit AND pos <= {k}) AS h{k}, sum(1 / log2(pos + 1)) FILTER (hit AND pos <= {k}) AS g{k}, sum(cum / pos) FILTER (hit AND pos <= {k}) AS a{k}" for k in evaluate.KS)
    return f"""{name}_h AS (SELECT user_id, rank AS pos, (user_id, item_id) IN (SELECT user_id, item_id FROM tt) AS hit, sum(((user_id, item_id) IN (SELECT user_id, item_id FROM tt))::int) OVER (PARTITION BY user_id ORDER BY rank) AS cum FROM {recs}),
{name}_a AS (SELECT user_id, min(pos) FILTER (hit) AS first_hit, {aggs} FROM {name}_h GROUP BY 1),
{name} AS (SELECT t.user_id, coalesce(1.0::double / first_hit, 0) AS mrr, {per_k} FROM (SELECT user_id, count(*) AS n_rel FROM tt GROUP BY 1) t LEFT JOIN {name}_a USING (user_id))"""


TRUTH_SQL = "hist AS (SELECT DISTINCT user_id, item_id FROM tr), tt AS (SELECT DISTINCT user_id, item_id FROM te EXCEPT SELECT user_id, item_id FROM hist)"
RECS_SQL = f"""{CF_SQL}, {POP_SQL}, {TRUTH_SQL},
pr AS (SELECT * FROM (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (SELECT DISTINCT user_id FROM tr), pop WHERE (user_id, item_id) NOT IN (SELECT user_id, item_id FROM hist)) WHERE rank <= 20),
cr AS (SELECT * FROM (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM cf WHERE (user_id, item_id) NOT IN (SELECT user_id, item_id FROM hist)) WHERE rank <= 20)"""
_NAMES = ["mrr"] + [f"{m}_{k}" for k in evaluate.KS for m in ("precision", "recall", "hit_rate", "ndcg", "map")]
_ROUNDED = ", ".join(f"round({c} + 1e-9::double, 6) AS {c}" for c in _NAMES)


def recommendations(spark, d):
    """(train, test, popularity lists, CF lists) of unseen items; the CF lists are written, 20 rows a user."""
    _, train, test = splits(spark, d)
    found = checkpointed(R.top_k(R.without_seen(cf(train), train), 20), "lists")  # read several times, so made once
    return train, test, R.global_unseen(pop_scores(train), train, 20), found


def _nudge(df):
    return df.select("user_id", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in _NAMES])


@query("ev9_novel_truth", f"WITH {SPLIT}, {TRUTH_SQL} SELECT * FROM tt")
def truth(spark, d):
    _, train, test = splits(spark, d)
    return evaluate.novel_truth(test, train)


@query("ev1_user_metrics", f"WITH {SPLIT}, {RECS_SQL}, {_metrics_sql('cr', 'mc')} SELECT user_id, {_ROUNDED} FROM mc")
def user_metrics(spark, d):
    train, test, _, c = recommendations(spark, d)
    return _nudge(evaluate.user_metrics(c, evaluate.novel_truth(test, train)))


@query("ev14_model_table", f"""WITH {SPLIT}, {RECS_SQL}, {_metrics_sql('pr', 'mp')}, {_metrics_sql('cr', 'mc')}, z AS (SELECT 'popularity' AS model, * FROM mp UNION ALL SELECT 'item_cf', * FROM mc)
SELECT model, count(*) AS users, {', '.join(f'round(avg({c}) + 1e-9::double, 6) AS {c}' for c in _NAMES)} FROM z GROUP BY 1""")
def model_table(spark, d):
    train, test, p, c = recommendations(spark, d)
    t = evaluate.novel_truth(test, train)
    z = evaluate.user_metrics(p, t).withColumn("model", F.lit("popularity")).unionByName(evaluate.user_metrics(c, t).withColumn("model", F.lit("item_cf")))
    return z.groupBy("model").agg(F.count(F.lit(1)).alias("users"), *[F.round(F.avg(n) + 1e-9, 6).alias(n) for n in _NAMES])


@query("ag17_beyond_accuracy", f"""WITH {SPLIT}, {RECS_SQL}, ct AS (SELECT DISTINCT item_id FROM a), c AS (SELECT item_id, count(*) AS n FROM cr GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY n, item_id) AS i FROM c),
l AS (SELECT user_id, count(DISTINCT item_id % 6)::double / count(*) AS d, count(*) AS k FROM cr GROUP BY 1), q0 AS (SELECT ct.item_id, count(tr.item_id) AS n FROM ct LEFT JOIN tr USING (item_id) GROUP BY 1),
pk AS (SELECT item_id, (row_number() OVER (ORDER BY n DESC, item_id) - 1) / (count(*) OVER () - 1)::double AS r FROM q0), ru AS (SELECT user_id, avg(r) AS r FROM cr JOIN pk USING (item_id) GROUP BY 1)
SELECT round((SELECT count(*) FROM c) / (SELECT count(*) FROM ct)::double, 6) AS coverage, (SELECT count(*) FROM c) AS distinct_items, (SELECT round(2.0::double * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1.0::double) / count(*), 6) FROM o) AS gini,
  (SELECT round(avg(d), 6) FROM l WHERE k >= 2) AS diversity, (SELECT round(avg(r), 6) FROM ru) AS popularity_rank""")
def beyond(spark, d):
    train, _, _, c = recommendations(spark, d)
    catalogue = behaviour(spark, d).select("item_id").distinct()
    categories = catalogue.select("item_id", (F.col("item_id") % 6).alias("category_id"))
    return evaluate.beyond_accuracy(c, catalogue, categories, train.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")))


@query("ev12_candidate_recall", f"WITH {SPLIT}, {RECS_SQL} SELECT user_id, round(count(cr.item_id) / count(*), 6) AS recall FROM tt LEFT JOIN cr USING (user_id, item_id) GROUP BY 1")
def candidate_recall(spark, d):
    train, test, _, c = recommendations(spark, d)
    return evaluate.list_recall(c, evaluate.novel_truth(test, train)).withColumn("recall", F.round("recall", 6))


@query("ev10_user_sample", f"WITH {A} SELECT user_id FROM (SELECT DISTINCT user_id FROM a) ORDER BY md5('42|' || user_id), user_id LIMIT 25")
def sample(spark, d):
    return evaluate.sample_users(behaviour(spark, d), 25, 42)


def _pairs(spark, d):
    train, test, p, c = recommendations(spark, d)
    t = evaluate.novel_truth(test, train)
    return evaluate.paired(evaluate.user_metrics(p, t), evaluate.user_metrics(c, t), "ndcg_10")


@query("ab4_lift", f"""WITH {SPLIT}, {RECS_SQL}, {_metrics_sql('pr', 'mp')}, {_metrics_sql('cr', 'mc')}, z AS (SELECT mp.ndcg_10 AS c, mc.ndcg_10 AS t FROM mp JOIN mc USING (user_id))
SELECT count(*) AS users, round(avg(c), 6) AS control, round(avg(t), 6) AS treatment, round(avg(t) - avg(c), 6) AS absolute, coalesce(round((avg(t) - avg(c)) / nullif(avg(c), 0), 6), 0) AS relative FROM z""")
def lift(spark, d):
    return evaluate.lift(_pairs(spark, d))


@query("ab3_bootstrap")
def bootstrap(spark, d):
    return evaluate.bootstrap(checkpointed(_pairs(spark, d), "pairs"))


def _shape_sql(recs: str, name: str) -> str:
    """CTEs that end in `name`: one row of coverage and gini of recs."""
    return f"""{name}_c AS (SELECT item_id, count(*) AS n FROM {recs} GROUP BY 1), {name}_o AS (SELECT *, row_number() OVER (ORDER BY n, item_id) AS i FROM {name}_c),
{name} AS (SELECT round(count(*) / (SELECT count(DISTINCT item_id) FROM a)::double, 6) AS coverage, round(2.0::double * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1.0::double) / count(*), 6) AS gini FROM {name}_o)"""


_CHANGE = "CASE WHEN {o} <> 0 THEN ({n} - {o}) / {o} WHEN {n} = 0 THEN 0 ELSE 'inf'::double END"
_NDCG, _COVER = _CHANGE.format(n="cn", o="pn"), _CHANGE.format(n="cc", o="pc")


@query("gt1_promotion_gate", f"""WITH {SPLIT}, {RECS_SQL}, {_metrics_sql('pr', 'mp')}, {_metrics_sql('cr', 'mc')}, {_shape_sql('cr', 'sc')}, {_shape_sql('pr', 'sp')},
x AS (SELECT (SELECT avg(ndcg_10) FROM mc) AS cn, (SELECT avg(ndcg_10) FROM mp) AS pn, sc.coverage AS cc, sp.coverage AS pc, sc.gini AS cg FROM sc, sp),
v AS (SELECT unnest(['primary', 'coverage_floor', 'coverage_change', 'gini', 'latency', 'cold_start']) AS check_name, unnest([{_NDCG}, cc, {_COVER}, cg, NULL, NULL]::double[]) AS value, unnest([-0.02, 0.05, -0.25, 0.95, 150.0, -0.1]::double[]) AS threshold FROM x)
SELECT check_name, CASE WHEN check_name = 'latency' THEN 'inconclusive' WHEN check_name = 'cold_start' THEN 'skipped' WHEN check_name = 'gini' THEN CASE WHEN value <= threshold THEN 'pass' ELSE 'fail' END
  WHEN value >= threshold THEN 'pass' ELSE 'fail' END AS verdict, round(value + 1e-10::double, 6) AS value, threshold, false AS promoted FROM v""")
def gate(spark, d):
    """Item-to-item lists as candidate against popularity as incumbent.  No latency is measured here, so the gate can't promote."""
    train, test, p, c = recommendations(spark, d)
    t, catalogue = checkpointed(evaluate.novel_truth(test, train), "truth"), behaviour(spark, d).select("item_id").distinct()
    sides = None
    for name, lists in (("candidate", c), ("incumbent", checkpointed(p, "lists"))):
        ndcg = evaluate.user_metrics(lists, t).agg(F.avg("ndcg_10").alias("ndcg"))
        shape = evaluate.beyond_accuracy(lists, catalogue, catalogue.withColumn("category_id", F.lit(0)), train.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")))
        one = ndcg.join(shape.select("coverage", "gini")).select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in ("ndcg", "coverage", "gini")])))
        sides = one if sides is None else one.join(sides, "metric")
    return evaluate.promotion_gate(sides).withColumn("value", F.round(F.col("value") + 1e-10, 6))


def every_model(spark, d):
    """name -> (user_id, item_id, score, rank): the unseen top 20 of each model."""
    from wayfare.operators import neural, popularity
    from wayfare.plans.features import trend_scores
    from wayfare.plans.retrieval import two_towers

    train, test, p, c = recommendations(spark, d)
    first = evaluate.first_context(test).withColumn("bucket", hour_bucket(F.col("hour")))
    cells = first.select("region_id", "vertical", "bucket").distinct().withColumn("context_id", F.xxhash64("region_id", "vertical", "bucket"))
    scored = popularity.contextual_scores(popularity.contextual(train), cells, train)
    seen = train.groupBy("user_id").agg(F.countDistinct("item_id").alias("n"))
    most = (seen.agg(F.max("n")).first()[0] or 0) + 20
    listed = R.top_k(scored, most, "context_id").select("context_id", "item_id", "score", "rank")
    own = first.select("user_id", F.xxhash64("region_id", "vertical", "bucket").alias("context_id")).join(seen, "user_id")
    contextual = own.join(listed, "context_id").where(F.col("rank") <= F.col("n") + 20).select("user_id", "item_id", "score")
    matrix = R.user_item(train)
    factors = neural.fit_bpr(matrix)
    deep = lambda users, items: R.top_k(R.without_seen(neural.factor_topk(users, items, most).drop("rank"), train), 20)
    return {
        "popularity": p, "trending": R.global_unseen(trend_scores(train), train, 20), "contextual": R.top_k(R.without_seen(contextual, train), 20), "item_cf": c,
        "als": R.top_k(R.without_seen(R.als_topk(R.als(matrix), most).drop("rank"), train), 20), "bpr": deep(*factors), "two_tower": deep(*two_towers(train)),
    }, evaluate.novel_truth(test, train)


@query("ev14_every_model")
def every_model_table(spark, d):
    """Every model's metrics over the same users."""
    lists, truth_ = every_model(spark, d)
    truth_ = checkpointed(truth_, "truth")
    z = None
    for name, found in lists.items():
        one = evaluate.user_metrics(checkpointed(found.select("user_id", "item_id", "score", "rank"), "lists"), truth_).withColumn("model", F.lit(name))
        z = one if z is None else z.unionByName(one)
    return z.groupBy("model").agg(F.count(F.lit(1)).alias("users"), *[F.round(F.avg(n) + 1e-9, 6).alias(n) for n in _NAMES])


DRIFT_FEATURES = {"price": "price_at_event", "item": "item_id::double", "hour": "hour(ts)::double", "kind": "event_type::double", "constant": "1.0::double"}


def drift_sql(reference: str = "tr", current: str = "te", extra: str = "") -> str:
    return f"""WITH {SPLIT}{extra}, x AS (
  {' UNION ALL '.join(f"SELECT '{f}' AS feature, {e} AS x, 0 AS side FROM {reference} UNION ALL SELECT '{f}', {e}, 1 FROM {current}" for f, e in DRIFT_FEATURES.items())}),
st AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) FILTER (side = 0))) AS q, avg(x) FILTER (side = 0) AS reference_mean, avg(x) FILTER (side = 1) AS current_mean,
  count(*) FILTER (side = 0) AS reference_n, count(*) FILTER (side = 1) AS current_n FROM x GROUP BY 1),
inn AS (SELECT *, q[2:greatest(len(q) - 1, 1)] AS i0 FROM st), ii AS (SELECT *, CASE WHEN len(q) < 3 THEN [] ELSE i0 END AS i FROM inn),
bn AS (SELECT ii.feature, len(list_filter(i, lambda e: e <= x.x)) AS bin, count(*) FILTER (side = 0) AS r, count(*) FILTER (side = 1) AS c FROM x JOIN ii USING (feature) GROUP BY 1, 2),
ev AS (SELECT feature, reference_n, current_n, unnest(range(len(i) + 1)) AS bin FROM ii),
pp AS (SELECT feature, greatest(coalesce(r, 0) / reference_n, 1e-6::double) AS e, greatest(coalesce(c, 0) / current_n, 1e-6::double) AS a FROM ev LEFT JOIN bn USING (feature, bin)),
ps AS (SELECT feature, sum((a - e) * ln(a / e)) AS psi, sum(e * log2(e / ((e + a) / 2))) / 2 + sum(a * log2(a / ((e + a) / 2))) / 2 AS js FROM pp GROUP BY 1),
cd AS (SELECT feature, x, sum(count(*) FILTER (side = 0)) OVER w AS cr, sum(count(*) FILTER (side = 1)) OVER w AS cc FROM x GROUP BY feature, x WINDOW w AS (PARTITION BY feature ORDER BY x)),
ks AS (SELECT feature, max(abs(cr / reference_n - cc / current_n)) AS ks FROM cd JOIN st USING (feature) GROUP BY 1)
SELECT feature, round(psi, 6) AS psi, round(ks, 6) AS ks, round(js, 6) AS js, round(reference_mean, 6) AS reference_mean, round(current_mean, 6) AS current_mean, reference_n, current_n,
  CASE WHEN psi >= 0.25 THEN 'major' WHEN psi >= 0.1 THEN 'minor' ELSE 'stable' END AS severity FROM st JOIN ps USING (feature) JOIN ks USING (feature)"""


def drift_features(df):
    return df.select(F.col("price_at_event").alias("price"), F.col("item_id").alias("item"), F.hour("ts").alias("hour"), F.col("event_type").alias("kind"), F.lit(1.0).alias("constant"))


@query("dr6_drift_report", drift_sql())
def drift_report(spark, d):
    _, train, test = splits(spark, d)
    return drift.detect_drift(drift_features(train), drift_features(test), list(DRIFT_FEATURES))


_BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0]


@query("mn1_histogram", f"""WITH {A}, b AS (SELECT unnest([5.0::double, 10.0::double, 25.0::double, 50.0::double, 100.0::double, 'inf'::double]) AS upper)
SELECT event_type, upper, count(*) FILTER (price_at_event <= upper) AS cumulative FROM a, b GROUP BY 1, 2""")
def histogram(spark, d):
    return drift.histogram(behaviour(spark, d), "event_type", "price_at_event", _BOUNDS)


@query("ag22_histogram_percentiles", f"""WITH {A}, b AS (SELECT unnest([5.0::double, 10.0::double, 25.0::double, 50.0::double, 100.0::double, 'inf'::double]) AS upper), h AS (SELECT event_type, upper, count(*) FILTER (price_at_event <= upper) AS c FROM a, b GROUP BY 1, 2),
l AS (SELECT *, coalesce(lag(upper) OVER w, 0) AS low, coalesce(lag(c) OVER w, 0) AS below, max(c) OVER (PARTITION BY event_type) AS total FROM h WINDOW w AS (PARTITION BY event_type ORDER BY upper)),
f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY upper) AS n FROM l WHERE c >= 0.9::double * total)
SELECT event_type, round(CASE WHEN isinf(upper) THEN low WHEN c <= below THEN upper ELSE low + (0.9::double * total - below) / (c - below) * (upper - low) END, 6) AS estimate FROM f WHERE n = 1""")
def percentiles(spark, d):
    return drift.histogram_percentile(drift.histogram(behaviour(spark, d), "event_type", "price_at_event", _BOUNDS), "event_type", 0.9)
