"""Queries over retrieval, fusion, ranking, reranking and serving."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfare.operators import asof, evaluate, graph, ingest, neighbours, neural, popularity, projection, ranking, sessions, towers, vectors
from wayfare.operators import retrieval as R
from wayfare.plans.cleaning import SESSION_SQL, SPLIT, WEIGHT_SQL
from wayfare.plans.features import POP_SQL, TREND_SQL, pop_scores, splits, trend_scores
from wayfare.plans.registry import ORACLES, query
from wayfare.sources.tables import BEHAVIOUR_SQL as A
from wayfare.sources.tables import behaviour, checkpointed, scratch, table

MATRIX_SQL = f"mx AS (SELECT user_id, item_id, sum({WEIGHT_SQL}) AS w FROM tr WHERE {WEIGHT_SQL} >= 1 GROUP BY 1, 2)"
SIM_SQL = f"""{MATRIX_SQL}, nm AS (SELECT item_id, sqrt(sum(w * w)) AS norm, count(*) AS degree FROM mx GROUP BY 1),
sm AS (SELECT item_i, item_j, round(dot / (a.norm * b.norm) / pow(b.degree::double, 0.5::double), 9) AS sim FROM
  (SELECT x.item_id AS item_i, y.item_id AS item_j, sum(x.w * y.w) AS dot FROM mx x JOIN mx y ON x.user_id = y.user_id AND x.item_id <> y.item_id GROUP BY 1, 2) d JOIN nm a ON a.item_id = item_i JOIN nm b ON b.item_id = item_j),
sim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_i ORDER BY sim DESC, item_j) AS rank FROM sm WHERE sim >= 0.0001) WHERE rank <= 200)"""
CF_SQL = f"{SIM_SQL}, cf AS (SELECT user_id, item_j AS item_id, round(sum(w * sim) + 1e-10::double, 6) AS score FROM mx JOIN sim ON item_i = item_id GROUP BY 1, 2)"
TOP = 30
SOURCES = ["item_cf", "popularity", "trending"]
RANKED_SQL = f"""{CF_SQL}, {POP_SQL}, {TREND_SQL}, us AS (SELECT DISTINCT user_id FROM tr),
rk AS (SELECT * FROM (SELECT user_id, 'item_cf' AS source, 1 AS s, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM cf
  UNION ALL SELECT user_id, 'popularity', 2, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) FROM pop, us
  UNION ALL SELECT user_id, 'trending', 3, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) FROM trend, us) WHERE rank <= {TOP}),
hist AS (SELECT DISTINCT user_id, item_id FROM tr)"""
FUSED_SQL = f"""{RANKED_SQL}, fx AS (SELECT user_id, item_id, round(sum(1.0::double / (60 + rank)), 9) AS fused, count(*) AS n_sources, min(s * 1000 + rank) AS f FROM rk WHERE (user_id, item_id) NOT IN (SELECT user_id, item_id FROM hist) GROUP BY 1, 2),
fu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY fused DESC, f, item_id) AS position FROM fx) WHERE position <= 25)"""


def similarity(train):
    m = checkpointed(R.user_item(train), "matrix")  # read several times
    return m, R.item_similarity(m)


def _even(score):
    """Rounded to 6 places; sums of numbers of 9 places end in exact halves, which a nudge rounds alike in any order."""
    return F.round(score + 1e-10, 6)


def cf(train):
    m, s = similarity(train)
    return R.cf_scores(m, s).withColumn("score", _even(F.col("score")))


def ranked_sources(train):
    """(user_id, source, item_id, score, rank): per-user lists, and the TOP of each global list for every user."""
    users = train.select("user_id").distinct()
    cols = ["user_id", "source", "item_id", "score", "rank"]
    out = R.top_k(cf(train), TOP).withColumn("source", F.lit("item_cf")).select(*cols)
    for name, scores in (("popularity", pop_scores(train)), ("trending", trend_scores(train))):
        best = popularity.top_items(scores, TOP).collect()  # TOP rows
        rows = F.array(*[F.struct(F.lit(r.item_id).alias("item_id"), F.lit(r.score).alias("score"), F.lit(i + 1).alias("rank")) for i, r in enumerate(best)])
        out = out.unionByName(users.select("user_id", F.lit(name).alias("source"), F.inline(rows)) if best else out.limit(0))
    return out


def listed(train, sources):
    """About how many rows the lists of so many sources and the histories have at most."""
    n = train.agg(F.count(F.lit(1)).alias("events"), F.approx_count_distinct("user_id").alias("users")).first()
    return n.events + n.users * TOP * sources


def fused(train):
    return R.fuse(ranked_sources(train), SOURCES, train.select("user_id", "item_id").distinct(), 25, expected=listed(train, len(SOURCES)))


@query("ag8_user_item_matrix", f"WITH {SPLIT}, {MATRIX_SQL} SELECT user_id, item_id, round(w, 6) AS w FROM mx")
def matrix(spark, d):
    return R.user_item(splits(spark, d)[1]).withColumn("w", F.round("w", 6))


@query("md4_item_similarity", f"WITH {SPLIT}, {SIM_SQL} SELECT item_i, item_j, sim FROM sim")
def md4(spark, d):
    return similarity(splits(spark, d)[1])[1].select("item_i", "item_j", "sim")


@query("tk4_similar_items", f"WITH {SPLIT}, {SIM_SQL} SELECT item_i, item_j, round(sim, 6) AS sim, rank FROM sim WHERE rank <= 10")
def similar(spark, d):
    s = similarity(splits(spark, d)[1])[1]
    return s.where("rank <= 10").select("item_i", "item_j", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query("md5_cf_topk", f"""WITH {SPLIT}, {CF_SQL}, hist AS (SELECT DISTINCT user_id, item_id FROM tr),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM cf WHERE (user_id, item_id) NOT IN (SELECT user_id, item_id FROM hist)) SELECT user_id, item_id, score, rank FROM r WHERE rank <= 10""")
def md5(spark, d):
    train = splits(spark, d)[1]
    return R.top_k(R.without_seen(cf(train), train), 10).select("user_id", "item_id", "score", F.col("rank").cast("long").alias("rank"))


@query("tk2_source_lists", f"WITH {SPLIT}, {RANKED_SQL} SELECT user_id, source, item_id, score, rank FROM rk")
def lists(spark, d):
    return ranked_sources(splits(spark, d)[1]).select("user_id", "source", "item_id", "score", F.col("rank").cast("long").alias("rank"))


@query("fu1_rank_fusion", f"WITH {SPLIT}, {FUSED_SQL} SELECT user_id, item_id, fused, n_sources, position FROM fu")
def fu1(spark, d):
    return fused(splits(spark, d)[1]).select("user_id", "item_id", "fused", "n_sources", F.col("position").cast("long").alias("position"))


@query("fu2_source_scores", f"WITH {SPLIT}, {RANKED_SQL} SELECT user_id, item_id, {', '.join(f'max(score) FILTER (source = {s!r}) AS {s}' for s in SOURCES)} FROM rk GROUP BY 1, 2")
def fu2(spark, d):
    return R.source_scores(ranked_sources(splits(spark, d)[1]), SOURCES)


@query("sv12_source_overlap", f"WITH {SPLIT}, {FUSED_SQL} SELECT sum(n_sources)::bigint AS proposed, count(*) AS distinct_candidates, (sum(n_sources) - count(*))::bigint AS overlap FROM fu")
def overlap(spark, d):
    return R.source_overlap(fused(splits(spark, d)[1]))


#: Sessions of the test window, of three events at most, and their items.
_TEST_SESSIONS = f"{SESSION_SQL.removeprefix(A + ',').strip().replace(', z AS', ', zz AS').replace(chr(10) + 'z AS', chr(10) + 'zz AS')}, ss AS (SELECT DISTINCT session_id AS session, item_id FROM zz WHERE event_id IN (SELECT event_id FROM te))"


def _session_items(spark, d):
    later = splits(spark, d)[2].select("event_id")
    return sessions.sessionize(behaviour(spark, d), 30, 3).join(later, "event_id", "left_semi").select(F.col("session_id").alias("session"), "item_id").distinct()


@query("sv5_session_affinity", f"""WITH {SPLIT}, {SIM_SQL}, {_TEST_SESSIONS} SELECT session, item_j AS item_id, round(sum(sim) + 1e-10::double, 6) AS score FROM ss JOIN sim ON item_i = ss.item_id GROUP BY 1, 2""")
def affinity(spark, d):
    s = similarity(splits(spark, d)[1])[1]
    return R.session_affinity(_session_items(spark, d), s).withColumn("score", _even(F.col("score")))


@query("sv4_cold_start", f"""WITH {SPLIT}, {SIM_SQL}, {POP_SQL}, {_TEST_SESSIONS}, af AS (SELECT session, item_j AS item_id, round(sum(sim) + 1e-10::double, 6) AS score FROM ss JOIN sim ON item_i = ss.item_id GROUP BY 1, 2),
pp AS (SELECT item_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS pop FROM pop),
z AS (SELECT s.session, pp.item_id, pop, coalesce(af.score, 0) AS a FROM (SELECT DISTINCT session FROM ss) s CROSS JOIN pp LEFT JOIN af ON af.session = s.session AND af.item_id = pp.item_id),
y AS (SELECT session, item_id, round(0.7::double * CASE WHEN max(a) OVER w > min(a) OVER w THEN (a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w) ELSE 0 END + 0.3::double * pop, 9) AS score FROM z WINDOW w AS (PARTITION BY session)),
r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, item_id) AS rank FROM y WHERE (session, item_id) NOT IN (SELECT session, item_id FROM ss))
SELECT session, item_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def cold(spark, d):
    train = splits(spark, d)[1]
    items = _session_items(spark, d)
    aff = R.session_affinity(items, similarity(train)[1]).withColumn("score", _even(F.col("score")))
    out = R.cold_start(aff, pop_scores(train), items, 10)
    return out.select("session", "item_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("sv1_recommend_all", f"""WITH {SPLIT}, {FUSED_SQL}, z AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id % 8 ORDER BY position) AS m FROM fu)
SELECT * FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY position) AS position FROM z WHERE m <= 2) WHERE position <= 10""")
def recommend_all(spark, d):
    """Every user's list: retrieve, fuse, leave out what was seen, at most two items of a merchant."""
    f = fused(splits(spark, d)[1]).withColumn("merchant_id", (F.col("item_id") % 8).cast("int"))
    items = f.select("user_id", "item_id", "merchant_id", F.lit(None).cast("int").alias("category_id"), (-F.col("position")).cast("double").alias("final"))
    return ranking.diversify(items, 10).where("NOT relaxed").select("user_id", "item_id", F.col("position").cast("long").alias("position"))


_FEATURES = ["fused", "n_sources", "item_cf", "popularity", "trending", "item_event_count", "user_event_count"]


def candidates(spark, d):
    """(all events, train, candidates from the training window with their features, without labels)."""
    every, train, _ = splits(spark, d)
    cand = R.fuse(ranked_sources(train), SOURCES, train.select("user_id", "item_id"), 25, scores=True, expected=listed(train, len(SOURCES)))
    items = checkpointed(asof.item_state(train).select("item_id", F.col("events").alias("item_event_count")), "item-counts")
    cand = cand.join(asof.user_state(train).select("user_id", F.col("events").alias("user_event_count")), "user_id", "left")
    return every, train, cand.join(items, "item_id", "left").select("user_id", "item_id", *_FEATURES)


def labelled(every, train, cand, window):
    """The candidates with the labels of a later window."""
    return ranking.ranking_dataset(cand, evaluate.novel_truth(every.where(F.col("split") == window), train), _FEATURES)


def dataset(spark, d, window="test"):
    """Candidates from the training window with the labels of a later one."""
    return labelled(*candidates(spark, d), window)


@query("rk2_ranking_dataset", f"""WITH {SPLIT}, {FUSED_SQL}, tt AS (SELECT DISTINCT user_id, item_id FROM te EXCEPT SELECT user_id, item_id FROM hist),
sc AS (SELECT user_id, item_id, {', '.join(f'max(score) FILTER (source = {s!r}) AS {s}' for s in SOURCES)} FROM rk GROUP BY 1, 2),
z AS (SELECT fu.user_id, fu.item_id, fused, n_sources, item_cf, popularity, trending, (SELECT count(*) FROM tr WHERE tr.item_id = fu.item_id) AS item_event_count, (SELECT count(*) FROM tr WHERE tr.user_id = fu.user_id) AS user_event_count,
  (CASE WHEN (fu.user_id, fu.item_id) IN (SELECT user_id, item_id FROM tt) THEN 1 ELSE 0 END)::int AS label FROM fu JOIN sc USING (user_id, item_id))
SELECT * FROM z QUALIFY sum(label) OVER (PARTITION BY user_id) > 0""")
def rk2(spark, d):
    return dataset(spark, d)


@query("rk3_pairwise_ranker")
def rk3(spark, d):
    data = checkpointed(dataset(spark, d), "ranking")
    return ranking.linear_rank(data, ranking.fit_pairwise(ranking.pairwise(data, _FEATURES, "fused"), _FEATURES), 10).select("user_id", "item_id", "label", "score", "rank")


_LINEAR = {"fused": 30.0, "item_cf": 0.2, "popularity": 0.001}
_LINEAR_SCORE = " + ".join(f"coalesce({c}, 0)::double * {w}::double" for c, w in _LINEAR.items())


@query("rk4_explanations", f"""WITH x AS ({ORACLES['rk2_ranking_dataset']}), t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_LINEAR_SCORE} DESC, item_id) AS rank FROM x),
m AS (SELECT {', '.join(f'avg(coalesce({c}, 0)::double) AS m_{c}' for c in _LINEAR)} FROM x),
v AS (SELECT user_id, item_id, unnest({list(_LINEAR)}) AS feature, unnest([{', '.join(f'{w}::double * (coalesce({c}, 0)::double - m_{c})' for c, w in _LINEAR.items())}]) AS value FROM t, m WHERE rank <= 5),
q AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY abs(value) DESC, feature) - 1 AS place FROM v)
SELECT user_id, item_id, place::int AS place, feature, round(value, 6) AS value FROM q WHERE place < 2""")
def rk4(spark, d):
    data, w = dataset(spark, d), _LINEAR
    reasons = ranking.explain_linear(ranking.linear_rank(data, w, 5), data, w, 2)
    return reasons.select("user_id", "item_id", F.posexplode("reasons").alias("place", "r")).select("user_id", "item_id", "place", "r.feature", F.round("r.value", 6).alias("value"))


def _shelf(spark, d):
    p = table(spark, d, "part")
    return p.select(F.floor(F.col("p_partkey") / 50).alias("user_id"), F.col("p_partkey").alias("item_id"), F.round(F.col("p_retailprice") / 1000 + (F.col("p_partkey") * 37 % 101) / 100, 4).alias("score"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_partkey") % 5).cast("int").alias("merchant_id"), F.when(F.col("p_partkey") % 13 != 0, F.col("p_size") % 4).cast("int").alias("category_id"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey") % 9 != 0).alias("is_available"), F.when(F.col("p_partkey") % 6 != 0, (F.col("p_partkey") % 60).cast("double")).alias("delivery_minutes"), (F.col("p_partkey") % 10 == 0).alias("is_sponsored"), ((F.col("p_partkey") % 100) / 100).alias("popularity_rank"))


SHELF_SQL = """sh AS (SELECT p_partkey // 50 AS user_id, p_partkey AS item_id, round(p_retailprice / 1000 + (p_partkey * 37 % 101) / 100, 4) AS score, (CASE WHEN p_partkey % 11 <> 0 THEN p_partkey % 5 END)::int AS merchant_id,
  (CASE WHEN p_partkey % 13 <> 0 THEN p_size % 4 END)::int AS category_id, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 9 <> 0 END AS is_available, CASE WHEN p_partkey % 6 <> 0 THEN (p_partkey % 60)::double END AS delivery_minutes,
  p_partkey % 10 = 0 AS is_sponsored, (p_partkey % 100) / 100 AS popularity_rank FROM part),
kp AS (SELECT *, CASE WHEN NOT coalesce(is_available, true) THEN 'unavailable' WHEN delivery_minutes > 45 THEN 'delivery_time' END AS reason FROM sh),
aj AS (SELECT *, round(score + CASE WHEN is_sponsored THEN 0.1 ELSE 0 END - 0.2 * (1 - popularity_rank), 6) AS final FROM kp WHERE reason IS NULL)"""


@query("rr1_hard_filters", f"WITH {SHELF_SQL} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM kp GROUP BY 1")
def rr1(spark, d):
    return ranking.hard_filters(_shelf(spark, d), 45).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _adjusted(spark, d):
    kept = ranking.hard_filters(_shelf(spark, d), 45).where("reason IS NULL")
    return ranking.adjust(kept, 0.1, 0.2).withColumn("final", F.round("final", 6))


@query("rr2_adjustments", f"WITH {SHELF_SQL} SELECT item_id, final, (CASE WHEN is_sponsored THEN 1 ELSE 0 END + CASE WHEN popularity_rank <> 1 THEN 1 ELSE 0 END)::int AS n_adjustments FROM aj")
def rr2(spark, d):
    return _adjusted(spark, d).select("item_id", "final", F.size("adjustments").alias("n_adjustments"))


@query("rr3_diversity", f"""WITH RECURSIVE {SHELF_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY final DESC, item_id) AS i FROM aj),
g AS (SELECT user_id, 0::bigint AS i, []::int[] AS ms, []::int[] AS cs, []::bigint[] AS ids FROM (SELECT DISTINCT user_id FROM o)
  UNION ALL SELECT o.user_id, o.i, CASE WHEN f THEN list_append(ms, o.merchant_id) ELSE ms END, CASE WHEN f THEN list_append(cs, o.category_id) ELSE cs END, CASE WHEN f THEN list_append(ids, o.item_id) ELSE ids END
  FROM (SELECT g.*, o.i AS ni, o.item_id, o.merchant_id, o.category_id, len(ids) < 15 AND (o.merchant_id IS NULL OR len(list_filter(ms, lambda x: x = o.merchant_id)) < 2) AND (o.category_id IS NULL OR len(list_filter(cs, lambda x: x = o.category_id)) < 3) AS f
        FROM g JOIN o ON o.user_id = g.user_id AND o.i = g.i + 1) o_),
e AS (SELECT user_id, arg_max(ids, i) AS ids FROM g GROUP BY 1),
c AS (SELECT user_id, unnest(ids) AS item_id, generate_subscripts(ids, 1) AS position FROM e),
l AS (SELECT o.user_id, o.item_id, len(e.ids) + row_number() OVER (PARTITION BY o.user_id ORDER BY o.i) AS position FROM o JOIN e ON e.user_id = o.user_id WHERE NOT list_contains(e.ids, o.item_id))
SELECT user_id, position::int AS position, item_id, false AS relaxed FROM c UNION ALL SELECT user_id, position::int, item_id, true FROM l WHERE position <= 15""".replace("SELECT o.user_id, o.i, CASE WHEN f THEN list_append(ms, o.merchant_id) ELSE ms END, CASE WHEN f THEN list_append(cs, o.category_id) ELSE cs END, CASE WHEN f THEN list_append(ids, o.item_id) ELSE ids END", "SELECT o_.user_id, o_.ni, CASE WHEN f THEN list_append(ms, o_.merchant_id) ELSE ms END, CASE WHEN f THEN list_append(cs, o_.category_id) ELSE cs END, CASE WHEN f THEN list_append(ids, o_.item_id) ELSE ids END"))
def rr3(spark, d):
    return ranking.diversify(_adjusted(spark, d), 15)


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


_COS_SQL = """v AS (SELECT vec_id AS id, [x::double / sqrt(list_sum([y::double * y::double FOR y IN embedding])) FOR x IN embedding] AS e FROM embeddings),
tk AS (SELECT * FROM (SELECT q.id AS query, v.id, round(list_inner_product(q.e, v.e), 6) AS score, row_number() OVER (PARTITION BY q.id ORDER BY round(list_inner_product(q.e, v.e), 6) DESC, v.id) AS rank FROM v q JOIN v ON q.id % 100 = 0 AND q.id <> v.id) WHERE rank <= 10)"""


def _asked(v):
    """The query set of searches."""
    return v.where("id % 100 = 0")


@query("vx2_cosine_topk", f"WITH {_COS_SQL} SELECT query, id, score, rank::int AS rank FROM tk")
def vx2(spark, d):
    v = _vectors(spark, d)
    return vectors.cosine_topk(_asked(v), v, 10)


def _index(spark, v):
    path = scratch(spark, "index")
    vectors.build_index(v, path)
    return vectors.load_index(spark, path)


@query("tk6_index_topk")
def index_topk(spark, d):
    v = _vectors(spark, d)
    return vectors.search_index(_index(spark, v), _asked(v), 10)


@query("ev13_index_recall")
def index_recall(spark, d):
    v = _vectors(spark, d)
    return evaluate.overlap_at_k(vectors.search_index(_index(spark, v), _asked(v), 10), vectors.cosine_topk(_asked(v), v, 10), 10)


@query("vx3_index_benchmark")
def index_benchmark(spark, d):
    v = _vectors(spark, d)
    return vectors.benchmark(v, _asked(v), scratch(spark, "index"))


def _graph(spark, v):
    path = scratch(spark, "graph")
    graph.build_graph(v, path)
    return graph.load_graph(spark, path)


@query("tk6_graph_topk")
def graph_topk(spark, d):
    """Answers of the layered proximity graph, with how many rows each query was compared with."""
    v = _vectors(spark, d)
    return graph.search_graph(_graph(spark, v), _asked(v), 10)


@query("ev13_graph_recall")
def graph_recall(spark, d):
    v = _vectors(spark, d)
    return evaluate.overlap_at_k(graph.search_graph(_graph(spark, v), _asked(v), 10), vectors.cosine_topk(_asked(v), v, 10), 10)


@query("vx3_index_comparison")
def index_comparison(spark, d):
    """Recall of the graph and of the inverted file, and the shares of all rows that a query is compared with."""
    v = _vectors(spark, d)
    return graph.compare(v, _asked(v), scratch(spark, "indexes"), checkpointed(vectors.cosine_topk(_asked(v), v, 10), "exact"), 10)


@query("fu3_index_source")
def index_source(spark, d):
    """Fusion with a source that the graph index answers: the items whose ALS vectors lie nearest to a user's."""
    train = splits(spark, d)[1]
    model = R.als(R.user_item(train))
    near = graph.search_graph(_graph(spark, model.itemFactors.withColumnRenamed("features", "embedding")), model.userFactors.withColumnRenamed("features", "embedding"), TOP, others=False)
    found = near.select(F.col("query").alias("user_id"), F.lit("als_index").alias("source"), F.col("id").cast("int").alias("item_id"), "score", "rank")
    ranked = ranked_sources(train).select("user_id", "source", "item_id", "score", "rank").unionByName(found)
    return R.fuse(ranked, [*SOURCES, "als_index"], train.select("user_id", "item_id").distinct(), 25, expected=listed(train, len(SOURCES) + 1)).select("user_id", "item_id", "fused", "n_sources", "position")


@query("vx1_vector_checks", "SELECT count(*) AS rows, count(*) FILTER (len(embedding) <> 64) AS wrong_size, count(*) FILTER (len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0) AS not_finite FROM embeddings")
def vx1(spark, d):
    return R.bad_vectors(_vectors(spark, d), 64)


@query("vx4_stratified_sample", """WITH g AS (SELECT *, count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS a, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::varchar), vec_id) AS r FROM embeddings)
SELECT vec_id AS id, label FROM g WHERE r <= greatest(1, round(100 * n / a))""")
def vx4(spark, d):
    return R.stratified(_vectors(spark, d), "label", "id", 100).select("id", "label")


@query("vx5_pca_sphere")
def vx5(spark, d):
    p = R.pca_sphere(_vectors(spark, d))
    return p.select("id", *[F.round(F.abs(F.col("u")[i]), 6).alias(f"u{i}") for i in range(3)])


@query("vx6_neighbour_graph")
def neighbour_graph(spark, d):
    """The neighbours of every vector by NN-descent."""
    return neighbours.neighbour_graph(_vectors(spark, d)).select("id", "near", F.round("score", 6).alias("score"))


@query("vx6_neighbour_map")
def neighbour_map(spark, d):
    """All vectors in three dimensions that keep neighbourhoods."""
    return neighbours.map_vectors(_vectors(spark, d)).select("id", *[F.col("p")[i].alias(c) for i, c in enumerate("xyz")])


@query("vx7_kept_projection")
def kept_projection(spark, d):
    """All vectors in the components of the even ids, by a basis that was saved and loaded."""
    v, path = _vectors(spark, d), scratch(spark, "basis")
    projection.save_projection(spark, projection.fit_projection(v.where("id % 2 = 0")), path)
    p = projection.project(v, projection.load_projection(spark, path))
    return p.select("id", *[F.round(F.col("u")[i], 6).alias(f"u{i}") for i in range(3)])


@query("vx8_barycentre", f"""WITH {_COS_SQL}, p AS (SELECT *, exp((score - max(score) OVER (PARTITION BY query)) / 0.05::double) AS w FROM tk)
SELECT query, round(sum(w * (id % 7)) / sum(w), 5) AS x, round(sum(w * (id % 11)) / sum(w), 5) AS y, round(sum(w * (id % 13)) / sum(w), 5) AS z FROM p GROUP BY 1""")
def vx8(spark, d):
    v = _vectors(spark, d)
    places = v.select("id", *[(F.col("id") % m).cast("double").alias(c) for c, m in (("x", 7), ("y", 11), ("z", 13))])
    return R.barycentre(vectors.cosine_topk(_asked(v), v, 10), places).select("query", *[F.round(c, 5).alias(c) for c in "xyz"])


@query("ag21_log_sampling", f"WITH {SPLIT}, c AS (SELECT item_id, (SELECT count(*) FROM tr WHERE tr.item_id = i.item_id) AS n FROM (SELECT DISTINCT item_id FROM a) i) SELECT item_id, round(ln((n + 1) / sum(n + 1) OVER ()), 6) AS logq FROM c")
def logq(spark, d):
    train = splits(spark, d)[1]
    counts = train.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return R.log_sampling(counts, behaviour(spark, d).select("item_id")).withColumn("logq", F.round("logq", 6))


@query("set_operations", f"""WITH {SPLIT}, x AS (SELECT DISTINCT user_id, item_id FROM tr), y AS (SELECT DISTINCT user_id, item_id FROM te)
SELECT (SELECT count(*) FROM (FROM x UNION FROM y)) AS either, (SELECT count(*) FROM (FROM x INTERSECT FROM y)) AS both_sides, (SELECT count(*) FROM (FROM y EXCEPT FROM x)) AS only_test""")
def sets(spark, d):
    _, train, test = splits(spark, d)
    x, y = train.select("user_id", "item_id"), test.select("user_id", "item_id")
    n = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    return n(x.union(y).distinct(), "either").join(n(x.intersect(y), "both_sides")).join(n(y.subtract(x), "only_test"))


@query("md6_als_topk")
def als(spark, d):
    return R.als_topk(R.als(R.user_item(splits(spark, d)[1])), 10)


def _indexed(train):
    users = ingest.dense_ids(train, "user_id").withColumnRenamed("index", "user_index")
    items = ingest.dense_ids(train, "item_id")
    return users, items


@query("md7_negatives", f"""WITH {SPLIT}, {MATRIX_SQL}, it AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM (SELECT DISTINCT item_id FROM tr)),
dr AS (SELECT user_id, item_id, ('0x' || substr(md5(concat_ws('|', '42', user_id, item_id, d)), 1, 15))::bigint % (SELECT count(*) FROM it) AS i FROM mx, unnest([1, 2]) u(d))
SELECT user_id, dr.item_id, it.item_id AS negative FROM dr JOIN it USING (i) WHERE (user_id, it.item_id) NOT IN (SELECT user_id, item_id FROM mx)""")
def md7(spark, d):
    train = splits(spark, d)[1]
    return R.negatives(R.user_item(train), _indexed(train)[1], 2)


@query("md6_bpr_topk")
def bpr(spark, d):
    path = scratch(spark, "factors")
    neural.save_factors(*neural.fit_bpr(R.user_item(splits(spark, d)[1])), path)
    return neural.factor_topk(*neural.load_factors(spark, path), 10)


_USER_FEATURES = ("user_event_count", "user_purchase_count", "user_conversion_rate", "user_avg_interaction_price")


def _scaled(df, columns, stats):
    """Columns less their mean, over their deviation; stats: one row of both."""
    return [(F.coalesce(F.col(c).cast("double"), F.lit(stats[f"{c}_m"])) - stats[f"{c}_m"]) / max(stats[f"{c}_s"], 1e-9) for c in columns]


def _stats(df, columns):
    one = df.agg(*[f(c).alias(f"{c}_{s}") for c in columns for f, s in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    return {k: v or 0.0 for k, v in one.asDict().items()}


def tower_data(train):
    """(pairs, items, users) for the towers: numbers as x, categories as keys; users and items as the window leaves them.

    Pairs carry what was known of their user before them; items' x ends with the log of their sampling odds.
    """
    before = asof.asof_features(train).where(F.col("event_type").isin(6, 9))
    stats = _stats(before, _USER_FEATURES)
    user_x = lambda df: F.array(*_scaled(df, _USER_FEATURES, stats))
    user_c = F.array(towers.category("region_id", "region_id"))
    pairs = checkpointed(before.select("user_id", "item_id", user_x(before).alias("x"), user_c.alias("c")), "tower-pairs")
    kinds = train.groupBy("item_id").agg(F.max("vertical").alias("vertical"), F.max("merchant_id").alias("merchant_id"))
    seen = asof.item_state(train).join(kinds, "item_id").select("item_id", "vertical", "merchant_id", *[F.log1p(c).alias(c) for c in ("events", "purchases", "distinct_users")])
    counts = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    seen = checkpointed(seen.join(R.log_sampling(counts, seen), "item_id"), "tower-items")
    numbers = ("events", "purchases", "distinct_users")
    item_stats = _stats(seen, numbers)
    item_c = F.array(*[towers.category(c, c) for c in ("vertical", "merchant_id")])
    items = checkpointed(seen.select("item_id", F.array(*_scaled(seen, numbers, item_stats), F.col("logq")).alias("x"), item_c.alias("c")), "tower-items")
    last = asof.user_state(train).join(train.groupBy("user_id").agg(F.max("region_id").alias("region_id")), "user_id")
    last = last.select(F.col("user_id").alias("id"), "region_id", F.col("events").alias("user_event_count"), F.col("purchases").alias("user_purchase_count"), (F.col("purchases") / F.col("events")).alias("user_conversion_rate"), F.col("avg_price").alias("user_avg_interaction_price"))
    return pairs, items, last.select("id", user_x(last).alias("x"), user_c.alias("c"))


def two_towers(train):
    """(users, items): encoded vectors of everybody and everything seen in training, by towers that were saved and loaded."""
    pairs, items, users = tower_data(train)
    path = scratch(train.sparkSession, "towers")
    towers.save_towers(towers.fit_two_tower(pairs, items), path)
    model = towers.load_towers(train.sparkSession, path)
    things = items.select(F.col("item_id").alias("id"), F.slice("x", F.lit(1), F.size("x") - 1).alias("x"), "c")
    return model.encode(users, 0), model.encode(things, 1)


@query("md8_two_tower_topk")
def two_tower(spark, d):
    return neural.factor_topk(*two_towers(splits(spark, d)[1]), 10)


@query("sv2_four_sources")
def four_sources(spark, d):
    """Fusion with the towers' lists; users that the towers have no vector for are served by the other sources."""
    train = splits(spark, d)[1]
    lists = neural.factor_topk(*two_towers(train), TOP).select("user_id", F.lit("two_tower").alias("source"), F.col("item_id").cast("int").alias("item_id"), "score", "rank")
    ranked = ranked_sources(train).select("user_id", "source", "item_id", "score", "rank").unionByName(lists)
    return R.fuse(ranked, [*SOURCES, "two_tower"], train.select("user_id", "item_id").distinct(), 25, expected=listed(train, len(SOURCES) + 1)).select("user_id", "item_id", "fused", "n_sources", "position")
