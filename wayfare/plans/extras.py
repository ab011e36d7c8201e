"""Smaller queries: fills, norms, counts, digests, strides, known pairs, projections, registry checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfare.functions.distributed import row_numbers
from wayfare.functions.expr import dot
from wayfare.operators import retrieval as R
from wayfare.plans.cleaning import HISTORY_SQL, SPLIT, _history
from wayfare.plans.features import splits
from wayfare.plans.registry import query
from wayfare.plans.retrieval import MATRIX_SQL
from wayfare.sources.tables import BEHAVIOUR_SQL as A
from wayfare.sources.tables import behaviour, scratch, table


@query("prj8_null_fill", f"""WITH {HISTORY_SQL}, l AS (SELECT item_id, try_cast(last(value ORDER BY ts, value) AS int) AS category, min(ts) FILTER (value = '1') AS available, min(ts) AS seen FROM h GROUP BY item_id)
SELECT item_id, coalesce(category, -1) AS category, coalesce(available, seen) AS available_from FROM l""")
def null_fill(spark, d):
    h = _history(spark, d)
    g = h.groupBy("item_id").agg(F.max(F.struct("ts", "value"))["value"].alias("v"), F.min(F.when(F.col("value") == "1", F.col("ts"))).alias("a"), F.min("ts").alias("s"))
    return g.select("item_id", F.coalesce(F.expr("try_cast(v AS INT)"), F.lit(-1)).alias("category"), F.coalesce("a", "s").alias("available_from"))


@query("ag9_item_norms", f"WITH {SPLIT}, {MATRIX_SQL} SELECT item_id, round(sqrt(sum(w * w)), 6) AS norm, count(*) AS degree FROM mx GROUP BY 1")
def norms(spark, d):
    m = R.user_item(splits(spark, d)[1])
    return m.groupBy("item_id").agg(F.round(F.sqrt(F.sum(F.col("w") * F.col("w"))), 6).alias("norm"), F.count(F.lit(1)).alias("degree"))


@query("ag10_user_histories", f"WITH {SPLIT} SELECT user_id, array_to_string(list_sort(list_distinct(list(item_id))), ',') AS items FROM tr GROUP BY 1")
def histories(spark, d):
    h = splits(spark, d)[1].groupBy("user_id").agg(F.array_sort(F.collect_set("item_id")).alias("s"))
    return h.select("user_id", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("items"))


@query("ag11_value_counts", f"WITH {A} SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items FROM a GROUP BY 1")
def value_counts(spark, d):
    return behaviour(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("items"))


@query("ag12_root_sizes", "SELECT n_regionkey AS root, count(*) AS items FROM nation GROUP BY 1")
def root_sizes(spark, d):
    return table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("root")).agg(F.count(F.lit(1)).alias("items"))


@query("ag23_dataset_digest", f"""WITH {SPLIT} SELECT sha256(concat_ws('|', (SELECT count(*) FROM a), (SELECT count(DISTINCT user_id) FROM a), (SELECT count(DISTINCT item_id) FROM a), t1, t2)) AS digest FROM q""")
def digest(spark, d):
    from wayfare.operators.sessions import split_bounds

    e = behaviour(spark, d)
    one = e.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("u"), F.countDistinct("item_id").alias("i")).join(split_bounds(e))
    return one.select(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("n", "u", "i", "t1", "t2")]), 256).alias("digest"))


@query("tk8_stride_sample", "WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings) SELECT vec_id FROM r WHERE i % greatest(1, n // 40) = 0 AND i // greatest(1, n // 40) < 40")
def stride(spark, d):
    v = table(spark, d, "embeddings").select("vec_id")
    r = row_numbers(v, ["vec_id"], "i").join(F.broadcast(v.agg(F.count(F.lit(1)).alias("n"))))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 40))
    return r.where(((F.col("i") - 1) % step == 0) & (F.floor((F.col("i") - 1) / step) < 40)).select("vec_id")


@query("jn16_known_pairs", f"""WITH {SPLIT}, k AS (SELECT DISTINCT user_id, item_id FROM tr) SELECT te.event_id, k.user_id IS NOT NULL AS known FROM te LEFT JOIN k ON k.user_id = te.user_id AND k.item_id = te.item_id""")
def known_pairs(spark, d):
    _, train, test = splits(spark, d)
    k = train.select("user_id", "item_id").distinct().withColumn("known", F.lit(True))
    return test.join(k, ["user_id", "item_id"], "left").select("event_id", F.coalesce("known", F.lit(False)).alias("known"))


@query("vx7_fixed_projection", """WITH w AS (SELECT [((range * 7 + 3) % 11 - 5)::double / 10 FOR range IN range(64)] AS a, [((range * 5 + 1) % 13 - 6)::double / 10 FOR range IN range(64)] AS b)
SELECT vec_id AS id, round(list_inner_product([x::double FOR x IN embedding], a), 5) AS x, round(list_inner_product([x::double FOR x IN embedding], b), 5) AS y FROM embeddings, w""")
def projection(spark, d):
    basis = [[((i * 7 + 3) % 11 - 5) / 10 for i in range(64)], [((i * 5 + 1) % 13 - 6) / 10 for i in range(64)]]
    on = lambda w: F.round(dot(F.col("embedding"), F.array(*map(F.lit, w))), 5)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), on(basis[0]).alias("x"), on(basis[1]).alias("y"))


@query("snk7_single_production", "SELECT p_brand AS model_type, count(*) FILTER (p_size = 1) AS in_production FROM part GROUP BY 1 HAVING count(*) FILTER (p_size = 1) > 1")
def production(spark, d):
    """Model types with more than one production model; sizes stand in for statuses."""
    g = table(spark, d, "part").groupBy(F.col("p_brand").alias("model_type")).agg(F.count_if(F.col("p_size") == 1).alias("in_production"))
    return g.where("in_production > 1")


@query("snk6_vector_transport")
def transport(spark, d):
    """Embeddings as base64 of little-endian 32-bit floats."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), R.vector_text(F.col("embedding")).alias("data"))


@query("snk6_vector_round_trip", "SELECT vec_id AS id, len(embedding) AS size, round(list_sum([x::double FOR x IN embedding]), 5) AS total, round(embedding[1]::double, 6) AS first FROM embeddings")
def round_trip(spark, d):
    """Embeddings written as text, read back and decoded."""
    path = scratch(spark, "vector-text")
    transport(spark, d).write.parquet(path)
    v = spark.read.parquet(path).select("id", R.text_vector(F.col("data")).alias("v"))
    return v.select("id", F.size("v").cast("long").alias("size"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"), F.round(F.get("v", F.lit(0)).cast("double"), 6).alias("first"))
