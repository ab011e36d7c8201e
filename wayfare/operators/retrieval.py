"""Retrieval: item-item collaborative filtering, factorisation, vectors, rank fusion, serving compositions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.distributed import row_numbers
from wayfare.functions.expr import dot, weight
from wayfare.sources.tables import counted

NEIGHBOURS, LEAST_SIMILARITY, POPULARITY_POWER, MIN_WEIGHT = 200, 1e-4, 0.5, 1.0
RRF_K, CANDIDATES = 60, 600
#: Items of a user that are paired in one task; similarities that are broadcast in one round.
HEAVY, SENT_PAIRS = 1000, 1_000_000
#: What a task takes of users' work, on average: similarities added to scores, rows of lists to fuse.
TASK_HITS, TASK_ROWS = 2_000_000, 500_000


def user_item(train: DataFrame, min_weight: float = MIN_WEIGHT) -> DataFrame:
    """(user_id, item_id, w): summed event weights, of events that weigh at least min_weight."""
    rows = train.withColumn("_w", weight(F.col("event_type"), 0.0)).where(F.col("_w") >= min_weight)
    return rows.groupBy("user_id", "item_id").agg(F.sum("_w").alias("w"))


def item_similarity(matrix: DataFrame, neighbours: int = NEIGHBOURS, least: float = LEAST_SIMILARITY, power: float = POPULARITY_POWER) -> DataFrame:
    """(item_i, item_j, sim, rank): cosine of item columns over users, divided by the popularity of j to a power.

    Each pair is made once and mirrored after it is summed; users with more than HEAVY items are dealt over blocks of
    their items, so that no task pairs a long history alone.
    """
    items = matrix.groupBy("item_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.count(F.lit(1)).alias("degree"))
    users = matrix.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / HEAVY).cast("int").alias("n"))
    rows = matrix.join(users, "user_id")
    l = rows.select("user_id", F.pmod(F.xxhash64("item_id"), "n").cast("int").alias("b"), F.col("item_id").alias("item_i"), F.col("w").alias("wi"))
    r = rows.select("user_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("b"), F.col("item_id").alias("item_j"), F.col("w").alias("wj"))
    half = l.join(r, ["user_id", "b"]).where("item_i < item_j").groupBy("item_i", "item_j").agg(F.sum(F.col("wi") * F.col("wj")).alias("dot"))
    both = F.array(F.struct("item_i", "item_j"), F.struct(F.col("item_j").alias("item_i"), F.col("item_i").alias("item_j")))
    pairs = half.select(F.explode(both).alias("p"), "dot").select("p.item_i", "p.item_j", "dot")
    a, b = items.select(F.col("item_id").alias("item_i"), F.col("norm").alias("ni")), items.select(F.col("item_id").alias("item_j"), F.col("norm").alias("nj"), "degree")
    sim = F.col("dot") / (F.col("ni") * F.col("nj")) / F.pow(F.col("degree").cast("double"), F.lit(power))
    rows = pairs.join(a, "item_i").join(b, "item_j").select("item_i", "item_j", F.round(sim, 9).alias("sim")).where(F.col("sim") >= least)
    rank = F.row_number().over(Window.partitionBy("item_i").orderBy(F.desc("sim"), "item_j"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= neighbours)


def by_user(rows: DataFrame, work: int = 0, most: int = 1) -> DataFrame:
    """rows hashed by user over all shuffle partitions, or more, so that one has about `most` of the work.

    Small ones are not put together, as a few rows may grow a hundredfold.
    """
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-work // most)), "user_id")


def cf_scores(matrix: DataFrame, similarity: DataFrame) -> DataFrame:
    """(user_id, item_id, score): history weights times similarities; users without history get no rows.

    A user's history lies in one task, and the similarities come to it in rounds of about SENT_PAIRS, each with all that
    leads to its own items: so users times similar items are added up where they arise and never shuffled.  They are
    counted before, and a task takes about TASK_HITS of them in a round.
    """
    sent, n = counted(similarity.select(F.col("item_i").alias("item_id"), "item_j", "sim"), "similarity")
    rounds = max(1, -(-n // SENT_PAIRS))
    held, near = matrix.groupBy("item_id").agg(F.count(F.lit(1)).alias("_u")), sent.groupBy("item_id").agg(F.count(F.lit(1)).alias("_s"))
    hits = held.join(near, "item_id").agg(F.sum(F.col("_u") * F.col("_s"))).first()[0] or 0
    rows = by_user(matrix, -(-hits // rounds), TASK_HITS)
    out = None
    for r in range(rounds):
        now = sent.where(F.pmod(F.xxhash64("item_j"), F.lit(rounds)) == r) if rounds > 1 else sent
        one = rows.join(F.broadcast(now), "item_id").groupBy("user_id", F.col("item_j").alias("item_id")).agg(F.sum(F.col("w") * F.col("sim")).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def session_affinity(session_items: DataFrame, similarity: DataFrame) -> DataFrame:
    """(session, item_id, score): summed similarities to the items of a session; session_items: (session, item_id)."""
    hit = session_items.join(similarity.select(F.col("item_i").alias("item_id"), "item_j", "sim"), "item_id")
    return hit.groupBy("session", F.col("item_j").alias("item_id")).agg(F.sum("sim").alias("score"))


def without_seen(scores: DataFrame, history: DataFrame) -> DataFrame:
    return scores.join(history.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def top_k(scores: DataFrame, k: int, by: str = "user_id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "item_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def global_unseen(scores: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """(user_id, item_id, score, rank): the k best unseen items of one global list (item_id, score) for each user of train.

    They lie within the list's first k + (items the user has seen) places, so that is all a user meets: rows grow with
    users and their histories, not with users times items.
    """
    seen = train.groupBy("user_id").agg(F.countDistinct("item_id").alias("n"))
    places = row_numbers(scores.select("item_id", "score"), [F.desc("score"), F.asc("item_id")], "place")
    near = seen.select("user_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") + k)).alias("place")).join(places, "place").drop("place")
    return top_k(without_seen(near, train), k)


def recommend(scores: DataFrame, k: int, exclude: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """Each user's k best items: of the candidates only, if given, and without excluded (user_id, item_id) pairs."""
    rows = scores if candidates is None else scores.join(candidates.select("item_id"), "item_id", "left_semi")
    return top_k(rows if exclude is None else without_seen(rows, exclude), k)


def fuse(ranked: DataFrame, sources: list[str], exclude: DataFrame | None = None, cap: int = CANDIDATES, k: int = RRF_K, scores: bool = False, expected: int = 0) -> DataFrame:
    """Reciprocal-rank fusion of (user_id, source, item_id, rank, score): (user_id, item_id, fused, n_sources, sources, position[, a score for each source]).

    Excluded items keep their rank places; ties go to the source listed first, then to the better rank.  Lists and
    excluded items meet by user in one shuffle; with about how many rows are `expected`, a task takes about TASK_ROWS.
    """
    at = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    rows = ranked.where("item_id >= 0").select("user_id", "item_id", "source", "rank", *(["score"] if scores else []), at.alias("_s"), F.lit(False).alias("_out"))
    if exclude is not None:
        left_out = exclude.where("user_id IS NOT NULL").select("user_id", "item_id", F.lit(True).alias("_out"))
        rows = rows.unionByName(left_out, allowMissingColumns=True)
    own = [F.max(F.when(F.col("source") == s, F.col("score"))).alias(s) for s in sources] if scores else []
    fused = by_user(rows, expected, TASK_ROWS).groupBy("user_id", "item_id").agg(F.sum(F.lit(1.0) / (F.col("rank") + k)).alias("fused"), F.count("source").alias("n_sources"), F.min(F.struct("_s", "rank")).alias("_first"), F.array_sort(F.collect_set("source")).alias("sources"), F.max("_out").alias("_out"), *own)
    fused = fused.where("NOT _out").drop("_out").withColumn("fused", F.round("fused", 9))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("fused"), "_first", "item_id"))
    return fused.withColumn("position", place).where(F.col("position") <= cap).drop("_first")


def fuse_scores(scored: DataFrame, sources: list[str], k: int = RRF_K, expected: int = 0) -> DataFrame:
    """Rank fusion of (user_id, source, item_id, score): ranks follow from the scores, nothing is excluded or cut."""
    rank = F.row_number().over(Window.partitionBy("user_id", "source").orderBy(F.desc("score"), "item_id"))
    return fuse(scored.withColumn("rank", rank), sources, None, 2**31 - 1, k, expected=expected)


def source_scores(ranked: DataFrame, sources: list[str]) -> DataFrame:
    """One column of scores for each source, null where it did not propose the item."""
    return ranked.groupBy("user_id", "item_id").agg(*[F.max(F.when(F.col("source") == s, F.col("score"))).alias(s) for s in sources])


def source_overlap(fused: DataFrame) -> DataFrame:
    """(proposed, distinct_candidates, overlap) over all users."""
    return fused.agg(F.sum("n_sources").alias("proposed"), F.count(F.lit(1)).alias("distinct_candidates"), (F.sum("n_sources") - F.count(F.lit(1))).alias("overlap"))


def cold_start(affinity: DataFrame, popularity: DataFrame, session_items: DataFrame, k: int, share: float = 0.7) -> DataFrame:
    """Sessions without a known user: share * scaled affinity + (1 - share) * scaled popularity, session items left out.

    affinity: (session, item_id, score); popularity: (item_id, score).  An item without affinity can only win from the
    first k + (items of the session) places by popularity, so a session meets those and the items it has an affinity to,
    not the whole list.  Affinity is scaled over the whole list, where items without any count 0.
    """
    ends = popularity.agg(F.min("score").alias("_l"), F.max("score").alias("_h"), F.count(F.lit(1)).alias("_items"))
    scaled = F.when(F.col("_h") > F.col("_l"), (F.col("score") - F.col("_l")) / (F.col("_h") - F.col("_l"))).otherwise(F.lit(0.0))
    pop = popularity.join(F.broadcast(ends)).select("item_id", scaled.alias("pop"), "_items")
    pop = row_numbers(pop.withColumn("_worth", F.round((1 - share) * F.col("pop"), 9)), [F.desc("_worth"), F.asc("item_id")], "place").drop("_worth")
    sizes = session_items.groupBy("session").agg(F.countDistinct("item_id").alias("n"))
    near = sizes.select("session", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") + k)).alias("place")).join(pop, "place").select("session", "item_id", "pop", F.lit(None).cast("double").alias("aff"))
    liked = affinity.join(sizes.select("session"), "session").join(pop, "item_id")
    low, high = F.min("score").over(Window.partitionBy("session")), F.max("score").over(Window.partitionBy("session"))
    whole = F.count(F.lit(1)).over(Window.partitionBy("session")) >= F.col("_items")  # else some item counts 0
    low, high = F.when(whole, low).otherwise(F.least(low, F.lit(0.0))), F.when(whole, high).otherwise(F.greatest(high, F.lit(0.0)))
    liked = liked.withColumn("aff", F.when(high > low, (F.col("score") - low) / F.nullif(high - low, F.lit(0.0))).otherwise(F.lit(0.0))).select("session", "item_id", "pop", "aff")
    both = near.unionByName(liked).groupBy("session", "item_id").agg(F.max("pop").alias("pop"), F.coalesce(F.max("aff"), F.lit(0.0)).alias("_a"))
    scored = both.select("session", "item_id", F.round(share * F.col("_a") + (1 - share) * F.col("pop"), 9).alias("score"))
    return top_k(scored.join(session_items, ["session", "item_id"], "left_anti"), k, "session")


def bad_vectors(vectors: DataFrame, size: int) -> DataFrame:
    """(rows, wrong_size, not_finite) of an embeddings table."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("embedding") != size).alias("wrong_size"), F.count_if(odd).alias("not_finite"))


def barycentre(similar: DataFrame, places: DataFrame, temperature: float = 0.05) -> DataFrame:
    """Softmax-weighted mean position of each query's neighbours; similar: (query, id, score), places: (id, x, y, z)."""
    own = Window.partitionBy("query")
    w = F.exp((F.col("score") - F.max("score").over(own)) / temperature)
    rows = similar.withColumn("_w", w).join(places, "id")
    return rows.groupBy("query").agg(*[(F.sum(F.col("_w") * F.col(c)) / F.sum("_w")).alias(c) for c in "xyz"])


def pca_sphere(vectors: DataFrame, dims: int = 3) -> DataFrame:
    """(id, p, u): centred principal components, and those scaled into the unit sphere."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="v", outputCol="c").fit(v).transform(v)
    p = PCA(k=dims, inputCol="c", outputCol="pc").fit(centred).transform(centred).select("id", vector_to_array("pc").alias("p"))
    radius = p.agg(F.max(F.sqrt(dot(F.col("p"), F.col("p")))).alias("_r"))
    return p.join(F.broadcast(radius)).select("id", "p", F.transform("p", lambda x: x / F.col("_r")).alias("u"))


def stratified(rows: DataFrame, group: str, id_col: str, total: int) -> DataFrame:
    """A sample of about `total` rows, proportional by group and at least one of each, in hash order."""
    n = F.count(F.lit(1))
    sizes = rows.groupBy(group).agg(n.alias("_g"))
    whole = rows.agg(n.alias("_all"))
    sizes = sizes.join(F.broadcast(whole)).select(group, F.greatest(F.lit(1), F.round(total * F.col("_g") / F.col("_all"))).alias("_take"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.md5(F.col(id_col).cast("string")), id_col))
    return rows.join(sizes, group).withColumn("_n", rank).where("_n <= _take").drop("_n", "_take")


def als(matrix: DataFrame, rank: int = 16, rounds: int = 8, seed: int = 42):
    """Implicit-feedback matrix factorisation (ALS) of (user_id, item_id, w)."""
    from pyspark.ml.recommendation import ALS

    data = matrix.select(F.col("user_id").cast("int").alias("user_id"), F.col("item_id").cast("int").alias("item_id"), F.col("w").cast("float").alias("w"))
    return ALS(userCol="user_id", itemCol="item_id", ratingCol="w", implicitPrefs=True, rank=rank, maxIter=rounds, seed=seed, coldStartStrategy="drop").fit(data)


def als_topk(model, k: int) -> DataFrame:
    """(user_id, item_id, score, rank) for all users."""
    recs = model.recommendForAllUsers(k).select("user_id", F.posexplode("recommendations").alias("i", "r"))
    return recs.select(F.col("user_id").cast("long").alias("user_id"), F.col("r.item_id").alias("item_id"), F.col("r.rating").cast("double").alias("score"), (F.col("i") + 1).alias("rank"))


def negatives(positives: DataFrame, items: DataFrame, per: int, seed: int = 42) -> DataFrame:
    """(user_id, item_id, negative): `per` uniform draws from MD5 for each positive, known pairs rejected.

    items: (item_id, index) with dense indices from 0.
    """
    n = items.agg(F.count(F.lit(1)).alias("_n"))
    draws = positives.select("user_id", "item_id").join(F.broadcast(n)).withColumn("_d", F.explode(F.sequence(F.lit(1), F.lit(per))))
    draws = draws.withColumn("index", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "user_id", "item_id", "_d")), 1, 15), 16, 10).cast("long") % F.col("_n"))
    drawn = draws.join(items.select(F.col("item_id").alias("negative"), "index"), "index").select("user_id", "item_id", "negative")
    return drawn.join(positives.select("user_id", F.col("item_id").alias("negative")), ["user_id", "negative"], "left_anti").select("user_id", "item_id", "negative")


def log_sampling(counts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(item_id, logq): log of (count + 1) over the catalogue's sum of it; counts: (item_id, n)."""
    rows = catalogue.select("item_id").distinct().join(counts, "item_id", "left").fillna(0, ["n"])
    total = rows.agg(F.sum(F.col("n") + 1).alias("_t"))
    return rows.join(F.broadcast(total)).select("item_id", F.log((F.col("n") + 1) / F.col("_t")).alias("logq"))


def softmax_loss(logits: Column, target: Column) -> Column:
    """Cross entropy of one row of logits."""
    top = F.array_max(logits)
    return F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))) + top - F.element_at(logits, target)


def vector_text(embedding: Column) -> Column:
    """A vector as base64 of little-endian 32-bit floats, without line breaks; null for null."""

    @F.arrow_udf("binary")
    def pack(vectors: pa.Array) -> pa.Array:
        return pa.array([v.values.to_numpy(zero_copy_only=False).astype("<f4").tobytes() if v.is_valid else None for v in vectors], pa.binary())

    return F.regexp_replace(F.base64(pack(embedding)), r"\s", "")


def text_vector(data: Column) -> Column:
    """The vector that vector_text() made a text of; null for null, an error for what is no such text."""

    @F.arrow_udf("array<float>")
    def unpack(texts: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(t.as_py(), "<f4") if t.is_valid else None for t in texts], pa.list_(pa.float32()))

    return unpack(F.unbase64(data))
