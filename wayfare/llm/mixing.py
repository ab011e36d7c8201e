"""Mixing sources to target weights.

Every row gets a hash-random key.  Within a source rows are taken in key order, whole epochs first, and the
last epoch is cut at the exact word where the source's budget ends.  The cut is found with distributed prefix
sums: key ranges are summed per source, the range that crosses the budget is found from those sums, and only
that range is sorted.  Rows then decide for themselves by comparing their key with their source's cut, so no
text is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_prefix, own_columns, quoted, staged, table, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
ADDED = ("size", "source_size", "target", "taken")
#: Rows of the largest source that one key range holds on average, and the fewest ranges.
RANGE_ROWS, LEAST_RANGES = 50_000, 1024


def _key(df: DataFrame, seed: str):
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, rows, source_size, target): sources by code point, null last, weigh `weights` in turn.

    A target is min(max_epochs * size, level * weight); the level that spends share * total is read off the
    sources sorted by cap / weight, so "reshare until none is above" needs no loop.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    per = per.withColumn("r", F.col("cap") / F.col("weight"))
    order = Window.orderBy("r", F.col("source").isNull(), "source")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(1)))
    spent = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    per = per.withColumn("level", (F.lit(float(share)) * total - spent) / F.sum("weight").over(after))
    level = F.min(F.when(F.col("level") <= F.col("r"), F.struct("r", "level"))).over(Window.partitionBy(F.lit(1)))["level"]
    target = F.coalesce(F.least(F.col("cap"), level * F.col("weight")), F.col("cap"))
    return per.select("source", "rows", "source_size", F.round(target, 6).alias("target"))


def _mixed(docs: DataFrame, prefix: str, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """docs with size, source_size, target and taken, named with the prefix."""
    sizes = staged(docs.select("source", _key(docs, seed).alias("key"), word_count(F.col("text")).alias("size")), "mix-sizes")
    plan = staged(source_targets(sizes, weights, share, max_epochs), "mix-targets")
    largest = plan.agg(F.max("rows")).first()[0] or 0
    ranges = max(LEAST_RANGES, largest // RANGE_ROWS)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("rest", F.floor(F.col("target")) - F.col("epochs") * F.col("source_size"))
    at = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") * ranges / 2.0**32)
    sizes = sizes.withColumn("at", at)

    sums = sizes.groupBy("source", "at").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("at"))
    sums = sums.withColumn("upto", upto).withColumnRenamed("source", "s")
    crossing = sums.join(plan, F.col("s").eqNullSafe(F.col("source"))).where("upto > rest and upto - words <= rest")
    crossing = crossing.select("s", F.col("at").alias("a"), (F.col("upto") - F.col("words")).alias("base"), "rest")
    # One range of keys for each source is sorted.
    near = sizes.join(crossing, F.col("source").eqNullSafe(F.col("s")) & (F.col("at") == F.col("a")))
    near = near.groupBy("s", "key", "base", "rest").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("same"))
    near = near.withColumn("upto", F.col("base") + F.sum("words").over(Window.partitionBy("s").orderBy("key")))
    cut = near.where("upto > rest and upto - words <= rest")
    cut = cut.select("s", F.col("key").alias("cut"), ((F.col("rest") - F.col("upto") + F.col("words")) / F.col("same")).cast("long").alias("part"))
    plan = staged(plan.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "mix-plan")

    own = lambda c: F.col(prefix + c)
    plan = plan.select(*[F.col(c).alias(prefix + c) for c in plan.columns])
    rows = docs.withColumn(f"{prefix}key", _key(docs, seed)).withColumn(f"{prefix}size", word_count(F.col("text")))
    rows = rows.join(plan, rows["source"].eqNullSafe(plan[f"{prefix}source"]), "left")
    last = F.when(own("cut").isNull() | (own("key") > own("cut")), F.lit(0)).when(own("key") < own("cut"), own("size"))
    last = last.otherwise(F.least(own("part"), own("size")))
    rows = rows.withColumn(f"{prefix}taken", (own("epochs") * own("size") + last).cast("long"))
    return rows.select(*own_columns(docs), *[f"{prefix}{c}" for c in ADDED])


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """docs with size, source_size, target and taken (words of the row that the mix takes, repeats counted).

    Null and blank texts have size 0 and take 0; null sources form one source.  Rows that are equal in doc_id and
    text share a key; at the cut they share what is left evenly.  Texts of any length are counted whole.  An empty table gives an empty result.
    Columns of docs with the names of the added ones are replaced, others are kept whatever their names.
    """
    docs = docs.drop(*ADDED)
    prefix = free_prefix(docs)
    rows = _mixed(docs, prefix, weights, share, max_epochs, seed)
    return rows.select(*own_columns(docs), *[F.col(prefix + c).alias(c) for c in ADDED])


def repeat_whole(mixed: DataFrame, columns: list[str], prefix: str = "") -> DataFrame:
    """The mix as documents: a row appears as often as its words are taken, rounded to whole documents."""
    size, taken = F.col(f"{prefix}size"), F.col(f"{prefix}taken")
    times = F.when(size > 0, F.round(taken / size)).otherwise(0).cast("int")
    n = f"{free_prefix(mixed)}n"
    return mixed.withColumn(n, F.explode(F.array_repeat(F.lit(1), times))).select(*[quoted(c) for c in columns])


def repeat_mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, with docs' columns, whatever their names; blank texts go."""
    prefix = free_prefix(docs)
    return repeat_whole(_mixed(docs, prefix), docs.columns, prefix)


def op2_mix_sources(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, md5('mix|' || coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')) AS key,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size,
             [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::int]::double AS weight FROM d GROUP BY source),
r AS (SELECT *, 2.0::double * source_size AS cap, 2.0::double * source_size / weight AS r FROM s),
l AS (SELECT *, (1.5::double * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY r, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY r, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, round(coalesce(least(cap, weight * (SELECT arg_min(level, r) FROM l WHERE level <= r)), cap), 6) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
q AS (SELECT *, floor(target) - epochs * source_size AS rest FROM p),
k AS (SELECT source, key, sum(size) AS words, count(*) AS same FROM d GROUP BY source, key),
u AS (SELECT source, key, words, same, sum(words) OVER (PARTITION BY source ORDER BY key) AS upto FROM k),
c AS (SELECT u.source, u.key AS cut, floor((q.rest - u.upto + u.words) / u.same) AS part FROM u JOIN q ON u.source IS NOT DISTINCT FROM q.source
      WHERE u.upto > q.rest AND u.upto - u.words <= q.rest)
SELECT d.doc_id, d.size, q.source_size, q.target::double AS target,
       (q.epochs * d.size + CASE WHEN c.cut IS NULL OR d.key > c.cut THEN 0 WHEN d.key < c.cut THEN d.size ELSE least(c.part, d.size) END)::bigint AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""
