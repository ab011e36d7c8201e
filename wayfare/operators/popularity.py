"""Popularity: decayed, contextual, trending."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.expr import DAY, hour_bucket, weight

HALF_LIFE_DAYS, TRUSTED_ROWS, TRENDING_DAYS = 30.0, 30, 7


def _aged(train: DataFrame) -> DataFrame:
    last = train.agg(F.max(F.unix_micros("ts")).alias("_last"))
    return train.join(F.broadcast(last)).withColumn("_age", (F.col("_last") - F.unix_micros("ts")) / DAY)


def decayed(train: DataFrame, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """(item_id, score): event weights, halved every half_life days before the last event."""
    w = weight(F.col("event_type"), 1.0) * F.pow(F.lit(0.5), F.col("_age") / half_life)
    return _aged(train).withColumn("_w", w).groupBy("item_id").agg(F.sum("_w").alias("score"))


def trending(train: DataFrame, days: int = TRENDING_DAYS) -> DataFrame:
    """(item_id, score): undecayed weights of the last days; the last event always counts, so the window is never empty."""
    return _aged(train).where(F.col("_age") <= days).withColumn("_w", weight(F.col("event_type"), 1.0)).groupBy("item_id").agg(F.sum("_w").alias("score"))


CELL = ("region_id", "vertical", "bucket")


def contextual(train: DataFrame, half_life: float = HALF_LIFE_DAYS, least: int = TRUSTED_ROWS) -> DataFrame:
    """(level, region_id, vertical, bucket, item_id, score, cell_rows): decayed popularity by context.

    Levels: 3 region, vertical and hour bucket; 2 region and vertical; 1 vertical; 0 all.  Cells with fewer than
    `least` rows are left out; level 0 always stays.  Both passes are grouping sets over the same expanded rows.
    """
    w = weight(F.col("event_type"), 1.0) * F.pow(F.lit(0.5), F.col("_age") / half_life)
    rows = _aged(train).withColumn("_w", w).withColumn("bucket", hour_bucket(F.hour("ts")))
    fine = rows.groupBy("region_id", "vertical", "bucket", "item_id").agg(F.sum("_w").alias("_w"), F.count(F.lit(1)).alias("_n"))
    at = [[*CELL[:n]] for n in (3, 2)] + [["vertical"], []]
    sets = fine.groupingSets([[*map(F.col, s), F.col("item_id")] for s in at], *map(F.col, CELL), F.col("item_id")).agg(F.sum("_w").alias("score"), F.sum("_n").alias("_n"), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 0, 3).when(F.col("_g") == 2, 2).when(F.col("_g") == 10, 1).otherwise(0)
    sets = sets.withColumn("level", level)
    cells = sets.groupBy("level", *CELL).agg(F.sum("_n").alias("cell_rows")).where((F.col("cell_rows") >= least) | (F.col("level") == 0))
    same = (F.col("s.level") == F.col("c.level"))
    for c in CELL:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}"))
    return sets.alias("s").join(cells.alias("c"), same).select("s.level", *[f"s.{c}" for c in CELL], "s.item_id", "s.score", "c.cell_rows")


def contextual_scores(model: DataFrame, contexts: DataFrame, items: DataFrame) -> DataFrame:
    """(context_id, item_id, level, score): each context's first trusted cell scores all items; an item that is missing
    from a trusted cell scores 0.  contexts: (context_id, region_id, vertical, bucket or null)."""
    cells = model.select("level", *CELL).distinct()
    hit = None
    for level, keys in ((3, CELL), (2, CELL[:2]), (1, ("vertical",)), (0, ())):
        own = cells.where(F.col("level") == level).select("level", *keys)
        one = contexts.join(own, list(keys)) if keys else contexts.join(F.broadcast(own.limit(1)))
        one = one.select("context_id", *CELL, "level")
        hit = one if hit is None else hit.unionByName(one)
    best = hit.groupBy("context_id").agg(F.max(F.struct("level", *CELL)).alias("b")).select("context_id", "b.*")
    m = model.alias("m")
    same = (F.col("m.level") == F.col("b.level"))
    for c, least in (("vertical", 1), ("region_id", 2), ("bucket", 3)):
        same = same & ((F.col("b.level") < least) | (F.col(f"m.{c}") == F.col(f"b.{c}")))
    scored = best.alias("b").join(m, same).select("context_id", "m.item_id", "score")
    every = best.select("context_id", "level").join(items.select("item_id").distinct())
    return every.join(scored, ["context_id", "item_id"], "left").select("context_id", "item_id", "level", F.coalesce("score", F.lit(0.0)).alias("score"))


def top_items(scores: DataFrame, k: int, group: list[str] | None = None) -> DataFrame:
    """The k best of each group (or of all), ties to the smaller item."""
    order = [F.desc("score"), F.asc("item_id")]
    if not group:
        return scores.orderBy(*order).limit(k)
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)
