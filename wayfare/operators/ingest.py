"""Cleaning: dedup, k-core, caps, dense ids, property history, category roots, data-quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.distributed import row_numbers
from wayfare.functions.expr import DAY
from wayfare.sources.tables import checkpointed, counted

#: So many nodes that leave a core are broadcast at most.
SENT_NODES = 2_000_000


def dedup_seconds(events: DataFrame, tie: str = "event_id") -> DataFrame:
    """The first row (by ts, tie) of each user, item, type and second."""
    w = Window.partitionBy("user_id", "item_id", "event_type", F.date_trunc("second", "ts")).orderBy("ts", tie)
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def core_edges(events: DataFrame, min_user: int, min_item: int, rounds: int = 30) -> tuple[DataFrame, dict[str, tuple[DataFrame, int]]]:
    """((user_id, item_id, n) of the core, {column: (nodes outside it, how many)}); n counts an edge's rows.

    Edges are written once, and nodes' counts are taken from them once.  A round takes out the nodes that have fallen
    below their least count and subtracts only the edges that leave with them, so the rounds together move each edge
    once.  Nodes that leave are broadcast; beyond SENT_NODES of them the edges that are left are written anew.
    An empty core, or one that takes more rounds, raises.
    """
    least = {"user_id": min_user, "item_id": min_item}
    known = events.where("user_id IS NOT NULL AND item_id IS NOT NULL")
    edges, size = counted(known.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n")), "kcore")
    counts = {c: checkpointed(edges.groupBy(c).agg(F.sum("n").alias("c")), "kcore-counts") for c in least}
    out = {c: (counts[c].select(c).limit(0), 0) for c in least}
    waiting = dict.fromkeys(least, 0)  # of the nodes outside, those whose edges still lie in the table
    for _ in range(rounds):
        fallen = {c: counted(counts[c].where(F.col("c") < least[c]).select(c), "kcore-out") for c in least}
        if not any(n for _, n in fallen.values()):
            return (without(edges, out) if any(waiting.values()) else edges), out
        rest = without(edges, out) if any(waiting.values()) else edges
        marked = rest
        for c, (nodes, n) in fallen.items():
            marked = marked.join(sent(nodes.withColumn(f"_{c}", F.lit(True)), n), c, "left")
        leaves = F.col("_user_id").isNotNull() | F.col("_item_id").isNotNull()
        lost, n = counted(marked.where(leaves).select("user_id", "item_id", "n"), "kcore-lost")
        size -= n
        if not size:
            raise ValueError(f"the ({min_user}, {min_item})-core is empty")
        for c, (nodes, m) in fallen.items():
            less = lost.groupBy(c).agg(F.sum("n").alias("_less"))
            stay = counts[c].where(F.col("c") >= least[c]).join(less, c, "left")
            counts[c] = checkpointed(stay.select(c, (F.col("c") - F.coalesce("_less", F.lit(0))).alias("c")), "kcore-counts")
            out[c] = (checkpointed(out[c][0].unionByName(nodes), "kcore-out"), out[c][1] + m)
            waiting[c] += m
        if max(waiting.values()) > SENT_NODES:
            edges, waiting = checkpointed(marked.where(~leaves).select("user_id", "item_id", "n"), "kcore"), dict.fromkeys(least, 0)
    raise ValueError(f"no ({min_user}, {min_item})-core within {rounds} rounds")


def sent(nodes: DataFrame, n: int) -> DataFrame:
    """nodes, broadcast unless there are more than SENT_NODES."""
    return F.broadcast(nodes) if n <= SENT_NODES else nodes


def without(rows: DataFrame, out: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """The rows whose keys are known and not among the nodes left out."""
    for c, (nodes, n) in out.items():
        rows = rows.where(F.col(c).isNotNull())
        if n:
            rows = rows.join(sent(nodes, n), c, "left_anti")
    return rows


def k_core(events: DataFrame, min_user: int, min_item: int, rounds: int = 30) -> DataFrame:
    """Rows of users with min_user and items with min_item rows, both counted on the same rows, until nothing changes.

    A row is in the core if both its nodes are; see core_edges().
    """
    return without(events, core_edges(events, min_user, min_item, rounds)[1])


def cap_presets(events: DataFrame, users: int, items: int) -> DataFrame:
    """The most active users, then the most frequent items among their rows; cores are not taken again."""
    top = lambda df, c, n: df.groupBy(c).count().orderBy(F.desc("count"), c).limit(n).select(c)
    kept = events.join(top(events, "user_id", users), "user_id", "left_semi")
    return kept.join(top(kept, "item_id", items), "item_id", "left_semi")


def dense_ids(events: DataFrame, column: str) -> DataFrame:
    """(column, index): 0-based dense codes of the distinct values in their order."""
    ids = events.select(column).where(F.col(column).isNotNull()).distinct()
    return row_numbers(ids, [column], "_n").select(column, (F.col("_n") - 1).alias("index"))


def latest_value(changes: DataFrame, key: str, value: str, ts: str = "ts") -> DataFrame:
    """The value at the latest change of each key, parsed as a number; keys whose latest value is none are dropped."""
    last = changes.groupBy(key).agg(F.max(F.struct(ts, value))[value].alias("_v"))
    return last.select(key, F.expr("try_cast(_v AS INT)").alias("latest")).where("latest IS NOT NULL")


def availability(changes: DataFrame, key: str, flag: str, ts: str = "ts") -> DataFrame:
    """First time a key was available, and whether it is at its latest change; flags that don't parse count as 0."""
    parsed = F.coalesce(F.expr(f"try_cast({flag} AS INT)"), F.lit(0))
    return changes.withColumn("_f", parsed).groupBy(key).agg(F.min(F.when(F.col("_f") == 1, F.col(ts))).alias("first_available"), (F.max(F.struct(ts, "_f"))["_f"] == 1).alias("is_available"))


def category_roots(tree: DataFrame, depth: int = 32) -> DataFrame:
    """(category_id, root): parents followed to a node without one; a parent that is no category counts as root.

    Doubling: each round replaces a node's ancestor by its ancestor's ancestor, so log(depth) joins suffice.  Nodes on or
    below a cycle get the least category of the cycle.
    """
    at = tree.select("category_id", F.coalesce("parent_id", "category_id").alias("up"))
    hops = 1
    path = at.select("category_id", "up", F.least("category_id", "up").alias("low"))
    while hops < 2 * depth:
        above = path.select(F.col("category_id").alias("up"), F.col("up").alias("next"), F.col("low").alias("low2"))
        path = path.join(above, "up", "left").select("category_id", F.coalesce("next", "up").alias("up"), F.least("low", F.coalesce("low2", "low")).alias("low"))
        hops *= 2
    # On a cycle the ancestor has a proper parent among the categories still; its lowest member names the cycle.
    ends = at.where(F.col("up") != F.col("category_id")).select(F.col("category_id").alias("up")).distinct().withColumn("loops", F.lit(True))
    inside = path.join(ends, "up", "left")
    lows = path.select(F.col("category_id").alias("up"), F.col("low").alias("cycle"))
    return inside.join(lows, "up", "left").select("category_id", F.when(F.col("loops"), F.col("cycle")).otherwise(F.col("up")).alias("root"))


def rule_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) from one pass: rows where a rule is not true."""
    one = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    return one.unpivot([], list(rules), "rule", "violations")


def cold_flags(firsts: DataFrame, last_ts: DataFrame, days: int = 14) -> DataFrame:
    """is_cold: first seen within `days` of the last event; never seen is cold. last_ts: one row with column last."""
    cold = F.coalesce(F.unix_micros("first_interaction") >= F.unix_micros("last") - days * DAY, F.lit(True))
    return firsts.join(F.broadcast(last_ts)).withColumn("is_cold", cold).drop("last")


def stage_stats(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows, users and items of each stage, and the share of the first stage's rows."""
    out = None
    for nr, (name, df) in enumerate(stages.items()):
        one = df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("items")).select(F.lit(nr).alias("nr"), F.lit(name).alias("stage"), "*")
        out = one if out is None else out.unionByName(one)
    first = F.first("rows").over(Window.orderBy("nr"))
    return out.withColumn("retained", F.round(F.col("rows") / first, 6)).drop("nr")
