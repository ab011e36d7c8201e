"""Preference formatting: one prompt for the longest common turn prefix, and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

OPEN, BREAK, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: Hash ranges in which members of a group are ranked, so that no task ranks a whole group.
RANGES = 256


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): turns in order, as (turn, role, text).

    Equal rows count once.  Rows without conv_id belong to no conversation and are left out; null roles read as
    "unknown", null texts as empty; turns with one number are ordered by role and text, null numbers come first.
    """
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("turns"))


def _render(turns: Column) -> Column:
    one = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(BREAK), t["text"], F.lit(CLOSE))
    return F.array_join(F.transform(turns, one), "")


def _mask(turns: Column) -> Column:
    """(start, end) code points of what assistant turns say, end mark included, in the rendered completion."""
    head = lambda t: F.length(t["role"]) + (len(OPEN) + len(BREAK))
    size = lambda t: head(t) + F.length(t["text"]) + len(CLOSE)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, t):
        span = F.struct((acc["at"] + head(t)).alias("start"), (acc["at"] + size(t)).alias("end"))
        return F.struct((acc["at"] + size(t)).alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def ranked(df: DataFrame, group: list[str], key: str) -> DataFrame:
    """df with rank (from 0) in its group by key, a hex digest: ranges are ranked apart and shifted by their offsets."""
    df = df.withColumn("_at", F.floor(F.conv(F.substring(key, 1, 4), 16, 10).cast("int") * RANGES / 65536))
    sums = df.groupBy(*group, "_at").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.sum("_n").over(Window.partitionBy(*group)).alias("group_size"))
    df = df.join(sums, [*group, "_at"])
    return df.withColumn("rank", F.col("_off") + F.row_number().over(Window.partitionBy(*group, "_at").orderBy(key)) - 1).drop("_at", "_n", "_off")


def pair_up(convs: DataFrame) -> DataFrame:
    """(pair, member conversations): neighbours among those that open with the same turn, then neighbours of the rest."""
    first = F.col("turns")[0]
    ids = convs.select("conv_id", F.md5(F.concat_ws("|", first["role"], first["text"])).alias("opening"), F.md5(F.col("conv_id").cast("string")).alias("key"))
    ids = ranked(ids, ["opening"], "key")
    odd = (F.col("rank") == F.col("group_size") - 1) & (F.col("group_size") % 2 == 1)
    rest = ranked(ids.where(odd).select("conv_id", "key", F.lit("").alias("opening")), ["opening"], "key")
    both = ids.where(~odd).unionByName(rest, allowMissingColumns=True)
    return both.select("conv_id", F.concat_ws("-", "opening", F.floor(F.col("rank") / 2).cast("string")).alias("pair"))


def preferences(turns: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, n_prefix, prompt, chosen, rejected, chosen_mask, rejected_mask), one row for each pair.

    Of a pair the conversation with more assistant text is chosen (ties: smaller conv_id).  With an odd number of
    conversations one is left: its rejected columns are null and it has no prefix.  Equal conversations give a
    prompt and two empty completions.  Every conversation is in exactly one row.  Texts of any length are rendered
    whole; an empty table gives no rows; other columns are not read, whatever their names.
    """
    convs = conversations(turns)
    said = F.aggregate(F.filter("turns", lambda t: t["role"] == "assistant"), F.lit(0).cast("long"), lambda a, t: a + F.length(t["text"]))
    members = convs.join(pair_up(convs), "conv_id").withColumn("m", F.struct((-said).alias("less"), "conv_id", "turns"))
    pairs = members.groupBy("pair").agg(F.min("m").alias("c"), F.max("m").alias("r"), F.count(F.lit(1)).alias("n"))
    c, r = F.col("c.turns"), F.when(F.col("n") == 2, F.col("r.turns"))
    same = lambda x, y: x.isNotNull() & y.isNotNull() & (x["role"] == y["role"]) & (x["text"] == y["text"])
    miss = F.array_position(F.zip_with(c, r, same), F.lit(False))
    prefix = F.when(r.isNull(), 0).when(miss > 0, miss - 1).otherwise(F.size(c)).cast("int")
    pairs = pairs.select("c", "r", "n", prefix.alias("n_prefix"))
    tail = lambda x: F.slice(x, F.col("n_prefix") + 1, F.greatest(F.size(x) - F.col("n_prefix"), F.lit(0)))
    ct, rt = tail(F.col("c.turns")), F.when(F.col("n") == 2, tail(F.col("r.turns")))
    return pairs.select(
        F.col("c.conv_id").alias("chosen_id"), F.when(F.col("n") == 2, F.col("r.conv_id")).alias("rejected_id"), F.col("n_prefix").cast("long").alias("n_prefix"),
        _render(F.slice(F.col("c.turns"), F.lit(1), F.col("n_prefix"))).alias("prompt"), _render(ct).alias("chosen"), _render(rt).alias("rejected"),
        _mask(ct).alias("chosen_mask"), _mask(rt).alias("rejected_mask"),
    )


def op3_preference_format(spark, sf_dir):
    out = preferences(table(spark, sf_dir, "conversations"))
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias(c)
    return out.select("chosen_id", "rejected_id", "n_prefix", "prompt", "chosen", "rejected", flat("chosen_mask"), flat("rejected_mask"))


OP3_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
c AS (SELECT conv_id, md5(max(CASE WHEN i = 1 THEN role || '|' || text END)) AS opening, md5(conv_id::varchar) AS key,
             sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS said, count(*) AS turns FROM n GROUP BY conv_id),
g AS (SELECT *, row_number() OVER (PARTITION BY opening ORDER BY key) - 1 AS rank, count(*) OVER (PARTITION BY opening) AS size FROM c),
o AS (SELECT *, row_number() OVER (ORDER BY key) - 1 AS rank2 FROM g WHERE rank = size - 1 AND size % 2 = 1),
p AS (SELECT conv_id, said, turns, opening || '-' || (rank // 2)::varchar AS pair FROM g WHERE NOT (rank = size - 1 AND size % 2 = 1)
      UNION ALL SELECT conv_id, said, turns, '-' || (rank2 // 2)::varchar FROM o),
m AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY said DESC, conv_id) AS place FROM p),
x AS (SELECT a.pair, a.conv_id AS c, b.conv_id AS r, a.turns AS cn, b.turns AS rn FROM m a LEFT JOIN m b ON a.pair = b.pair AND b.place = 2 WHERE a.place = 1),
d AS (SELECT x.c, min(a.i) AS miss FROM x JOIN n a ON a.conv_id = x.c LEFT JOIN n b ON b.conv_id = x.r AND b.i = a.i
      WHERE b.i IS NULL OR a.role <> b.role OR a.text <> b.text GROUP BY x.c),
y AS (SELECT x.*, CASE WHEN x.r IS NULL THEN 0 ELSE coalesce(d.miss - 1, x.cn) END AS n_prefix FROM x LEFT JOIN d USING (c)),
w AS (SELECT y.c AS c, n.conv_id, n.i, n.role, n.i <= y.n_prefix AS inside, '<|im_start|>' || n.role || chr(10) || n.text || '<|im_end|>' || chr(10) AS s
      FROM y JOIN n ON n.conv_id = y.c OR n.conv_id = y.r),
z AS (SELECT *, sum(length(s)) OVER (PARTITION BY c, conv_id, inside ORDER BY i) AS upto FROM w),
f AS (SELECT c, conv_id, coalesce(string_agg(s, '' ORDER BY i) FILTER (WHERE inside), '') AS prompt, coalesce(string_agg(s, '' ORDER BY i) FILTER (WHERE NOT inside), '') AS body,
             coalesce(string_agg((upto - length(s) + 12 + length(role) + 1)::bigint::varchar || ':' || upto::bigint::varchar, ',' ORDER BY i) FILTER (WHERE NOT inside AND role = 'assistant'), '') AS mask
      FROM z GROUP BY c, conv_id)
SELECT y.c AS chosen_id, y.r AS rejected_id, y.n_prefix::bigint AS n_prefix, a.prompt, a.body AS chosen, b.body AS rejected, a.mask AS chosen_mask, b.mask AS rejected_mask
FROM y JOIN f a ON a.c = y.c AND a.conv_id = y.c LEFT JOIN f b ON b.c = y.c AND b.conv_id = y.r
"""
