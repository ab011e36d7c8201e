"""Line dedup by site-relative frequency.

A line is boilerplate of its host when the share of the host's pages that hold it exceeds a ratio.  Pages are
distinct texts of a host, so that whole copies of one page do not turn its content into boilerplate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_prefix, own_columns, partitions, quoted, staged, table

RATIO = 0.05
MIN_PAGES = 3
#: Up to this many boilerplate lines of all hosts together (16 bytes each) are broadcast; beyond, hosts are dealt over LEAST_SALTS keys or more.
BROADCAST_LINES, LEAST_SALTS = 200_000, 64
TRIM = " \t\n\x0b\f\r"


def _trimmed(line):
    return F.btrim(line, F.lit(TRIM))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line): 128-bit hashes of the trimmed lines that are boilerplate of their host; pages: (host, text)."""
    page = F.xxhash64("text")
    hashes = F.array_distinct(F.transform(F.filter(F.split("text", "\n", -1), lambda x: _trimmed(x) != ""), lambda x: F.struct(F.xxhash64(_trimmed(x)).alias("a"), F.xxhash64(F.lit(1), _trimmed(x)).alias("b"))))
    each = pages.where(F.col("text").isNotNull()).select("host", page.alias("page"), F.explode_outer(hashes).alias("line"))
    each = each.distinct()  # copies of a page count once
    count = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    totals = pages.where(F.col("text").isNotNull()).select("host", page.alias("page")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    often = count.where((F.col("n") >= min_pages) & F.col("line").isNotNull())
    totals = totals.withColumnRenamed("host", "h")
    return often.join(totals, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > F.lit(ratio) * F.col("total")).select("host", "line")


def line_lists(lines: DataFrame) -> DataFrame:
    """(host, slots): each host's lines as an array of short arrays; a line is in the slot that its hash names."""
    sizes = lines.groupBy("host").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("host", "h")
    held = lines.join(sizes, F.col("host").eqNullSafe(F.col("h"))).withColumn("slot", F.pmod(F.col("line.a"), F.col("n")))
    every = sizes.select(F.col("h").alias("host"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("slot"), F.lit(None).cast(lines.schema["line"].dataType).alias("line"))
    slots = held.select("host", "slot", "line").unionByName(every).groupBy("host", "slot").agg(F.collect_list("line").alias("lines"))  # nulls are not collected
    lists = slots.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("slot", "lines"))).alias("all"))
    return lists.select("host", F.transform("all", lambda x: x["lines"]).alias("slots"))


def dedup_lines(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """docs with text without its host's boilerplate lines, n_lines and n_dropped.

    Blank lines are never boilerplate and stay.  Null texts stay null with 0 lines; null hosts form one host; a
    document whose lines are all boilerplate keeps an empty text.  Repeated rows count as one page and are
    treated alike.  Columns of docs with the names of the added ones are replaced, others are kept whatever their
    names.  Texts of any length are split whole.  An empty table gives no rows.  A host has at most (lines per page / ratio) boilerplate lines, which bounds the list that
    is joined to its pages.  All lists together are counted: few lines are broadcast, so no text is shuffled; many
    are joined by host and salt, so that the pages of a large host meet copies of its list in several tasks.
    """
    docs = docs.drop("n_lines", "n_dropped")
    p = free_prefix(docs)
    rows = _dedup(docs, p, host, ratio, min_pages, broadcast_lines)
    return rows.select(*own_columns(docs), F.col(f"{p}lines").alias("n_lines"), F.col(f"{p}dropped").alias("n_dropped"))


def without_lines(docs: DataFrame) -> DataFrame:
    """docs with the text that dedup_lines() leaves and, where lines went, its length as n_chars; other columns as they are."""
    p = free_prefix(docs)
    rows = _dedup(docs, p)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(f"{p}dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*own_columns(docs))


def _dedup(docs: DataFrame, p: str, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """docs with the text that is left, and lines and dropped, named with the prefix p."""
    lines = staged(boilerplate(docs.select(F.col(quoted(host)).alias("host"), "text"), ratio, min_pages), "boilerplate")
    lists = line_lists(lines).toDF(f"{p}host", f"{p}slots")
    same = docs[quoted(host)].eqNullSafe(lists[f"{p}host"])
    if lines.count() <= broadcast_lines:
        rows = docs.join(F.broadcast(lists), same, "left")
    else:
        salts = max(LEAST_SALTS, partitions(docs.sparkSession))
        lists = lists.withColumn(f"{p}to", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = docs.withColumn(f"{p}salt", F.pmod(F.xxhash64("text"), F.lit(salts)).cast("int"))
        rows = salted.join(lists, same & (F.col(f"{p}salt") == F.col(f"{p}to")), "left")
    split = F.split("text", "\n", -1)
    slots = F.col(f"{p}slots")

    trimmed = F.transform(split, lambda x: F.struct(x.alias("line"), _trimmed(x).alias("t")))
    hashed = F.transform(trimmed, lambda x: F.struct(x["line"].alias("line"), F.when(x["t"] != "", F.struct(F.xxhash64(x["t"]).alias("a"), F.xxhash64(F.lit(1), x["t"]).alias("b"))).alias("key")))
    own = lambda x: x["key"].isNull() | ~F.array_contains(F.get(slots, F.pmod(x["key"]["a"], F.size(slots)).cast("int")), x["key"])
    kept = F.when(slots.isNull(), split).otherwise(F.transform(F.filter(hashed, own), lambda x: x["line"]))
    rows = rows.withColumn(f"{p}kept", kept)
    n_lines, left = F.coalesce(F.size(split), F.lit(0)), F.coalesce(F.size(f"{p}kept"), F.lit(0))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long")
    left = F.when(F.col("text").isNull(), 0).otherwise(left).cast("long")
    text = F.when(F.col("text").isNotNull(), F.array_join(f"{p}kept", "\n"))
    return rows.select(*[text.alias(c) if c == "text" else F.col(quoted(c)) for c in docs.columns], n_lines.alias(f"{p}lines"), (n_lines - left).alias(f"{p}dropped"))


def op9_line_dedup(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "n_lines", "n_dropped")


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (SELECT rid, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text IS NOT NULL),
t AS (SELECT rid, source, text, pos, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM l),
f AS (SELECT source, x, count(DISTINCT text) AS n FROM t WHERE x <> '' GROUP BY source, x),
p AS (SELECT source, count(DISTINCT text) AS total FROM d GROUP BY source),
b AS (SELECT f.source, f.x FROM f JOIN p ON f.source IS NOT DISTINCT FROM p.source WHERE n >= 3 AND n > 0.05::double * total),
k AS (SELECT t.rid, count(*) AS n_lines, count(b.x) AS n_dropped, string_agg(t.line, chr(10) ORDER BY pos) FILTER (WHERE b.x IS NULL) AS kept
      FROM t LEFT JOIN b ON t.source IS NOT DISTINCT FROM b.source AND t.x = b.x GROUP BY t.rid)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.kept, '') END AS text,
       coalesce(k.n_lines, 0)::bigint AS n_lines, coalesce(k.n_dropped, 0)::bigint AS n_dropped
FROM d LEFT JOIN k USING (rid)
"""
