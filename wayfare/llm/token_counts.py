"""Exact token counts for every context limit from one histogram of encoded lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table
from .encode import VOCABULARY, encoder

#: Lengths are summed in spans of this many, so that no task walks over all lengths.
SPAN = 1024


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY, added: bool = False) -> DataFrame:
    """(length, docs): documents by encoded length; null texts count as empty, with length 0.

    Repeated rows count each; texts of any length are encoded whole; an empty table gives no rows; other columns are
    not read, whatever their names.

    It is written once: what follows reads it several times, and texts are encoded once.
    """

    def run(batches):
        ids = encoder(vocabulary, added).ids
        for batch in batches:
            lengths = np.array([len(ids(x.as_py() or "")) // 4 for x in batch.column(0)], np.int64)
            length, n = np.unique(lengths, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(n)], ["length", "docs"])

    counts = docs.select("text").mapInArrow(run, "length long, docs long").groupBy("length").agg(F.sum("docs").alias("docs"))
    return staged(counts, "length-histogram")


def suffix_table(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs: docs; docs_from and tokens_from (at least L long); total over all documents;
    truncated (all tokens if documents end at L tokens); share (of documents that are at most L long).

    Sums run within spans of SPAN lengths, and over the spans' totals; an empty histogram gives no rows.
    """
    h = histogram.withColumn("span", F.floor(F.col("length") / SPAN)).withColumn("tokens", F.col("length") * F.col("docs"))
    spans = h.groupBy("span").agg(F.sum("docs").alias("sd"), F.sum("tokens").alias("st"))
    after = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each SPAN lengths
    whole = Window.partitionBy(F.lit(1))
    spans = spans.select("span", F.coalesce(F.sum("sd").over(after), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("st").over(after), F.lit(0)).alias("tokens_after"), F.sum("sd").over(whole).alias("all_docs"), F.sum("st").over(whole).alias("total"))
    down = Window.partitionBy("span").orderBy(F.desc("length"))
    h = h.join(spans, "span").withColumn("docs_from", F.col("docs_after") + F.sum("docs").over(down)).withColumn("tokens_from", F.col("tokens_after") + F.sum("tokens").over(down))
    truncated = F.col("total") - F.col("tokens_from") + F.col("length") * F.col("docs_from")
    share = 1 - (F.col("docs_from") - F.col("docs")) / F.col("all_docs")
    return h.select("length", "docs", "docs_from", "tokens_from", "total", truncated.alias("truncated"), share.alias("share"))


def at_limits(suffixes: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit, truncated): all tokens if documents end at `limit` tokens, for any limits, whether a length or not.

    What counts for a limit is the least length that reaches it: looked up in the limit's own span, or else at the
    beginning of the next span that has lengths; spans are few (a row for each SPAN lengths).
    """
    h = suffixes.select(F.floor(F.col("length") / SPAN).alias("span"), F.struct("length", "docs_from", "tokens_from").alias("x"), "total")
    spans = h.groupBy("span").agg(F.array_sort(F.collect_list("x")).alias("rows"), F.max("total").alias("all"))  # SPAN entries at most
    asked = limits.select("limit", F.floor(F.col("limit") / SPAN).alias("span"))
    every = spans.withColumn("there", F.lit(True)).unionByName(asked.select("span").distinct().join(spans, "span", "left_anti"), allowMissingColumns=True)
    after = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    every = every.select("span", "rows", F.last(F.get("rows", F.lit(0)), ignorenulls=True).over(after).alias("next"), F.max("all").over(Window.partitionBy(F.lit(1))).alias("all"))
    at = asked.join(every, "span").withColumn("x", F.coalesce(F.get(F.filter("rows", lambda r: r["length"] >= F.col("limit")), F.lit(0)), "next"))
    cut = F.when(F.col("x").isNull(), F.col("all")).otherwise(F.col("all") - F.col("x.tokens_from") + F.col("limit") * F.col("x.docs_from"))
    return at.select("limit", F.coalesce(cut, F.lit(0)).cast("long").alias("truncated"))


def quantiles(suffixes: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that at least that share of all documents does not exceed; null for an empty histogram."""
    one = suffixes.agg(*[F.min(F.when(F.col("share") >= q, F.col("length"))).alias(f"q{i}") for i, q in enumerate(shares)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("length")) for i, q in enumerate(shares)])))


def op6_token_counts(spark, sf_dir):
    return suffix_table(length_histogram(table(spark, sf_dir, "documents"), added=True))
