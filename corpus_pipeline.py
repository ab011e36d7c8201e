"""From raw documents to packed training sequences: STAGES in order, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfare.llm import jaccard, line_dedup, mixing, packing, quality
from wayfare.llm.common import staged, table, unstaged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, unchanged.

    Null, empty and blank texts have no words and go; very long texts are judged whole; repeated rows are judged alike;
    rows without doc_id are judged but never labelled.  An empty table stays empty; without labels the base rules judge
    alone.  Further columns are kept, whatever their names.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; n_chars follows the text.

    Null texts stay null, empty ones empty; null sources are one source; repeated rows and whole copies count as one
    page; a text of boilerplate alone becomes empty.  An empty table stays empty.  Further columns are kept, whatever
    their names, n_lines and n_dropped too.
    """
    return line_dedup.without_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

    Pairs come from op4's fingerprints and Golay keys, on five words, and from MinHash bands for what 4 bits can't reach.
    The smallest doc_id of a group stays, of repeated ids the row with the smallest hash; of equal rows one.  Null,
    empty and blank texts are copies of each other; rows without doc_id stay.  An empty table stays empty.  Further
    columns are kept, whatever their names.
    """
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, rounded to whole documents.

    Null, empty and blank texts have no words and go; null sources are one source; repeated rows are taken each for
    itself.  An empty table stays empty.  Further columns are kept, whatever their names.
    """
    return mixing.repeat_mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are an end id alone; long texts are cut; repeated rows are packed each for itself; null ids
    stay null.  An empty table gives no pieces.  Further columns are not read.
    """
    return packing.pack(docs, added=True)


STAGES = [("quality rules", quality_rules), ("line dedup", drop_lines), ("near dedup", near_dedup), ("mix sources", mix_sources), ("pack sequences", pack_sequences)]

#: The forest, the shingle sets and the token ids can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        before, docs = docs, staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if n:
            unstaged(before)  # a stage's table goes once the next one is written
    return docs
