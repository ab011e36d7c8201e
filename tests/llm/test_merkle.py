"""The manifest against trees computed in memory, buckets of every size, and the query's digests."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from wayfare.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """The levels, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def climb(levels, i, node, proof):
    for level in levels[:-1]:
        pair = level[i - i % 2 : i - i % 2 + 2]
        other = [x for j, x in enumerate(pair) if j != i % 2]
        node = h(*(other + [node] if i % 2 else [node] + other))
        proof += other
        i //= 2
    return node


def brute(rows):
    """Sorted tuples of id, leaf, subroot, root, proof, folded_root, verified; rows: (grp, id, leaf, claim)."""
    low = lambda x: (x is not None, x if x is not None else 0)
    groups = sorted({r[0] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: sorted((r for r in rows if r[0] == g), key=lambda r: (low(r[1]), r[2])) for g in groups}
    trees = {g: tree([r[2] for r in own[g]]) for g in groups}
    top = tree([trees[g][-1][0] for g in groups])
    out = []
    for n, g in enumerate(groups):
        for i, r in enumerate(own[g]):
            proof = []
            folded = climb(top, n, climb(trees[g], i, r[3] or r[2], proof), proof)
            out.append((r[1], r[2], trees[g][-1][0], top[-1][0], "".join(proof), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


KIND = "grp string, id long, leaf string, claim string"


@pytest.mark.parametrize("bits", [2, 12])
def test_equals_trees_in_memory(spark, bits):
    rows = [("hot", i, h("hot", str(i)), h("x") if i % 5 == 0 else None) for i in range(137)]
    rows += [(f"g{k}", i, h(str(k), str(i)), None) for k, n in enumerate((1, 2, 3, 4, 5, 8, 9)) for i in range(n)]
    rows += [(None, 3, h("n"), None), (None, None, h("m"), h("k")), ("é", 1, h("a"), None), ("é", 1, h("b"), None), ("é", 1, h("b"), None), ("", 7, h("c"), None), ("\U0001f600", 2, h("d"), h("d"))]
    got = merkle.manifest(spark.createDataFrame(rows, KIND).repartition(5), bits)
    assert got.columns == ["id", "leaf", "subroot", "root", "proof", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_one_group_one_row_and_none(spark):
    for rows in ([("a", 1, h("1"), None)], [("a", 1, h("1"), h("2"))], [("a", i, h(str(i)), None) for i in range(3)]):
        assert sorted((tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, KIND)).collect()), key=repr) == brute(rows)
    assert merkle.manifest(spark.createDataFrame([], KIND)).count() == 0


def test_chunks_of_buckets(spark, monkeypatch):
    """Buckets that span Arrow batches and chunks give the same rows."""
    rows = [("ab"[i % 2], i, h(str(i)), None) for i in range(700)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = merkle.manifest(spark.createDataFrame(rows, KIND), 4).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def test_query_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None, None, None, None), (7, "", "", "", 0), (7, "", "", "", 0), (8, "é\U0001f600 " * 50_000, "zz", None, None), (10**15, "x", "en", "s", 2**63 - 1), (-5, "y", "en", "s", -1)]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"))
    docs = docs.withColumn("grp", F.lit(1)).withColumn("a.b", F.lit("x")).withColumn("_k1", F.lit(2)).withColumn("leaf", F.lit("z"))
    rows = []
    for r in docs.collect():
        one = lambda n, r=r: h(*[value(x) for x in (r.doc_id, r.source, r.lang, n, r.text)])
        changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
        rows.append((r.lang, r.doc_id, one(r.n_chars), one(None if r.n_chars is None else r.n_chars + 1) if changed else None))
    assert any(r[3] for r in rows)
    got = merkle.manifest(merkle.leaf_rows(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_twin_counts_changed_rows():
    """The SQL's check sum is crc32."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT i AS doc_id, 't' AS text, 'en' AS lang, 's' AS source, i AS n_chars FROM range(60) t(i)")
    got = {r[0] for r in con.execute(merkle.OP11_SQL).fetchall() if not r[-1]}
    assert got == {i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 0}
