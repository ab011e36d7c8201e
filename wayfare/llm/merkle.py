"""A Merkle manifest of a table: digests of rows, a tree for each group, a tree over the groups' roots, and proofs.

Rows become digests once; digests are sorted by ranges and numbered within their group.  Runs of 2^BITS consecutive
nodes of a group are aligned buckets, one Arrow row each.  Inside tasks DuckDB computes the levels of many buckets at
a time (ordered string_agg and sha256).  Spark takes the buckets' roots as the next round's nodes until each group has
one root, treats the groups' roots as nodes of a last tree, and then joins each bucket with the steps that lead from
its root to the top.  No task holds more than a chunk of buckets, whatever the size of a group.
"""

from __future__ import annotations

from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, quoted, staged, table, unstaged

#: A bucket holds 2^BITS nodes; tasks compute the levels of buckets of about CHUNK nodes together.
BITS, CHUNK = 12, 16_384
#: Up to this many buckets' outer steps (65 characters for each level above, so 3 KB at most) are broadcast.
BROADCAST_BUCKETS = 10_000
#: A step of a proof: the side of the sibling (L or R) and its digest, or dashes where a node has none.
STEP = 65
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value as it enters a digest: - for null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*values: Column) -> Column:
    """The lower-case hex sha256 of values as fields, one after the other."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def placed(leaves: DataFrame) -> DataFrame:
    """(g, pos, total, item): the rows of leaves (grp, id, leaf, claim) with the number of their group in order, their place in it by id, and its size.

    Rows are sorted by ranges; a task's rows of one group form a span, and spans (one for each task and group) are
    summed, so neither a large group nor many groups meet in one task.  Equal ids follow their digests.
    """
    order = ["grp", "id", "leaf", "tie"]
    tied = staged(leaves.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")
    ranged = tied.repartitionByRange(partitions(leaves.sparkSession), *order).sortWithinPartitions(*order)
    ranged = staged(ranged.withColumn("at", F.monotonically_increasing_id()).drop("tie"), "merkle-ranges")
    unstaged(tied)
    part = F.shiftright("at", 33)
    spans = ranged.groupBy(part.alias("part"), "grp").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    own, upto = Window.partitionBy("grp"), Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("total", F.sum("n").over(own))
    opens = F.when(F.col("before") == 0, 1).otherwise(0)
    earlier = spans.groupBy("part").agg(F.sum(opens).alias("o")).select("part", (F.sum("o").over(Window.orderBy("part")) - F.col("o")).alias("opened"))  # a row for each task
    spans = spans.join(earlier, "part").withColumn("g", F.col("opened") + F.sum(opens).over(Window.partitionBy("part").orderBy("first")) - 1)
    spans = spans.withColumn("g", F.max(F.when(F.col("before") == 0, F.col("g"))).over(own))
    spans = staged(spans.select("part", F.col("grp").alias("_grp"), "g", "first", "before", "total"), "merkle-spans")
    near = F.broadcast if spans.count() <= BROADCAST_BUCKETS else lambda x: x
    rows = ranged.withColumn("_part", part).join(near(spans), (F.col("_part") == F.col("part")) & F.col("grp").eqNullSafe(F.col("_grp")))
    return rows.select("g", (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "total", F.struct("id", "leaf", "claim").alias("item"))


class Levels:
    """The levels of a chunk of buckets as DuckDB tables n0, n1, ...: (bucket, i, depth, h), depth being the bucket's number of levels."""

    def __init__(self):
        import duckdb

        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": "", "autoinstall_known_extensions": False, "autoload_known_extensions": False})

    def build(self, bucket: np.ndarray, i: np.ndarray, depth: np.ndarray, leaf: pa.Array) -> int:
        """The number of levels above the leaves; leaf: digests as bytes."""
        self.con.register("chunk", pa.table({"row": np.arange(len(i)), "bucket": bucket, "i": i, "depth": depth, "leaf": leaf}))
        self.con.execute("CREATE OR REPLACE TEMP TABLE n0 AS SELECT bucket, i, depth, lower(hex(leaf)) AS h FROM chunk")
        most = int(depth.max(initial=0))
        for k in range(most):
            self.con.execute(f"CREATE OR REPLACE TEMP TABLE n{k + 1} AS SELECT bucket, i >> 1 AS i, depth, sha256(string_agg(h, '' ORDER BY i)) AS h FROM n{k} WHERE depth > {k} GROUP BY bucket, i >> 1, depth")
        return most

    def roots(self, most: int) -> pa.Array:
        """The buckets' roots in the buckets' order."""
        every = " UNION ALL ".join(f"SELECT bucket, h FROM n{k} WHERE depth = {k}" for k in range(most + 1))
        return self._arrow(f"SELECT h FROM ({every}) ORDER BY bucket").column(0).combine_chunks()

    def proofs(self, most: int, claim: pa.Array, outer: pa.Array) -> pa.Table:
        """(steps, folded) of all leaves in order: the steps up to the top, and what the claimed digest (or the leaf's, where null) folds to."""
        buckets = pa.table({"bucket": np.arange(len(outer)), "steps": outer.cast(pa.string())})
        self.con.register("outer_steps", buckets)
        self.con.register("claims", pa.table({"row": np.arange(len(claim)), "claim": claim}))
        self.con.execute("CREATE OR REPLACE TEMP TABLE p AS SELECT row, bucket, i, depth, coalesce(lower(hex(claim)), lower(hex(leaf))) AS f, '' AS s FROM chunk JOIN claims USING (row)")
        for k in range(most):
            side = f"CASE WHEN x.h IS NULL THEN '{'-' * STEP}' WHEN (p.i >> {k}) & 1 = 1 THEN 'L' || x.h ELSE 'R' || x.h END"
            self._fold(f"SELECT p.row, p.bucket, p.i, p.depth, p.f, p.s, CASE WHEN p.depth > {k} THEN {side} END AS step FROM p LEFT JOIN n{k} x ON x.bucket = p.bucket AND x.i = xor(p.i >> {k}, 1) AND x.depth > {k}")
        longest = max((len(x) for x in outer.to_pylist()), default=0)
        for k in range(0, longest, STEP):
            self._fold(f"SELECT p.*, nullif(substr(o.steps, {k + 1}, {STEP}), '') AS step FROM p JOIN outer_steps o USING (bucket)")
        return self._arrow("SELECT s AS steps, f AS folded FROM p ORDER BY row")

    def _fold(self, steps: str) -> None:
        """One step on for the rows that have one."""
        digest_ = "sha256(CASE step[1] WHEN 'L' THEN step[2:] || f WHEN 'R' THEN f || step[2:] ELSE f END)"
        self.con.execute(f"CREATE OR REPLACE TEMP TABLE p2 AS SELECT row, bucket, i, depth, CASE WHEN step IS NULL THEN f ELSE {digest_} END AS f, s || coalesce(step, '') AS s FROM ({steps})")
        self.con.execute("DROP TABLE p")
        self.con.execute("ALTER TABLE p2 RENAME TO p")

    def _arrow(self, sql: str) -> pa.Table:
        return self.con.sql(sql).to_arrow_table()


@cache
def levels() -> Levels:
    """One for each worker process."""
    return Levels()


def depths(total: np.ndarray, bits: int) -> np.ndarray:
    """Levels within a bucket of a group (or round) of so many nodes: up to one node, or to the bucket's root."""
    return np.array([min(bits, int(t - 1).bit_length()) for t in total], np.int64)


def blocks(nodes: DataFrame, bits: int) -> DataFrame:
    """(g, b, total, items, root): nodes (g, pos, total, item) in aligned buckets, with each bucket's root."""
    kind = nodes.schema["item"].dataType.simpleString()
    dealt = nodes.select("g", F.shiftright("pos", bits).alias("b"), "pos", "total", "item")
    dealt = dealt.repartition(partitions(nodes.sparkSession), "g", "b").sortWithinPartitions("g", "pos")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table):
            g, b, pos, total = (rows.column(c).to_numpy() for c in ("g", "b", "pos", "total"))
            starts = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (b[1:] != b[:-1])))
            items = rows.column("item").combine_chunks()
            depth = depths(total[starts], bits)
            sizes = np.diff(np.append(starts, len(g)))
            at = levels()
            most = at.build(np.repeat(np.arange(len(starts)), sizes), pos & (2**bits - 1), np.repeat(depth, sizes), items.field("leaf"))
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(g)), pa.int32()), items)
            return pa.RecordBatch.from_arrays([pa.array(g[starts]), pa.array(b[starts]), pa.array(total[starts]), lists, at.roots(most)], ["g", "b", "total", "items", "root"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= CHUNK:
                rows = pa.Table.from_batches(held)
                g, b = (rows.column(c).to_numpy() for c in ("g", "b"))
                last = int(np.flatnonzero((g != g[-1]) | (b != b[-1])).max(initial=-1)) + 1  # the last bucket may go on
                if last:
                    yield flush(rows.slice(0, last))
                    held = rows.slice(last).to_batches()
        if held and (rows := pa.Table.from_batches(held)).num_rows:
            yield flush(rows)

    return dealt.mapInArrow(run, f"g long, b long, total long, items array<{kind}>, root string")


def paths(buckets: DataFrame, outer: DataFrame, bits: int) -> DataFrame:
    """(g, pos, item, steps, folded, subroot) of each node of buckets; outer: (g, b, steps, subroot) of each bucket."""
    kind = buckets.schema["items"].dataType.elementType.simpleString()
    near = F.broadcast if outer.count() <= BROADCAST_BUCKETS else lambda x: x
    both = buckets.drop("root").join(near(outer), ["g", "b"]).select("g", "b", "total", "items", "steps", "subroot")
    few = max(1, CHUNK >> bits)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, few):
                part = batch.slice(k, few)
                g, b, total = (part.column(c).to_numpy() for c in range(3))
                lists = part.column(3)
                items, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
                number = np.repeat(np.arange(part.num_rows), sizes)
                i = np.arange(len(items)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                at = levels()
                most = at.build(number, i, np.repeat(depths(total, bits), sizes), items.field("leaf"))
                found = at.proofs(most, items.field("claim"), part.column(4))
                columns = [pa.array(g[number]), pa.array((b[number] << bits) + i), items, *[c.combine_chunks() for c in found.columns], part.column(5).take(pa.array(number))]
                yield pa.RecordBatch.from_arrays(columns, ["g", "pos", "item", "steps", "folded", "subroot"])

    return both.mapInArrow(run, f"g long, pos long, item {kind}, steps string, folded string, subroot string")


def rounds(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """The written buckets of each round; a group's tree ends in the round in which one bucket holds all its nodes."""
    kind = nodes.schema["item"].dataType.simpleString()
    found = [staged(blocks(nodes, bits), "merkle-buckets")]
    while not (more := found[-1].where(F.col("total") > 2**bits)).isEmpty():
        item = F.struct(F.lit(None).alias("id"), F.unhex("root").alias("leaf"), F.lit(None).alias("claim")).cast(kind)
        up = more.select("g", F.col("b").alias("pos"), F.shiftright(F.col("total") + (2**bits - 1), bits).alias("total"), item.alias("item"))
        found.append(staged(blocks(up, bits), "merkle-buckets"))
    return found


def tops(found: list[DataFrame], bits: int) -> DataFrame:
    """(g, round, root) of each group."""
    return reduce(DataFrame.unionByName, [x.where(F.col("total") <= 2**bits).select("g", F.lit(k).alias("round"), "root") for k, x in enumerate(found)])


def descend(found: list[DataFrame], top: DataFrame, bits: int) -> DataFrame:
    """paths() of the first round's nodes; top: (g, round, steps, subroot) of the groups' roots."""
    below = None
    for k in reversed(range(len(found))):
        outer = top.where(F.col("round") == k).select("g", F.lit(0).cast("long").alias("b"), "steps", "subroot")
        if below is not None:
            outer = outer.unionByName(below.select("g", F.col("pos").alias("b"), "steps", "subroot"))
        below = paths(found[k], staged(outer, "merkle-outer"), bits)
    return below


def manifest(leaves: DataFrame, bits: int = BITS) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded_root, verified) of each row of leaves (grp, id, leaf, claim).

    leaf and claim are hex digests.  Leaves of a group ascend by id, nulls first, equal ids by digest; while a level
    has several nodes, every two consecutive ones become the sha256 of their digests, and a last single one that of its
    own.  Groups' roots, ordered by group (null first), form the last tree.  proof holds the siblings' digests from
    the leaf up to the root; folded_root is what claim (where null, leaf) and those siblings give; verified says
    whether that is the root.  Repeated rows are leaves each; a single leaf is its own root, with an empty proof; an empty
    table gives no rows.
    """
    spark = leaves.sparkSession
    rows = leaves.select("grp", "id", F.unhex("leaf").alias("leaf"), F.unhex("claim").alias("claim"))
    inner = rounds(placed(rows), bits)
    groups = staged(tops(inner, bits), "merkle-subroots")
    n = groups.count()
    kind = inner[0].schema["items"].dataType.elementType.simpleString()
    item = F.struct(F.lit(None).alias("id"), F.unhex("root").alias("leaf"), F.lit(None).alias("claim")).cast(kind)
    over = rounds(groups.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.lit(n).cast("long").alias("total"), item.alias("item")), bits)
    root = next((r.root for r in tops(over, bits).collect()), None)  # one row
    top = spark.createDataFrame([(0, len(over) - 1, "", None)], "g long, round int, steps string, subroot string")
    above = staged(descend(over, top, bits).select(F.col("pos").alias("g"), "steps"), "merkle-above")
    top = groups.join(above, "g").select("g", "round", "steps", F.col("root").alias("subroot"))
    found = descend(inner, top, bits)
    proof = F.regexp_replace("steps", f"[LR]|-{{{STEP}}}", "")
    out = found.select("item.id", F.lower(F.hex("item.leaf")).alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), proof.alias("proof"), F.col("folded").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def leaf_rows(docs: DataFrame, changed: Column, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", counter: str = "n_chars") -> DataFrame:
    """(grp, id, leaf, claim) of docs: claim is the digest with one added to counter, where changed; a null counter stays null.

    Nulls enter digests as -, empty texts as 0:, texts of any length whole; columns that are not fields are not read,
    whatever their names.
    """
    col = lambda c: F.col(quoted(c))
    more = [(col(c).cast("decimal(20,0)") + 1).cast("decimal(21,0)") if c == counter else col(c) for c in fields]
    return docs.select(col(group).alias("grp"), col(order).alias("id"), digest(*[col(c) for c in fields]).alias("leaf"), F.when(changed, digest(*more)).alias("claim"))


def op11_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = manifest(leaf_rows(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


OP11_SQL = r"""
WITH RECURSIVE c AS (SELECT doc_id, lang, n_chars,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::varchar) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS a,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS z,
    xor(list_reduce(list_prepend(4294967295::bigint, [ascii(x)::bigint FOR x IN string_split(doc_id::varchar, '')]),
        lambda s, x: list_reduce(list_prepend(xor(s, x), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda t, y: xor(t >> 1, 3988292384::bigint * (t & 1)))), 4294967295::bigint) % 7 = 0 AS changed FROM documents),
l AS (SELECT doc_id, lang, sha256(a || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::varchar) || ':' || n_chars END || z) AS leaf,
    CASE WHEN changed THEN sha256(a || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1) END || z) END AS claim FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM l),
t AS (SELECT g, 0 AS k, pos AS i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM p
      UNION ALL SELECT g, k + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY g, k, i // 2),
s AS (SELECT g, h AS subroot, k AS deep FROM t WHERE n = 1),
u AS (SELECT 0 AS k, g AS i, subroot AS h, (SELECT count(*) FROM s) AS n FROM s
      UNION ALL SELECT k + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM u WHERE n > 1 GROUP BY k, i // 2),
r AS (SELECT h AS root FROM u WHERE n = 1),
f AS (SELECT doc_id, leaf, g, pos AS i, 0 AS k, false AS up, coalesce(claim, leaf) AS h, '' AS proof, pos, false AS done FROM p
      UNION ALL
      SELECT f.doc_id, f.leaf, f.g, CASE WHEN NOT f.up AND f.k = s.deep THEN f.g ELSE f.i // 2 END, CASE WHEN NOT f.up AND f.k = s.deep THEN 0 ELSE f.k + 1 END, f.up OR f.k = s.deep,
        CASE WHEN NOT f.up AND f.k = s.deep THEN f.h ELSE sha256(CASE WHEN f.i % 2 = 1 THEN coalesce(x.h, y.h, '') || f.h ELSE f.h || coalesce(x.h, y.h, '') END) END,
        f.proof || CASE WHEN NOT f.up AND f.k = s.deep THEN '' ELSE coalesce(x.h, y.h, '') END, f.pos, f.up AND f.k + 1 >= (SELECT max(k) FROM u)
      FROM f JOIN s USING (g) LEFT JOIN t x ON NOT f.up AND x.g = f.g AND x.k = f.k AND x.i = xor(f.i, 1) AND f.k < s.deep LEFT JOIN u y ON f.up AND y.k = f.k AND y.i = xor(f.i, 1)
      WHERE NOT (f.up AND f.k >= (SELECT max(k) FROM u)))
SELECT f.doc_id, f.leaf, s.subroot, r.root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = r.root AS verified
FROM f JOIN s USING (g) CROSS JOIN r WHERE f.up AND f.k = (SELECT max(k) FROM u)
"""
