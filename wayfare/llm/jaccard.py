"""Near copies by the Jaccard similarity of word shingles: op4's fingerprints and MinHash bands propose, whole sets decide.

SimHash at 4 of 64 bits alone is too narrow for a similarity of 0.8: there texts differ in 9 to 10 bits.  So its Golay
keys propose what lies within 4 bits, and MinHash bands the rest: a pair at similarity s shares one of BANDS keys of
ROWS minima with probability 1 - (1 - s^ROWS)^BANDS, 0.9999 at 0.8 and more above.

In each bucket all texts are first compared with its least one.  Where that leaves several components, the bucket's
texts are compared in blocks inside tasks, by products of incidence matrices: only links of a spanning forest leave
a task, never pairs, and a large bucket is dealt over block pairs.

Sets hold 32 bits of each shingle's hash: of 1,000 shingles two fall together once in 10^4 texts, of 100,000 about one
pair, which moves a similarity by 10^-5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import BROADCAST_KEYS, chosen_rows, keyed, staged, unstaged
from .simhash import SEED, components, majority, shingle_hashes, split_words

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 24, 5
#: Shingles that are permuted at once; columns of an incidence matrix; texts and shingles in a block.
CHUNK, COLUMNS, BLOCK, BLOCK_SHINGLES = 4096, 4096, 1024, 4_000_000
_random = np.random.default_rng(SEED)
FACTORS, MIX = (_random.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (BANDS * ROWS, BANDS * ROWS))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band; a text without shingles has none."""
    if not len(hashes):
        return hashes
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), CHUNK):
        np.minimum(least, (FACTORS[:, None] * hashes[None, i : i + CHUNK]).min(1), out=least)
    keys = ((least ^ least >> np.uint64(31)) * MIX).reshape(BANDS, ROWS).sum(1, dtype=np.uint64)
    return keys ^ keys >> np.uint64(29)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """docs' other columns with (text_hash, fp, keys, hashes): digest of the words, fingerprint, band keys, shingle set as bytes."""
    kept = docs.drop("text")
    names = kept.columns

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                whole, prints, keys, sets = [], [], [], []
                for text in part.column(len(names)):
                    words = split_words(text.as_py())
                    every = shingle_hashes(words, size)
                    distinct = np.unique(every)
                    whole.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
                    prints.append(majority(every))
                    keys.append(band_keys(distinct).view(np.int64))
                    sets.append(np.unique(distinct.astype(np.uint32)).tobytes())
                longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (whole, prints)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *longs, pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.binary())], [*names, "text_hash", "fp", "keys", "hashes"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return docs.select(*names, "text").mapInArrow(run, f"{schema}, text_hash long, fp long, keys array<long>, hashes binary")


def verified(pairs: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """The distinct (u, v) of pairs whose shingle sets reach the similarity; sets: (text_hash, hashes), one row each."""

    def run(batches):
        for batch in batches:
            a, b = ([np.frombuffer(x.as_py(), np.uint32) for x in batch.column(i)] for i in (2, 3))
            ok = pa.array([similarity(x, y) >= least for x, y in zip(a, b, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["u", "v"])

    side = lambda to, name: sets.select(F.col("text_hash").alias(to), F.col("hashes").alias(name))
    # Sets that are too unlike in size cannot reach the similarity.
    size = [F.octet_length("a"), F.octet_length("b")]
    both = pairs.distinct().join(side("v", "b"), "v").join(side("u", "a"), "u").where(F.least(*size) >= least * F.greatest(*size) - 1)
    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def shared_elements(sets: list[np.ndarray], rows: int) -> np.ndarray:
    """How many elements each of the first `rows` sets has in common with each of the others (or of all, where those are all)."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, element, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    more = times[element] > 1
    owner, element = owner[more], (np.cumsum(times > 1) - 1)[element[more]]
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    out = np.zeros((rows, len(sets) - rows or rows), np.float32)
    for first in range(0, int(element[-1]) + 1 if len(element) else 0, COLUMNS):
        part = slice(*np.searchsorted(element, [first, first + COLUMNS]))
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[owner[part], element[part] - first] = 1
        out += x[:rows] @ (x[rows:] if rows < len(sets) else x).T
    return out


def forest(us: np.ndarray, vs: np.ndarray, roots: dict[int, int]) -> list[int]:
    """Places of links that join what roots still holds apart."""
    up: dict[int, int] = {}

    def top(x):
        while x in up:
            up[x] = x = up.get(up[x], up[x])
        return x

    out = []
    for i, (u, v) in enumerate(zip(us.tolist(), vs.tolist(), strict=True)):
        a, b = top(roots[u]), top(roots[v])
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append(i)
    return out


def links_in_blocks(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """(u, v): links of forests that join the components of each bucket; rows: (key, blocks, text_hash, root, hashes)."""
    rows = rows.withColumn("i", F.pmod(F.xxhash64("text_hash"), "blocks")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), (F.col("i") <= F.col("j")).alias("first"), "text_hash", "root", "hashes")

    def run(got: pa.Table) -> pa.Table:
        first = got.column("first").to_numpy()
        order = np.argsort(~first, kind="stable")
        n = int(first.sum())
        ids, root = (got.column(c).to_numpy()[order] for c in ("text_hash", "root"))
        u = v = np.zeros(0, np.int64)
        if n == len(ids) and got.column("lo")[0].as_py() == got.column("hi")[0].as_py() or 0 < n < len(ids):
            sets = got.column("hashes").take(pa.array(order)).to_pylist()
            sets = [np.frombuffer(x, np.uint32) for x in sets]
            size = np.array([len(x) for x in sets], np.float64)
            both = shared_elements(sets, n)
            other = slice(n if n < len(ids) else 0, None)
            near = (both >= least * (size[:n, None] + size[None, other] - both)) & (root[:n, None] != root[None, other])
            x, y = np.nonzero(near)
            u, v = ids[:n][x], ids[other][y]
            ends = forest(u, v, dict(zip(ids.tolist(), root.tolist(), strict=True)))
            u, v = u[ends], v[ends]
        return pa.table([pa.array(u), pa.array(v)], ["u", "v"])

    return rows.groupBy("key", "lo", "hi").applyInArrow(run, "u long, v long")


def near_texts(prints: DataFrame, least: float = LEAST) -> DataFrame:
    """(text_hash, root): the texts that have near copies, and one name for each group; prints: what sketches() gives."""
    own = staged(prints.groupBy("text_hash").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys")), "distinct-texts")
    # Within 4 bits:
    linked = simhash.candidate_links(own.select("fp", F.col("text_hash").alias("node")))
    # Beyond: texts that share a band.
    buckets = own.select("text_hash", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("text_hash").alias("u")).where("n > 1")
    buckets = staged(buckets.join(shared, "key"), "buckets")
    stars = buckets.where("text_hash > u").select("u", F.col("text_hash").alias("v"))
    proposed = staged(linked.unionByName(stars).distinct(), "proposed-pairs")

    members = staged(proposed.select(F.explode(F.array("u", "v")).alias("text_hash")).distinct(), "members")
    near = F.broadcast if members.count() <= BROADCAST_KEYS else lambda x: x  # so that only the sets of members are shuffled
    sets = prints.join(near(members), "text_hash", "left_semi").dropDuplicates(["text_hash"]).select("text_hash", "hashes", (F.octet_length("hashes") / 4).cast("long").alias("size"))
    sets = staged(sets, "shingle-sets")
    links = staged(verified(proposed, sets, least), "links")
    group = staged(components(links), "components")

    rooted = buckets.join(group, buckets["text_hash"] == group["node"], "left").select("key", "text_hash", F.coalesce("root", "text_hash").alias("root"))
    loose = rooted.groupBy("key").agg(F.min("root").alias("l"), F.max("root").alias("h")).where("l < h").select("key")
    open_rows = staged(rooted.join(loose, "key", "left_semi"), "loose-buckets")
    blocks = open_rows.join(sets.select("text_hash", "size"), "text_hash").groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_SHINGLES)).alias("blocks"))
    rest = staged(links_in_blocks(open_rows.join(blocks, "key").join(sets, "text_hash"), least), "links-in-blocks")
    out = staged(components(links.unionByName(rest)).select(F.col("node").alias("text_hash"), "root"), "near-texts")
    unstaged(own, buckets, proposed, members, sets, links, group, open_rows, rest)
    return out


def near_groups(docs: DataFrame, size: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(doc_id, component_id): component_id is the smallest doc_id reachable over pairs of at least that similarity.

    Texts without words, null ones included, are copies of each other; null doc_ids take no part; repeated rows and
    ids are kept; texts of any length are compared whole; an empty table gives no rows; other columns are not read,
    whatever their names.  Words are told apart by 64-bit digests of the whole text.
    """
    prints = staged(sketches(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), size), "sketches")
    group = near_texts(prints, least)
    rows = prints.select("doc_id", "text_hash").join(group, "text_hash", "left").select("doc_id", F.coalesce("root", "text_hash").alias("root"))
    first = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(first, "root").select("doc_id", "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """One row of docs for each group of near copies: the one with the smallest doc_id, then the smallest hash.

    Rows are known by hashes of all their columns, so different texts under one doc_id are decided each for itself.
    Rows without doc_id stay as they are; null, empty and blank texts are copies of each other; an empty table stays
    empty; texts of any length are compared whole.  Other columns are kept, whatever their names.
    """
    rows = keyed(docs.where("doc_id IS NOT NULL"))
    prints = staged(sketches(rows.select("doc_id", "k1", "k2", "text"), size), "sketches")
    group = near_texts(prints, least)
    ranked = prints.select("doc_id", "k1", "k2", "text_hash").join(group, "text_hash", "left")
    ranked = staged(ranked.select("doc_id", "k1", "k2", F.coalesce("root", "text_hash").alias("root")), "grouped-rows")
    unstaged(prints, group)
    return chosen_rows(docs, ranked)
