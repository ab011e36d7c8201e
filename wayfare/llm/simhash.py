"""SimHash near-dedup with Golay-code fuzzy hashing.

Documents get 64-bit fingerprints from their word shingles.  Two fingerprints link at 4 or fewer differing bits.
Candidates come from the perfect binary Golay code: a 23-bit word decodes to the codewords within 4 bits of it
(one or six), and two words that differ in at most 2 bits always share one of them.  A fingerprint is segments of 23,
23 and 18 bits.  By the pigeonhole principle a pair with at most 4 errors either differs by at most 2 in both long
segments, or by at most 1 in one long segment and the short one together.  So keys are (codewords of both long
segments), (codeword of a long segment, the short one) and (a long segment, either half of the short one): 43 on
average, and no linked pair is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chosen_rows, keyed, partitions, staged, table, unstaged

SHINGLE, BITS, SEED = 4, 4, 42
WIDTHS = (23, 23, 9, 9)
#: Groups of one key up to this size are compared pair by pair; larger ones are walked from fingerprint to fingerprint.
SMALL = 16
#: Key rows that one task reads, on average.
TASK_ROWS = 2_000_000
#: Keys of a fingerprint, on average.
KEYS = 43


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of `size` words, repeats included; fewer words are one run, no words none."""
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([digest(joined, SEED)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z alone are lowered, six characters alone are space


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    return majority(shingle_hashes(split_words(text), size))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """docs' other columns with fp, the 64 bits of the text's fingerprint as a signed long; null texts have no words."""
    kept = docs.drop("text")
    names = kept.columns

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in batch.column(len(names))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(fps)], [*names, "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return docs.select(*names, "text").mapInArrow(run, f"{schema}, fp long")


def golay_words() -> np.ndarray:
    """The 4096 codewords of the cyclic [23, 12, 7] code with generator x^11+x^9+x^7+x^6+x^5+x+1."""
    words = np.arange(4096, dtype=np.uint32) << 11
    rest = words.copy()
    for i in range(22, 10, -1):
        rest ^= np.where(rest >> i & 1, np.uint32(0b101011100011 << (i - 11)), np.uint32(0))
    return words | rest


def golay_table() -> np.ndarray:
    """For each syndrome the words of at most 4 bits that may be added to reach a codeword: one, or six (padded with the first)."""
    power = np.array([1 << i for i in range(23)], np.uint32)
    light = [np.zeros(1, np.uint32), power]
    for _ in range(3):
        more = np.unique((light[-1][:, None] | power[None, :])[(light[-1][:, None] & power[None, :]) == 0])
        light.append(more)
    errors = np.concatenate(light)
    by: dict[int, list[int]] = {}
    for s, e in zip(syndrome(errors).tolist(), errors.tolist(), strict=True):
        by.setdefault(s, []).append(e)
    out = np.zeros((2048, 6), np.uint32)
    for s, e in by.items():
        out[s] = (e + [e[0]] * 5)[:6]
    return out


def syndrome(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.uint32).copy()
    for i in range(22, 10, -1):
        rest ^= np.where(rest >> i & 1, np.uint32(0b101011100011 << (i - 11)), np.uint32(0))
    return rest & np.uint32(2047)


def fuzzy(words: np.ndarray, errors: np.ndarray) -> np.ndarray:
    """(n, 6): indices of the codewords within 4 bits of each word; where there is one, it stands six times."""
    return ((words[:, None] ^ errors[syndrome(words)]) >> np.uint32(11)).astype(np.uint64)


def keys(fps: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) of all distinct keys of each fingerprint."""
    shift, segments = 0, []
    for w in WIDTHS:
        segments.append((fps >> np.uint64(shift)) & np.uint64((1 << w) - 1))
        shift += w
    a, b, low, high = segments
    codes = [fuzzy(s.astype(np.uint32), errors) for s in (a, b)]
    several = [c[:, 1] != c[:, 0] for c in codes]
    short = low | high << np.uint64(9)
    places, found = [], []
    every = np.arange(len(fps))

    def add(tag, key, ok):
        places.append(every[ok])
        found.append(np.uint64(tag << 56) | key[ok])

    for i in range(6):
        one = [several[s] | (i == 0) for s in (0, 1)]
        for j in range(6):
            add(1, codes[0][:, i] << np.uint64(12) | codes[1][:, j], one[0] & (several[1] | (j == 0)))
        for s in (0, 1):
            add(2 + s, codes[s][:, i] << np.uint64(18) | short, one[s])
    for s, segment in enumerate((a, b)):
        for half, part in enumerate((low, high)):
            add(4 + 2 * s + half, segment << np.uint64(9) | part, np.ones(len(fps), bool))
    return np.concatenate(places), np.concatenate(found)


def _near(a: np.ndarray, b, bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= bits


def walk(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Places of the links of a forest that spans all links among fps: from each found fingerprint to the not yet found ones near it.

    A tight group is nearly all found from its first members, so this costs far less than all pairs.
    """
    edges = []
    left = np.arange(len(fps))
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            hit = _near(fps[left], fps[at], bits)
            new, left = left[hit], left[~hit]
            edges += [(int(at), int(x)) for x in new]
            todo += new.tolist()
    return edges


def links_of(key: np.ndarray, fp: np.ndarray, bits: int) -> np.ndarray:
    """(n, 2) places of links among fingerprints that share a key; they connect whatever all links connect."""
    order = np.lexsort((fp, key))
    k, f = key[order], fp[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    size = np.diff(np.append(first, len(k)))
    edges = []
    small = np.flatnonzero(np.repeat(size <= SMALL, size))
    for d in range(1, SMALL):
        if len(small) <= d:
            break
        a, b = small[:-d], small[d:]
        hit = np.flatnonzero((k[a] == k[b]) & _near(f[a], f[b], bits))
        edges.append(np.stack([a[hit], b[hit]], 1))
    for a, n in zip(first[size > SMALL], size[size > SMALL], strict=True):
        found = walk(f[a : a + n], bits)
        if found:
            edges.append(np.array(found) + a)
    return order[np.concatenate(edges)] if edges else np.zeros((0, 2), np.int64)


def candidate_links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(u, v): distinct edges, u < v as signed longs, whose components are those of all links.

    fps: distinct (fp), or (fp, node) where edges are to join nodes.
    """
    names = ["fp", *[c for c in fps.columns if c == "node"]]

    def expand(batches):
        errors = golay_table()
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(x), 1000):
                place, key = keys(x[i : i + 1000], errors)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *[c.slice(i, 1000).take(pa.array(place)) for c in batch.columns]], ["key", *names])

    def match(batches):
        got = [[c.to_numpy() for c in b.columns] for b in batches]
        if got:
            key, fp, *_ = cols = [np.concatenate(c) for c in zip(*got, strict=True)]
            e = cols[-1][links_of(key.view(np.uint64), fp.view(np.uint64), bits)]
            e = np.unique(np.sort(e, 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["u", "v"])

    n = fps.count()
    tasks = max(partitions(fps.sparkSession), n * KEYS // TASK_ROWS)
    spread = fps.select(*names).repartition(max(4, min(tasks, n // 2000)))  # expand small inputs in parallel
    rows = spread.mapInArrow(expand, ", ".join(f"{c} long" for c in ["key", *names])).repartition(tasks, "key")
    return rows.mapInArrow(match, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for all nodes that have an edge.

    Large stars and small stars in turn: each round hangs nodes under the least neighbour they know, until every edge
    leads from a node of one edge to a root.  Neighbourhoods are only ever reduced to their minimum, so a centre of
    many edges is no problem.
    """
    edges = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        joined = both.join(least, F.col("u") == F.col("x"))
        if large:
            out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
        return out.where("u > v").distinct()

    def done(e: DataFrame) -> bool:
        sides = e.select(F.col("u").alias("n"), F.lit(1).alias("child")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("child")))
        per = sides.groupBy("n").agg(F.sum("child").alias("c"), F.count(F.lit(1)).alias("all"))
        return per.where("c > 1 OR c > 0 AND all > c").isEmpty()

    while not done(edges):
        before, edges = edges, staged(star(star(edges, True), False), "stars")
        unstaged(before)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_prints(own: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, root): a name for the group of each fingerprint; own: distinct (fp, ...)."""
    group = staged(components(candidate_links(own.select("fp"), bits)), "components")
    return own.join(group, own["fp"] == group["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, size: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links, its own included.

    Texts without words have fingerprint 0 and link like any other; rows without doc_id link others but cannot
    name a component (null if none can); repeated rows and ids are kept.  Texts of any length are read whole.  An empty
    table gives no rows; other columns are not read, whatever their names.
    """
    prints = staged(fingerprints(docs.select("doc_id", "text"), size), "fingerprints")
    own = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = staged(near_prints(own, bits), "fingerprint-groups")
    named = own.join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(named, "root").select(F.col("fp").alias("f"), "component_id")
    return prints.join(named, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row of docs for each group of op4's links: the one with the smallest doc_id, then the smallest hash.

    Rows are known by hashes of all their columns, so different texts under one doc_id are decided each for itself.
    Rows without doc_id stay as they are; null, empty and blank texts are copies of each other; an empty table stays
    empty.  Other columns are kept, whatever their names.
    """
    prints = staged(fingerprints(keyed(docs.where("doc_id IS NOT NULL")), size), "fingerprints")
    roots = staged(near_prints(staged(prints.select("fp").distinct(), "distinct-fingerprints"), bits), "fingerprint-groups")
    return chosen_rows(docs, staged(prints.join(roots, "fp").select("doc_id", "k1", "k2", "root"), "grouped-rows"))


def op4_simhash_golay(spark, sf_dir):
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
