"""Best-fit packing with large-item matching.

Documents become pieces of at most `capacity` tokens.  Only the number of pieces of each length matters for
packing, so the packing is planned on a histogram of `capacity` numbers: pieces above a third of the capacity
are matched greedily, at most two to a bin, then shorter ones fill the best-fitting gaps, longest first.  Pieces
find their place by their rank among pieces of their length; ranks come from counts by block and length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table
from .encode import VOCABULARY, encoder

CAPACITY = 1024
END = 2


def cut(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str = VOCABULARY, added: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, block, seq): the pieces; seq counts a block's pieces of one length.

    Null texts count as empty and give one piece that holds the end id only.  The first piece of a document that
    is cut takes what does not fill whole pieces.
    """
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    tail = int(end).to_bytes(4, "little")

    def run(batches):
        block, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        ids = encoder(vocabulary, added).ids
        for batch in batches:
            at, piece, start, length, crc, seq = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                data = ids(text.as_py() or "") + tail
                n, a, k = len(data) // 4, 0, 0
                while a < n:
                    b = min(n, a + ((n - a) % capacity or capacity))
                    at.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(data[4 * a : 4 * b]))
                    seq.append(int(seen[b - a]))
                    seen[b - a] += 1
                    a, k = b, k + 1
            whose = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([whose, pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc, [block] * len(at), seq)]], ["doc_id", "piece", "start", "length", "ids_crc32", "block", "seq"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, block long, seq long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups (bins, [(length, pieces of that length in each bin), ...]) that hold all pieces; at most a few thousand."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    third = capacity // 3
    gaps: dict[int, list[tuple[int, list]]] = {}  # free tokens -> groups

    def put(n: int, runs: list) -> None:
        if n:
            gaps.setdefault(capacity - sum(a * k for a, k in runs), []).append((n, runs))

    for a in range(capacity, third, -1):
        b = min(a, capacity - a)
        while left[a] and b > third:
            if b == a:
                n = int(left[a] // 2)
                put(n, [(a, 2)])
                left[a] -= 2 * n
            else:
                n = int(min(left[a], left[b]))
                if n:
                    put(n, [(a, 1), (b, 1)])
                    left[a] -= n
                    left[b] -= n
            b -= 1
        put(int(left[a]), [(a, 1)])
        left[a] = 0
    for a in range(third, 0, -1):
        need = int(left[a])
        for gap in sorted(g for g in gaps if g >= a):
            if not need:
                break
            groups, k = gaps.pop(gap), gap // a
            for n, runs in groups:
                full = min(n, need // k)
                put(full, [*runs, (a, k)])
                need -= full * k
                rest = n - full
                if rest and 0 < need < k:
                    put(1, [*runs, (a, need)])
                    need, rest = 0, rest - 1
                put(rest, runs)
        k = capacity // a
        put(need // k, [(a, k)])
        if need % k:
            put(1, [(a, need % k)])
    return [group for groups in gaps.values() for group in groups]


def _places(groups: list) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first bin, pieces in a bin, offset in the bin), by first rank."""
    rows: dict[int, list] = {}
    taken: dict[int, int] = {}
    first = 0
    for n, runs in groups:
        offset = 0
        for length, k in runs:
            rows.setdefault(length, []).append((taken.get(length, 0), first, k, offset))
            taken[length] = taken.get(length, 0) + n * k
            offset += length * k
        first += n
    return {length: np.array(x, np.int64) for length, x in rows.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str = VOCABULARY, added: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece.

    Repeated rows and equal ids are packed each for itself; null ids stay null; null and empty texts are an end id alone;
    texts of any length are cut whole; an empty table gives no pieces.  Columns of docs other than doc_id and text are not read.
    """
    pieces = staged(cut(docs, capacity, end, vocabulary, added), "pieces")
    counts = staged(pieces.groupBy("block", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    places = _places(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(counts, ["block", "length"]).withColumn("rank", F.col("before") + F.col("seq"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            bins, offset = np.zeros_like(rank), np.zeros_like(rank)
            for a in np.unique(length):
                own = np.flatnonzero(length == a)
                p = places[int(a)]
                p = p[np.searchsorted(p[:, 0], rank[own], "right") - 1]
                i = rank[own] - p[:, 0]
                bins[own], offset[own] = p[:, 1] + i // p[:, 2], p[:, 3] + i % p[:, 2] * a
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), added=True)
