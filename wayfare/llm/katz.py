"""Katz backoff language models: counted order by order, in hash buckets, and applied block by block.

Texts are laid out as blocks of numbered words.  1. Order by order, every block asks for the counts of its distinct
n-grams, by 64-bit hash: the n-grams meet in hash buckets, training counts are added up, stored as a table partitioned
by kind, and sent back, with a mark where no other block has the n-gram.  An n-gram that contains such a one is in this
block alone, so the block counts it by itself and asks nobody; of longer n-grams few are left to ask for.  2. With
counts of counts (a few numbers) discounts are known, so a block knows the probability of each n-gram seen in
training.  Each seen n-gram is one block's to report, for the backoff weight of its context: what discounting leaves
over, by what the lower order gives to unseen words.  3. Reports and the contexts that unseen n-grams need meet in
buckets by context; weights are stored and added to their texts.  Contexts of one block are weighed in it.

A token's probability is looked up recursively: seen n-gram, or weight of its context times the probability with
the first word of the context dropped; unseen contexts weigh 1.  Unigrams end the recursion: what discounting
leaves over there belongs to one unknown word, so each distribution sums to 1 over V + 1 words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import partitions, staged, table

ORDER = 2
#: Counts up to this are discounted by Good-Turing; of larger ones SLIVER of an occurrence is taken, so that every
#: context has something left for unseen words.
GOOD_TURING, SLIVER = 5, 0.01
#: Bytes of text in a block; n-grams in a bucket, on average.
BLOCK_BYTES, BUCKET_KEYS = 10_000_000, 1_500_000
END, BEGIN = 0, 1
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ZSTD = {"codec": "zstd", "asbytes": True}


def _mix(context: np.ndarray, word: np.ndarray, order: int) -> np.ndarray:
    x = (context * _A) ^ (word + np.uint64(order))
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _pack(x: np.ndarray) -> bytes:
    """Byte planes, compressed: sorted hashes go in as differences."""
    return pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), **_ZSTD) if len(x) else b""


def _unpack(data: bytes, n: int, dtype) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype)
    width = np.dtype(dtype).itemsize
    raw = pa.decompress(data, n * width, **_ZSTD)
    return np.frombuffer(raw, np.uint8).reshape(width, n).T.copy().view(dtype).reshape(n)


def layout(docs: DataFrame, train: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, n_tokens, ids, train, sizes, tokens, words): texts as numbers of their block's words, an end after each."""
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def run(batches):
        part, nr = TaskContext.get().partitionId(), 0

        def fresh():
            return [], [], [], [], {b"": END, b" ": BEGIN}, [xxhash.xxh64_intdigest(b"", 1), xxhash.xxh64_intdigest(b" ", 1)], 0

        def flush():
            n = sum(map(len, tokens))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 24) + nr]), pa.array([n]), pa.array([ids], pa.list_(whose)), pa.array([np.array(trained, np.uint8).tobytes()]), pa.array([np.array(sizes, np.uint32).tobytes()]),
                    pa.array([_pack(np.concatenate(tokens) if tokens else np.zeros(0, np.uint32))], pa.binary()), pa.array([np.array(words, np.uint64).tobytes()]),
                ],
                ["block", "n_tokens", "ids", "train", "sizes", "tokens", "words"],
            )

        whose = None
        ids, trained, sizes, tokens, number, words, size = fresh()
        for batch in batches:
            whose = batch.schema.field(0).type
            for i, text, learn in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = (text.as_py() or "").encode().lower()
                split = raw.split()
                got = [number.get(w, -1) for w in split]
                if -1 in got:
                    for at, w in enumerate(split):
                        if got[at] < 0:
                            if w not in number:
                                number[w] = len(words)
                                words.append(xxhash.xxh64_intdigest(w))
                            got[at] = number[w]
                got.append(END)
                ids.append(i)
                trained.append(learn)
                sizes.append(len(got))
                tokens.append(np.array(got, np.uint32))
                size += len(raw)
                if size >= block_bytes:
                    yield flush()
                    nr += 1
                    ids, trained, sizes, tokens, number, words, size = fresh()
        if ids:
            yield flush()

    return docs.select("doc_id", "text", train.alias("train")).mapInArrow(run, f"block long, n_tokens long, ids array<{kind}>, train binary, sizes binary, tokens binary, words binary")


class Grams:
    """The distinct n-grams of a block, order by order.

    at[o]: for each token its n-gram of order o + 1; context, word: for each n-gram its context (an n-gram of the
    order below, or the one past the last for the beginning) and last word; hash, sort: hashes and their order.
    """

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, words: np.ndarray, order: int):
        first = np.zeros(len(tokens), bool)
        first[np.cumsum(sizes)[:-1]] = True
        if len(first):
            first[0] = True
        self.at, self.context, self.word, self.hash, self.start = [tokens.astype(np.int32)], [None], [np.arange(len(words), dtype=np.int32)], [words], [words[BEGIN]]
        for o in range(1, order):
            below = self.at[-1]
            before = np.empty_like(below)
            before[1:] = below[:-1]
            begin = len(self.hash[-1]) if o > 1 else BEGIN
            before[first] = begin
            code, inverse = np.unique(before.astype(np.int64) * len(words) + self.at[0], return_inverse=True)
            inverse = inverse.astype(np.int32)  # places of a block fit 32 bits; blocks are held whole, so their arrays are kept small
            context, word = (x.astype(np.int32) for x in np.divmod(code, len(words)))
            del code
            above = np.append(self.hash[-1], self.start[-1])
            self.at.append(inverse.reshape(-1))
            self.context.append(context)
            self.word.append(word)
            self.hash.append(_mix(above[context], words[word], o + 1))
            self.start.append(_mix(np.array([self.start[-1]]), words[BEGIN : BEGIN + 1], o + 1)[0])
        self.sort = [np.argsort(h, kind="stable").astype(np.int32) for h in self.hash]


def _block(r: dict, order: int) -> tuple[Grams, np.ndarray, np.ndarray, np.ndarray]:
    tokens, sizes, words = _unpack(r["tokens"], r["n_tokens"], np.uint32), np.frombuffer(r["sizes"], np.uint32).astype(np.int64), np.frombuffer(r["words"], np.uint64)
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    return Grams(tokens, sizes, words, order), sizes, doc, np.frombuffer(r["train"], np.uint8).astype(bool)


def _edges(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's share of the sorted hashes begins."""
    bounds = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(sorted_hashes, bounds), [len(sorted_hashes)]))


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}


def lower_grams(grams: Grams, o: int) -> np.ndarray:
    """Of each n-gram, the one with its first word dropped."""
    low = np.zeros(len(grams.hash[o]), np.int32)
    low[grams.at[o]] = grams.at[o - 1]
    return low


def asked_for(grams: Grams, o: int, sole: list[np.ndarray]) -> np.ndarray:
    """Places, by hash, of the n-grams that other blocks may have: neither context nor lower n-gram is this block's alone."""
    if not o:
        return grams.sort[0]
    above = np.append(sole[o - 1], False)
    shared = ~(above[grams.context[o]] | sole[o - 1][lower_grams(grams, o)])
    return grams.sort[o][shared[grams.sort[o]]]


def local_counts(grams: Grams, o: int, train: np.ndarray) -> np.ndarray:
    """Training counts within the block; train: of each token."""
    return np.bincount(grams.at[o], train, len(grams.hash[o])).astype(np.uint64)


def known_counts(grams: Grams, train: np.ndarray, got: list[dict], upto: int) -> tuple[list, list, list]:
    """(count, sole, mine) of the n-grams of each order below upto; got: the replies to this block."""
    count, sole, mine = [], [], []
    for o in range(upto):
        places = asked_for(grams, o, sole)
        parts = sorted((x for x in got if x["ord"] == o), key=lambda x: x["bucket"])
        reply = np.concatenate([_unpack(x["counts"], x["n"], np.uint64) for x in parts]) if parts else np.zeros(0, np.uint64)
        c, alone, own = local_counts(grams, o, train), np.ones(len(grams.hash[o]), bool), np.ones(len(grams.hash[o]), bool)
        c[places], alone[places], own[places] = reply >> np.uint64(2), (reply & np.uint64(2)) > 0, (reply & np.uint64(1)) > 0
        for to, x in ((count, c), (sole, alone), (mine, own)):
            to.append(x)
    return count, sole, mine


def statistics(counts: np.ndarray) -> list[int]:
    """(distinct, total, n1, n2, ...) of the counts above 0."""
    return [int((counts > 0).sum()), int(counts.sum()), *[int((counts == c).sum()) for c in range(1, GOOD_TURING + 2)]]


ASKS = "bucket int, block long, ord int, n long, keys binary, counts binary, stats array<long>"


def requests(blocks: DataFrame, o: int, buckets: int) -> DataFrame:
    """ASKS: each block's n-grams of order o + 1 with its own training counts, by hash bucket; blocks: with got, replies to lower orders.

    Statistics of the n-grams that a block counts by itself go with them.
    """
    types = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    names = [f.split()[0] for f in ASKS.split(", ")]

    def run(batches):
        for r in _rows(batches):
            grams, _, doc, train = _block(r, o + 1)
            _, sole, _ = known_counts(grams, train[doc], r.get("got") or [], o)
            places, counts = asked_for(grams, o, sole), local_counts(grams, o, train[doc])
            hashes, asked = grams.hash[o][places], counts[places].astype(np.uint32)
            edges = _edges(hashes, buckets)
            out = []
            for b in np.flatnonzero(np.diff(edges)).tolist():
                part = slice(edges[b], edges[b + 1])
                out.append((b, r["block"], o, part.stop - part.start, _pack(np.diff(hashes[part], prepend=np.uint64(0))), _pack(asked[part]), None))
            counts[places] = 0
            out.append((int(r["block"] % buckets), r["block"], o, 0, b"", b"", statistics(counts)))
            for i in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 256], strict=True), types, strict=True)], names)

    return blocks.select("block", "n_tokens", "train", "sizes", "tokens", "words", *[c for c in blocks.columns if c == "got"]).mapInArrow(run, ASKS)


COUNTED = "kind string, bucket int, block long, ord int, n long, keys binary, counts binary, stats array<long>"


def count_bucket(got: pa.Table) -> pa.Table:
    """Counts of one bucket: rows of the model (distinct n-grams seen in training), replies to blocks, statistics."""
    rows = got.to_pylist()
    own = [r for r in rows if r["n"]]
    out = []
    keys = np.concatenate([np.zeros(0, np.uint64), *[np.cumsum(_unpack(r["keys"], r["n"], np.uint64)) for r in own]])
    counts = np.concatenate([np.zeros(0, np.uint32), *[_unpack(r["counts"], r["n"], np.uint32) for r in own]])
    distinct, first, inverse, blocks = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    total = np.bincount(inverse, counts, len(distinct)).astype(np.uint64)
    reply = (total * np.uint64(4) + np.uint64(2) * (blocks == 1))[inverse]
    reply[first] += np.uint64(1)  # this block reports the n-gram to its context
    at = 0
    for r in own:
        out.append(("reply", r["bucket"], r["block"], r["ord"], r["n"], None, _pack(reply[at : at + r["n"]]), None))
        at += r["n"]
    seen = total > 0
    stats = np.array([statistics(total), *[r["stats"] for r in rows if r["stats"]]]).sum(0).tolist()
    out.append(("counts", rows[0]["bucket"], None, rows[0]["ord"], int(seen.sum()), _pack(np.diff(distinct[seen], prepend=np.uint64(0))), _pack(total[seen]), stats))
    cols = list(zip(*out, strict=True))
    types = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [f.split()[0] for f in COUNTED.split(", ")])


def discounts(counts_of_counts: list[int], upto: int = GOOD_TURING) -> np.ndarray:
    """d[r] for r up to `upto`: Katz's Good-Turing ratios; where they leave (0, 1), absolute discounting's."""
    n = [0.0, *map(float, counts_of_counts)]
    d = np.ones(upto + 1)
    absolute = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    top = (upto + 1) * n[upto + 1] / n[1] if n[1] else 1.0
    for r in range(1, upto + 1):
        d[r] = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if n[r] and top != 1 else -1.0
        if not 0 < d[r] < 1:
            d[r] = (r - absolute) / r
    return d


class Probabilities:
    """Discounted counts, from each order's (distinct, total, n1, n2, ...)."""

    def __init__(self, stats: list[list[int]]):
        self.known, self.total = stats[0][:2]
        self.d = [discounts(s[2:]) for s in stats]
        small = np.arange(1, GOOD_TURING + 1)
        ones = np.array(stats[0][2 : 2 + GOOD_TURING], float)
        large = max(0, self.known - ones.sum())
        left = (ones * small * (1 - self.d[0][1:])).sum() + large * SLIVER
        self.unknown = left / self.total if self.total else 1.0

    def kept(self, counts: np.ndarray, o: int) -> np.ndarray:
        c = counts.astype(float)
        return np.where(counts <= GOOD_TURING, c * self.d[o][np.minimum(counts, GOOD_TURING).astype(np.int64)], c - SLIVER)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.kept(counts, 0) / max(self.total, 1), self.unknown)


def contexts(count: list[np.ndarray], o: int) -> np.ndarray:
    """How often the contexts of order o occur in training; the last is the beginning of a text."""
    above = count[o - 1].copy()
    if o == 1:
        above[BEGIN] = count[0][END]  # each text begins and ends once
    return np.append(above, count[0][END])


ASKED = "bucket int, block long, n long, keys binary, left binary, low binary, m long, ask binary, ask_doc binary, docs array<struct<idx:int,doc_id:{kind},held_out:boolean,n_tokens:long,n_known:long,base:double,score:double>>"


def evaluate(blocks: DataFrame, p: Probabilities, order: int, buckets: int, kind: str) -> DataFrame:
    """What each block can say by itself: its texts' scores but for others' backoff weights, its reports, and weights to ask for."""

    id_type = _arrow(kind)

    def run(batches):
        schema = None
        for r in _rows(batches):
            grams, sizes, doc, train = _block(r, order)
            count, sole, mine = known_counts(grams, train[doc], r["got"], order)
            known = count[0][grams.at[0]]
            base = np.bincount(doc, np.log10((known + 1.0) / (p.total + p.known + 1)), len(sizes))
            n_known = np.bincount(doc, known > 0, len(sizes)).astype(np.int64)

            prob = [p.unigram(count[0])]
            reports, weights = [], [None]
            for o in range(1, order):
                context = grams.context[o]
                times = contexts(count, o)[context].astype(float)
                c, low = count[o], lower_grams(grams, o)
                prob.append(np.where(c > 0, p.kept(c, o) / np.maximum(times, 1), 0.0))
                own = np.flatnonzero(mine[o] & (c > 0))
                n = len(count[o - 1]) + 1
                left = np.bincount(context[own], (c[own] - p.kept(c[own], o)) / times[own], n)
                down = np.bincount(context[own], prob[o - 1][low[own]], n)
                alone = np.append(sole[o - 1], False)  # all that follows these contexts is here
                weights.append(np.where(alone, left / np.maximum(1 - down, 1e-12), np.nan))
                some = np.flatnonzero((np.bincount(context[own], minlength=n) > 0) & ~alone)
                hashes = np.append(grams.hash[o - 1], grams.start[o - 1])
                reports.append((hashes[some], left[some], down[some]))
            score = np.zeros(len(doc))
            todo = np.arange(len(doc))
            asked = []
            for o in range(order - 1, 0, -1):
                gram = grams.at[o][todo]
                seen = count[o][gram] > 0
                score[todo[seen]] += np.log10(prob[o][gram[seen]])
                todo, gram = todo[~seen], gram[~seen]
                context = grams.context[o][gram]
                hashes = np.append(grams.hash[o - 1], grams.start[o - 1])
                need, weight = contexts(count, o)[context] > 0, weights[o][context]
                here = need & ~np.isnan(weight)
                score[todo[here]] += np.log10(weight[here])
                need &= ~here
                asked.append((hashes[context[need]], doc[todo[need]]))
            score[todo] += np.log10(prob[0][grams.at[0][todo]])
            score = np.bincount(doc, score, len(sizes))

            key, left, down = (np.concatenate([x[i] for x in reports]) if reports else np.zeros(0, t) for i, t in enumerate((np.uint64, float, float)))
            ask, ask_doc = (np.concatenate([x[i] for x in asked]) if asked else np.zeros(0, np.uint64) for i in (0, 1))
            a, b = np.argsort(key, kind="stable"), np.lexsort((ask_doc, ask))
            key, left, down, ask, ask_doc = key[a], left[a], down[a], ask[b], ask_doc[b].astype(np.uint32)
            ea, eb = _edges(key, buckets), _edges(ask, buckets)
            home = int(r["block"] % buckets)
            out = []
            for t in sorted({home, *np.flatnonzero(np.diff(ea) + np.diff(eb)).tolist()}):
                x, y = slice(ea[t], ea[t + 1]), slice(eb[t], eb[t + 1])
                docs = None
                if t == home:
                    docs = [
                        {"idx": i, "doc_id": d, "held_out": not train[i], "n_tokens": int(sizes[i]), "n_known": int(n_known[i]), "base": float(base[i]), "score": float(score[i])}
                        for i, d in enumerate(r["ids"])
                    ]
                zero = np.uint64(0)
                out.append({"bucket": t, "block": r["block"], "n": len(key[x]), "keys": _pack(np.diff(key[x], prepend=zero)), "left": _pack(left[x]), "low": _pack(down[x]), "m": len(ask[y]), "ask": _pack(np.diff(ask[y], prepend=zero)), "ask_doc": _pack(ask_doc[y]), "docs": docs})
            if schema is None:
                schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("left", pa.binary()), ("low", pa.binary()), ("m", pa.int64()), ("ask", pa.binary()), ("ask_doc", pa.binary()),
                                    ("docs", pa.list_(pa.struct([("idx", pa.int32()), ("doc_id", id_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])))])
            yield pa.RecordBatch.from_pylist(out, schema)

    return blocks.select("block", "n_tokens", "ids", "train", "sizes", "tokens", "words", "got").mapInArrow(run, ASKED.format(kind=kind))


def _arrow(kind: str) -> pa.DataType:
    return to_arrow_type(DataType.fromDDL(kind))


def weigh_bucket(kind: str):
    """The function that turns a bucket's reports into backoff weights and adds them to the texts that ask."""
    fields = [("kind", pa.string()), ("bucket", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("weights", pa.binary()), ("block", pa.int64()), ("idx", pa.int32()), ("doc_id", _arrow(kind)),
              ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]

    def run(got: pa.Table) -> pa.Table:
        rows = got.to_pylist()
        key = np.concatenate([np.cumsum(_unpack(r["keys"], r["n"], np.uint64)) for r in rows])
        left, low = (np.concatenate([_unpack(r[c], r["n"], np.float64) for r in rows]) for c in ("left", "low"))
        distinct, inverse = np.unique(key, return_inverse=True)
        left, low = np.bincount(inverse, left, len(distinct)), np.bincount(inverse, low, len(distinct))
        weight = left / np.maximum(1 - low, 1e-12)
        out = [{"kind": "weights", "bucket": rows[0]["bucket"], "n": len(distinct), "keys": _pack(np.diff(distinct, prepend=np.uint64(0))), "weights": _pack(weight)}]
        tables = [pa.Table.from_pylist(out, pa.schema(fields))]
        for r in rows:
            ask, doc = np.cumsum(_unpack(r["ask"], r["m"], np.uint64)), _unpack(r["ask_doc"], r["m"], np.uint32)
            add = np.bincount(doc, np.log10(weight[np.searchsorted(distinct, ask)])) if len(ask) else np.zeros(0)
            idx = np.unique(doc)
            cols = {"kind": ["text"] * len(idx), "block": [r["block"]] * len(idx), "idx": idx.astype(np.int32), "score": add[idx]}
            tables.append(pa.table([pa.array(cols[n], t) if n in cols else pa.nulls(len(idx), t) for n, t in fields], schema=pa.schema(fields)))
            if r["docs"]:
                tables.append(pa.Table.from_pylist([{"kind": "text", "block": r["block"], **d} for d in r["docs"]], pa.schema(fields)))
        return pa.concat_tables(tables)

    return run, f"kind string, bucket int, n long, keys binary, weights binary, block long, idx int, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double"


def score(docs: DataFrame, train: Column, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row; rows where train is true are learnt from.

    Null texts count as empty: one end token.  Null ids stay null; repeated rows are scored, and learnt, each for
    itself; texts of any length are scored whole.  Without training rows every token is the one unknown word.  An empty table gives no rows.  doc_id may
    be of any type; other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    blocks = staged(layout(docs, train, block_bytes), "katz-blocks")
    size = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    buckets = max(partitions(spark), order * size // BUCKET_KEYS)
    n = max(1, blocks.count())
    replies, stats, with_replies = None, [], blocks
    sums = [F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)).alias(f"s{i}") for i in range(GOOD_TURING + 3)]
    for o in range(order):
        counted = requests(with_replies, o, buckets).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(count_bucket, COUNTED)
        counted = staged(counted, f"katz-counts-{o + 1}", "kind")
        stats.append([int(x) for x in counted.where("kind = 'counts'").agg(*sums).first()])
        more = counted.where("kind = 'reply'").select("block", F.struct("ord", "bucket", "n", "counts").alias("reply"))
        replies = more if replies is None else replies.unionByName(more)
        got = replies.repartition(n, "block").groupBy("block").agg(F.collect_list("reply").alias("got"))
        with_replies = blocks.join(got, "block")
    p = Probabilities(stats)
    run, schema = weigh_bucket(kind)
    weighed = evaluate(with_replies, p, order, buckets, kind).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, schema)
    weighed = staged(weighed, "katz-weights", "kind").where("kind = 'text'")
    cols = [F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")]
    out = weighed.groupBy("block", "idx").agg(*cols, F.max("base").alias("base_score"), F.sum("score").alias("score"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(p.total).cast("long").alias("train_tokens"), "base_score", "score")


def op1_katz_backoff(spark, sf_dir):
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out)
