"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, runs of other characters than letters become one space, and all n-grams of up to ORDER
characters are hashed to 2^BITS features.  Document frequencies are counted over all labelled rows, whole texts.  The
regression is trained with follow-the-regularised-leader (per-coordinate steps, elastic net) on a bounded sample of
the labelled rows, and a temperature fitted on rows of the sample that were not trained on calibrates its scores.  The model
is a matrix of fixed size, so a prediction is a sum of rows of it, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_prefix, own_columns, staged, table

ORDER, BITS = 4, 17
#: The sample to fit on: distinct rows in all, shared evenly by the languages, and feature counts in all; each CALIBRATE-th row calibrates.
FIT_ROWS, FIT_ENTRIES, CALIBRATE = 2048, 8_000_000, 5
#: At most this many languages are learned, the commonest ones: their weights bound the model's size.
MAX_LANGS = 128
#: Follow-the-regularised-leader: step size, its offset, the two penalties, passes over the sample; scale of the features.
ALPHA, BETA, L1, L2, EPOCHS, SCALE = 1.0, 1.0, 1e-2, 1e-3, 3, 16.0
#: Code points that are hashed at a time.
PIECE = 1 << 18
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str) -> Iterator[np.ndarray]:
    """The features of all n-grams of a text, repeats included, in pieces."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[codes]
    keep = letter | np.append(True, letter[:-1]) if len(letter) else letter
    c = np.concatenate([[32], np.where(letter, codes, 32)[keep], [32]]).astype(np.uint32)
    for start in range(0, len(c), PIECE):
        piece = c[start : start + PIECE + ORDER - 1]
        own = min(PIECE, len(c) - start)
        h = np.zeros(len(piece), np.uint32)
        found = []
        for n in range(1, ORDER + 1):
            h = h[: len(piece) - n + 1] * np.uint32(0x01000193) + piece[n - 1 :]
            mixed = (h ^ np.uint32(0x9E3779B1 * n & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            found.append(((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS))[:own])
        yield np.concatenate(found)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and how often each occurs."""
    total = sum((np.bincount(f, minlength=2**BITS) for f in grams(text)), np.zeros(2**BITS, np.int64))
    ids = np.flatnonzero(total)
    return ids.astype(np.int32), total[ids]


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """The number of texts that have a letter, and how many of them hold each feature; 2^BITS + 1 sums whatever the size."""

    def run(batches):
        n, often, seen = 0, np.zeros(2**BITS, np.int64), np.zeros(2**BITS, bool)
        for batch in batches:
            for x in batch.column(0):
                if has_letter(text := x.as_py()):
                    pieces = list(grams(text))
                    for f in pieces:
                        seen[f] = True
                    often += seen
                    n += 1
                    for f in pieces:
                        seen[f] = False
        ids = np.flatnonzero(often)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(ids, -1).astype(np.int32)), pa.array(np.append(often[ids], n))], ["feature", "n"])

    sums = texts.select("text").mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    feature, n = sums.column("feature").to_numpy(), sums.column("n").to_numpy()
    often = np.zeros(2**BITS, np.int64)
    often[feature[feature >= 0]] = n[feature >= 0]
    return int(n[feature < 0].sum()), often


def sample(labelled: DataFrame, langs: dict[str, int], fit_rows: int = FIT_ROWS, fit_entries: int = FIT_ENTRIES) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, ids, counts) of the rows to fit on, by hash: each language has the same share of fit_rows, and counts end at fit_entries.

    langs: how many rows each language has.  A limit on the hash leaves about twice a language's share, so no task
    sees a whole language.
    """
    share = max(1, fit_rows // max(1, len(langs)))
    limits = {x: int(-(2**63) + 2**64 * min(1.0, 2 * share / n)) - (1 if n <= 2 * share else 0) for x, n in langs.items()}
    limit = labelled.sparkSession.createDataFrame(list(limits.items()), "lang string, most long")  # MAX_LANGS rows at most
    rows = labelled.select("lang", "text", F.xxhash64("doc_id", "text").alias("h")).join(F.broadcast(limit), "lang").where("h <= most")
    rows = rows.groupBy("lang", "h").agg(F.first("text").alias("text"))  # copies count once
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= share)

    def run(batches):
        for batch in batches:
            out = []
            for lang, text, h in zip(*[batch.column(c).to_pylist() for c in (0, 1, 2)], strict=True):
                if has_letter(text):
                    ids, n = counts(text)
                    out.append((lang, h, len(ids), ids.tobytes(), n.astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, KINDS, strict=True)], NAMES)

    made = staged(rows.select("lang", "text", "h").mapInArrow(run, "lang string, h long, m long, ids binary, n binary"), "langid-sample")
    upto = F.sum("m").over(Window.orderBy("h", "lang"))  # fit_rows rows at most
    within = made.select("lang", "h", "m").withColumn("upto", upto).where(F.col("upto") <= fit_entries).select("lang", "h")
    found = made.join(F.broadcast(within), ["lang", "h"]).select("h", "lang", "ids", "n").collect()
    return [(r.lang, np.frombuffer(r.ids, np.int32), np.frombuffer(r.n, np.float32)) for r in sorted(found, key=lambda r: (r.h, r.lang))]


KINDS = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
NAMES = ["lang", "h", "m", "ids", "n"]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Leader:
    """Follow-the-regularised-leader for multinomial logistic regression; the last feature is the bias, which has no penalty."""

    def __init__(self, features: int, classes: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((features + 1, classes), np.float32), np.zeros((features + 1, classes), np.float32)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, ids: np.ndarray) -> np.ndarray:
        z, n = self.z.take(ids, axis=0), self.n.take(ids, axis=0)
        own = (ids < len(self.z) - 1)[:, None]
        l1, l2 = self.l1 * own, self.l2 * own
        return np.where(np.abs(z) <= l1, 0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + l2))

    def learn(self, ids: np.ndarray, x: np.ndarray, y: int) -> None:
        """One row: ids of its features, the bias among them, their values, and its class."""
        w = self.weights(ids)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p[None, :]
        n = self.n.take(ids, axis=0)
        self.z[ids] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[ids] = n + g * g


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search (the loss is unimodal in it); 1 without rows or choice.

    The true language counts as 1 - 1 / (rows + 2), so that rows without a mistake don't ask for boundless scores.
    """
    if not len(y) or logits.shape[1] < 2:
        return 1.0
    rest = 1 / (len(y) + 2)
    aim = np.full(logits.shape, rest / (logits.shape[1] - 1))
    aim[np.arange(len(y)), y] = 1 - rest

    def loss(t: float) -> float:
        x = logits / np.exp(t)
        x = x - x.max(1, keepdims=True)
        return float((aim * (np.log(np.exp(x).sum(1, keepdims=True)) - x)).sum(1).mean())

    low, high, cut = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - cut * (high - low), low + cut * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class Model:
    """langs in order; weights (features by languages, times the inverse document frequencies and the scale); bias; temperature."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for f in grams(text):
            total += np.ones(len(f), np.float32) @ self.weights.take(f, axis=0)
            n += len(f)
        return total / n + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(min(1.0, max(0.0, p[best])))


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, fit_entries: int = FIT_ENTRIES, max_langs: int = MAX_LANGS, epochs: int = EPOCHS) -> Model:
    """A model of labelled (doc_id, text, lang); rows without lang or without a letter teach nothing, nor do languages beyond max_langs."""
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    common = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    often = {r["lang"]: r["count"] for r in common}
    if not often:
        return Model([], np.zeros((2**BITS, 0), np.float32), np.zeros(0))
    n, df = document_frequencies(labelled)
    idf = np.log((n + 1) / (df + 1))
    rows = sample(labelled, often, fit_rows, fit_entries)
    langs = sorted({x for x, *_ in rows})
    if not langs:
        return Model([], np.zeros((2**BITS, 0), np.float32), np.zeros(0))
    leader = Leader(2**BITS, len(langs))
    data = [(np.append(ids, 2**BITS), np.append(c / c.sum() * idf[ids] * SCALE, 1.0), langs.index(x)) for x, ids, c in rows]
    kept = [r for i, r in enumerate(data) if i % CALIBRATE]
    held = data[::CALIBRATE] if kept else []
    for _ in range(epochs):
        for row in kept or data:
            leader.learn(*row)
    logits = np.array([x @ leader.weights(ids) for ids, x, _ in held]).reshape(-1, len(langs))
    whole = leader.weights(np.arange(2**BITS + 1))
    weights = (whole[:-1] * (idf * SCALE)[:, None]).astype(np.float32)
    return Model(langs, weights, whole[-1].astype(float), temperature(logits, np.array([y for *_, y in held], int)))


def predicted(text: Column, model: Model) -> Column:
    """(lang, score) of a text."""

    @F.arrow_udf("lang string, score double")
    def run(texts: pa.Array) -> pa.Array:
        found = [model.predict(x.as_py()) for x in texts]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["lang", "score"])

    return run(text)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score, from text alone.

    Null, empty and letterless texts are `und` with score 0, as are all texts if nothing was learned.  Texts of any length
    are read whole; repeated rows are predicted alike; ties go to the smaller language.  Columns of docs with the names of the added ones are
    replaced, others are kept whatever their names.  An empty table gives an empty result.
    """
    docs = docs.drop("lang_pred", "score")
    at = f"{free_prefix(docs)}found"
    rows = docs.withColumn(at, predicted(F.col("text"), model))
    return rows.select(*own_columns(docs), F.col(f"{at}.lang").alias("lang_pred"), F.col(f"{at}.score").alias("score"))


def op13_language_id(spark, sf_dir):
    """Rows without doc_id are no held-out rows, and teach nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    turn = F.crc32(F.col("doc_id").cast("string")) % 3
    model = fit(docs.where(turn != 1))
    found = identify(docs.select("doc_id", "text", F.coalesce(turn == 1, F.lit(False)).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")
