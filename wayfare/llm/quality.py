"""Quality rules: an isolation forest over rule statistics, its threshold calibrated on labelled rows.

A statistic counts by how much it leaves its rule's range, so that ordinary texts lie together at zero and the
forest's random splits part those that break a rule, however varied ordinary texts are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, free_prefix, own_columns, quoted, staged, table

#: The forest is fitted on at most this many rows; trees see SUBSAMPLE of them each.
FIT_ROWS, TREES, SUBSAMPLE, SEED = 4096, 100, 256, 7
#: Of the labelled good rows at most this share may be rejected.
LOSS = 0.005
#: Scores are counted in so many bins when the threshold is calibrated.
BINS = 2048
WINDOW = 5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Each statistic's range: characters a word, shares of symbols, repeated lines, capitals, digits and exclamation marks,
#: distinct words over words ** 0.85, share of the commonest word, log of words a line, shares of bars and of doubled words.
RANGES = {
    "word_len": (3.0, 10.0), "symbols": (0.0, 0.1), "dup_lines": (0.0, 0.5), "upper": (0.0, 0.3), "digits": (0.0, 0.35), "exclaim": (0.0, 0.2),
    "distinct": (0.5, np.inf), "top_word": (0.0, 0.3), "line_words": (0.0, 8.0), "pipes": (0.0, 0.1), "sticky": (0.0, 0.2),
}
FEATURES = tuple(RANGES)
_LOW, _HIGH = np.array(list(RANGES.values())).T
_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
_UPPER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def text_statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the statistics (in the order of FEATURES) of one text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # bytes split at exactly the six white-space characters
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in _SPACES)
    symbols = sum(text.count(c) for c in _SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    dup = len(lines) - len(set(lines))
    ids: dict[bytes, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in words], np.uint64)
    repeat = sticky = 0
    if n >= WINDOW:
        x = codes * _MIX[0]
        x ^= x >> np.uint64(29)
        h = sum((x[i : n - WINDOW + 1 + i] * _MIX[i] for i in range(1, WINDOW)), x[: n - WINDOW + 1] * _MIX[1] * _MIX[2])
        _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(counts[inverse] > 1)
        edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + WINDOW, minlength=n + 1)[: n + 1] if len(starts) else np.zeros(1, int)
        repeat = int((np.cumsum(edge) > 0).sum())
    if n > 1:
        sticky = int((codes[1:] == codes[:-1]).sum())
    top = int(np.bincount(codes.astype(np.int64)).max()) if n else 0
    d = max(n, 1)
    size = max(len(raw), 1)
    upper, digits = size - len(raw.translate(None, _UPPER)), size - len(raw.translate(None, _DIGIT))
    features = [chars / d, symbols / d, dup / max(len(lines), 1), upper / size, digits / size, text.count("!") / d, len(ids) / d**0.85, top / d, np.log1p(n / max(len(lines), 1)), text.count("|") / d, sticky / d]
    return [n, chars, symbols, dup, repeat], [float(x) for x in features]


def excess(x: np.ndarray) -> np.ndarray:
    """By how much statistics leave their ranges."""
    x = x.reshape(-1, len(FEATURES))
    return np.maximum(x - _HIGH, 0) + np.maximum(_LOW - x, 0)


def base_failed(prefix: str = "") -> Column:
    words = F.col(f"{prefix}n_words")
    return (words < 10) | (100 * F.col(f"{prefix}n_repeat_words") > 20 * words)


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, base counts, features): features are the excesses of a text's statistics; null and blank texts have no words."""
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            both = [text_statistics(x.as_py()) for x in batch.column(1)]
            counts = np.array([x[0] for x in both], np.int64).reshape(-1, len(BASE))
            flat = excess(np.array([x[1] for x in both], np.float64))
            ends = pa.array(np.arange(0, flat.size + 1, len(FEATURES), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(counts[:, i]) for i in range(len(BASE))], pa.ListArray.from_arrays(ends, pa.array(flat.reshape(-1)))], ["doc_id", *BASE, "features"])

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {kind}", *[f"{c} long" for c in BASE], "features array<double>"]))


class IsolationForest:
    """Path lengths over random splits; arrays of equal shape for all trees, so that rows are scored by array steps."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.psi = min(subsample, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(self.psi, 2)))))
        slots = 2 ** (self.depth + 1)
        self.feature, self.split = np.full((trees, slots), -1, np.int16), np.zeros((trees, slots))
        self.path = np.zeros((trees, slots))
        for t in range(trees):
            self._grow(t, rows[rng.choice(len(rows), self.psi, replace=False)], 1, 0, rng)

    @staticmethod
    def _average(n: float) -> float:
        return 0.0 if n <= 1 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else 1.0

    def _grow(self, t: int, x: np.ndarray, at: int, depth: int, rng) -> None:
        wide = np.flatnonzero(x.max(0) > x.min(0)) if len(x) else []
        if depth >= self.depth or len(x) <= 1 or not len(wide):
            self.path[t, at] = depth + self._average(len(x))
            return
        f = rng.choice(wide)
        s = rng.uniform(x[:, f].min(), x[:, f].max())
        self.feature[t, at], self.split[t, at] = f, s
        self._grow(t, x[x[:, f] < s], 2 * at, depth + 1, rng)
        self._grow(t, x[x[:, f] >= s], 2 * at + 1, depth + 1, rng)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for rows that few splits part from the rest."""
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for feature, split, path in zip(self.feature, self.split, self.path, strict=True):
            at = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                at = np.where(inner, 2 * at + (x[every, np.maximum(f, 0)] >= split[at]), at)
            total += path[at]
        return 2.0 ** (-total / len(self.path) / max(self._average(self.psi), 1e-9))


def fit_forest(docs: DataFrame, labels: DataFrame | None, fit_rows: int = FIT_ROWS) -> IsolationForest | None:
    """A forest of labelled rows that pass the base: of the fit_rows labelled ids with the smallest hashes; None without any."""
    if labels is None:
        return None
    ids = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    some = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")  # fit_rows ids at most
    chosen = smallest_hashes(statistics(some).where(~base_failed()).select("doc_id", "features"), fit_rows)
    return IsolationForest(chosen) if len(chosen) else None


def smallest_hashes(rows: DataFrame, n: int) -> np.ndarray:
    """Features of the n distinct rows with the smallest hashes.

    A limit on the hash leaves about 1.5 n rows of all tasks together to be sent, whatever the number of tasks.
    """
    hashed = rows.select(F.xxhash64("doc_id", "features").alias("h"), "features")
    distinct = hashed.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    if distinct > 1.5 * n:
        hashed = hashed.where(F.col("h") < int(-(2**63) + 2**64 * (1.5 * n / distinct)))
    chosen = hashed.groupBy("h").agg(F.first("features").alias("features")).collect()
    return np.array([r.features for r in sorted(chosen, key=lambda r: r.h)[:n]])


def scored(docs: DataFrame, forest: IsolationForest | None, prefix: str = "", text: bool = False) -> DataFrame:
    """docs (with or without text) with the base counts and anomaly, named with the prefix; anomaly is 0 without a forest."""
    names = [c for c in docs.columns if text or c != "text"]
    numbered = [f"c{i}" for i in range(len(names))]  # tasks know columns by number, whatever their names
    at = names.index("text") if text else len(names)
    rows = docs.select(*[F.col(quoted(c)).alias(n) for c, n in zip(names, numbered, strict=True)], *([] if text else ["text"]))

    def run(batches):
        for batch in batches:
            both = [text_statistics(x.as_py()) for x in batch.column(at)]
            counts = np.array([x[0] for x in both], np.int64).reshape(-1, len(BASE))
            features = excess(np.array([x[1] for x in both], np.float64))
            anomaly = np.zeros(len(both)) if forest is None else forest.score(features)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(numbered)], *[pa.array(counts[:, i]) for i in range(len(BASE))], pa.array(anomaly)], [*numbered, *BASE, "anomaly"])

    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(numbered)]], *[f"{c} long" for c in BASE], "anomaly double"])
    kept = [F.col(n).alias(c) for c, n in zip(names, numbered, strict=True)]
    return rows.mapInArrow(run, schema).select(*kept, *[F.col(c).alias(prefix + c) for c in (*BASE, "anomaly")])


def calibrate(rated: DataFrame, labels: DataFrame | None, prefix: str = "", loss: float = LOSS) -> float:
    """The threshold with the best balance of labelled rows, among those that reject at most `loss` of the good ones.

    Only rows that pass the base count; among equal thresholds the middle one is taken.  Without labelled rows of both
    kinds nothing but the base rejects.  Labelled rows are counted by quality and score bin, so the driver gets
    2 * BINS numbers whatever the size.
    """
    if labels is None:
        return float("inf")
    own = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").alias("i")).agg(F.min("quality").alias("q"))
    at = F.least(F.floor(F.col(f"{prefix}anomaly") * BINS), F.lit(BINS - 1)).cast("int")
    rows = rated.where(~base_failed(prefix)).select("doc_id", at.alias("at"))
    counts = rows.join(own, F.col("doc_id") == F.col("i")).groupBy("at", (F.col("q") == 1).alias("good")).agg(F.count(F.lit(1)).alias("n")).collect()
    table_ = np.zeros((2, BINS))
    for r in counts:
        table_[int(r["good"]), r["at"]] += r["n"]
    if not table_.sum(1).all():
        return float("inf")
    above = table_[:, ::-1].cumsum(1)[:, ::-1] / table_.sum(1, keepdims=True)  # share at or above a bin's lower edge
    gain = np.where(above[1] <= loss, above[0] - above[1], -1.0)
    best = np.flatnonzero(gain == gain.max())
    return float(best[0] + best[-1]) / 2 / BINS if gain.max() > 0 else float("inf")


def rate(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """docs without text, with the base counts, anomaly, base_failed and kept, one row for each row.

    Null texts have no words and so fail the base; null ids are rated but never labelled; repeated rows are rated
    alike; a doc_id with several labels counts as its worst; texts of any length are read whole.  An empty table gives an empty result; an empty or
    missing table of labels leaves the base rules alone.  Columns of docs with the names of the added ones are
    replaced, others are kept whatever their names.
    """
    docs = docs.drop(*BASE, "anomaly", "base_failed", "kept")
    rated = staged(scored(docs, fit_forest(docs, labels)), "quality-scores")
    threshold = calibrate(rated, labels)
    return rated.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & (F.col("anomaly") < threshold))


def keep_good(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows of docs that rate() keeps, unchanged, whatever the names of their columns.

    Labelled rows alone are rated first, for the threshold; then each row is rated on its way out, so that no text is
    shuffled or written a second time.
    """
    prefix = free_prefix(docs)
    forest = fit_forest(docs, labels)
    threshold = calibrate(scored(labelled(docs, labels), forest, prefix), labels, prefix) if forest else float("inf")
    rated = scored(docs, forest, prefix, text=True)
    return rated.where(~base_failed(prefix) & (F.col(f"{prefix}anomaly") < threshold)).select(*own_columns(docs))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and text of the rows of docs whose id has a label; up to BROADCAST_KEYS ids are broadcast."""
    ids = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.select("doc_id", "text").join(F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids, "doc_id", "left_semi")


def op10_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rate(docs, table(spark, sf_dir, "labels")).select("doc_id", *BASE, "base_failed", "kept", "anomaly")
