"""Nulls, empty tables, ties, repeated rows, long texts and clashing column names for the operators with SQL twins."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.llm import chat, jaccard, katz, line_dedup, mixing, quality, secrets, simhash, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, n_lines long, kept boolean"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 1, 2, None) for i, t, s in rows], DOCS)


def test_mix_budgets_and_edges(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(0, 60)), f"s{i % 4}" if i % 5 else None) for i in range(400)]
    rows += [(7, "same words here", "s1")] * 5 + [(None, "no id at all", "s1"), (None, None, None), (8, "", "empty")]
    rows += [(1000 + i, "big " * 50, "hot") for i in range(200)]
    out = mixing.mix(docs(spark, rows))
    got = out.collect()
    assert len(got) == len(rows) and Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
    assert out.columns == [c for c in DOCS.replace(",", "").split()[::2] if c != "size"] + ["size", "source_size", "target", "taken"]
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.size == len((r.text or "").split())
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 5 for s, t in target.items())
    sizes = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in target}
    order = sorted(target, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_ = 1.5 * sum(sizes.values()), set(target)
    want = {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] < level * weight[s]}
        if not full:
            want |= {s: level * weight[s] for s in open_}
            break
        want |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    assert all(target[s] == pytest.approx(want[s], abs=1e-5) for s in want)
    again = mixing.mix(docs(spark, rows).repartition(5)).collect()
    assert Counter((r.doc_id, r.text, r.taken) for r in again) == Counter((r.doc_id, r.text, r.taken) for r in got)
    assert mixing.mix(docs(spark, [])).count() == 0
    times = mixing.repeat_whole(out, ["doc_id", "source"]).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in times}["hot"] > 100


def test_line_dedup_edges(spark):
    rows = [(i, f"header\nown line {i}\n\n  footer \t\nheader", "a") for i in range(10)] + [(20, "header\nother", "b"), (21, None, "a"), (22, "", None), (23, "header\n footer", "a")]
    rows += [(30 + i, "copy one\ncopy two", "c") for i in range(9)] + [(40, "x y " * 50000 + "\nheader", "a")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got[3].text == "own line 3\n" and got[3].n_lines == 5 and got[3].n_dropped == 3
    assert got[20].text == "header\nother" and got[21].text is None and got[21].n_lines == 0 and got[22].text == ""
    assert got[23].text == "" and got[30].text == "copy one\ncopy two" and got[40].n_dropped == 1 and got[3].kept is None
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    dealt = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, rows), broadcast_lines=0).collect()}
    assert dealt == got


def test_bounded_fit_sample(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.array(F.col("id").cast("double")).alias("features"))
    want = [r.features for r in rows.orderBy(F.xxhash64("doc_id", "features")).limit(200).collect()]
    assert quality.smallest_hashes(rows.unionByName(rows).repartition(7), 200).tolist() == want
    assert len(quality.smallest_hashes(rows.limit(50), 200)) == 50 and len(quality.smallest_hashes(rows.limit(0), 200)) == 0


def test_preferences_edges(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "short"), (2, 0, "user", "hi"), (2, 1, "assistant", "a longer answer"), (2, 1, "assistant", "a longer answer"),
        (3, 0, "system", "é😀"), (3, 1, None, None), (3, None, "user", "first"), (None, 0, "user", "lost"), (4, 0, "user", "same"), (5, 0, "user", "same"), (6, 0, "user", "alone"),
    ]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, rank string")
    got = chat.preferences(turns).collect()
    seen = [x for r in got for x in (r.chosen_id, r.rejected_id) if x is not None]
    assert sorted(seen) == [1, 2, 3, 4, 5, 6]
    r = next(r for r in got if r.chosen_id == 2)
    assert r.rejected_id == 1 and r.n_prefix == 1 and r.prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert [r.chosen[m.start : m.end] for m in r.chosen_mask] == ["a longer answer<|im_end|>\n"] and [r.rejected[m.start : m.end] for m in r.rejected_mask] == ["short<|im_end|>\n"]
    same = next(r for r in got if {r.chosen_id, r.rejected_id} == {4, 5})
    assert same.chosen_id == 4 and same.chosen == same.rejected == "" and same.chosen_mask == []
    assert chat.preferences(turns.limit(0)).count() == 0
    odd = chat.preferences(turns.where("conv_id = 6")).first()
    assert odd.rejected_id is None and odd.rejected is None and odd.chosen.endswith("alone<|im_end|>\n")
    many = spark.createDataFrame([(i, t, "user" if t == 0 else "assistant", "open" if t == 0 else f"say {i}") for i in range(601) for t in (0, 1)], "conv_id long, turn long, role string, text string")
    pairs = chat.preferences(many).collect()
    assert len(pairs) == 301 and sum(p.n_prefix == 1 for p in pairs) == 300


def test_topk_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.5]), (50, [0.5, 1.0]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [float("inf"), 0.0]), (None, [1.0, 0.5]), (100, [-1.0, -0.3]), (7, [2.0]), (8, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, block int")
    ok = [(n, i, [np.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, i, q in ok:
        if i is not None and i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j is None, j or 0) for m, j, v in ok if m != n)[:5]
            want += [(i, k + 1, None if none else j, -int(s)) for k, (s, none, j) in enumerate(best)]
    got = [tuple(r) for r in topk.top_k(df).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert topk.top_k(df.limit(0)).count() == 0


def test_max_score_finds_the_best():
    rng = np.random.default_rng(9)
    for n in (1, 4, 6, 500):
        x = np.floor(rng.normal(size=(n, 16)) * 40)
        x[n // 2 :: 3] = x[0]
        for q in np.floor(rng.normal(size=(20, 16)) * 40):
            alive, score = topk.max_score(x, q, 5, np.array([0]))
            full = x @ q
            assert (score == full[alive]).all() and 0 not in alive
            best = np.sort(np.delete(full, 0))[::-1][:5]
            assert np.sort(score)[::-1][:5].tolist() == best.tolist()
            assert set(np.flatnonzero(full >= best[-1]).tolist()) - {0} <= set(alive.tolist()) if len(best) == 5 else len(alive) == n - 1


def counts(text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)]


def test_quality_counts_and_verdicts(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    texts = [r.text for r in table] + [None, "", " \n\t", "a b c d e a b c d e a b c d e", "é é é\x1cx\x0by", "# * $ % & | < >", "l\nl\n \nl", "w " * 30000]
    for t in texts:
        assert quality.text_statistics(t)[0] == counts(t), repr(t)[:80]
    rows = [(i, "plain words that say nothing odd at all in this line " + str(i), "a") for i in range(300)] + [(1000 + i, " ".join(f"w{j}$$ {i}{j}&&" for j in range(20)), "a") for i in range(30)]
    rows += [(None, "an unlabelled row without an id but with enough words here", "a"), (5000, None, None), (5000, None, None)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(1000 + i, 0, 0) for i in range(15)] + [(1000, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    frame = docs(spark, rows)
    got = quality.rate(frame, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.kept == (not r.base_failed and not (r.doc_id is not None and 1000 <= r.doc_id < 2000)), r
    kept = quality.keep_good(frame, labels)
    assert kept.columns == frame.columns and kept.count() == sum(r.kept for r in got)
    assert quality.rate(docs(spark, []), labels).count() == 0
    alone = quality.rate(frame, None).where("kept").count()
    assert 250 < alone <= 331


def naive_path(forest, tree, row, at=1, depth=0):
    """Steps to a row's leaf, and what an unbuilt subtree of its rows would add."""
    f = forest.feature[tree, at]
    if f < 0:
        return forest.path[tree, at]
    return naive_path(forest, tree, row, 2 * at + int(row[f] >= forest.split[tree, at]), depth + 1)


def test_path_lengths_and_score():
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(300, len(quality.FEATURES))) * (rng.random(len(quality.FEATURES)) > 0.3)
    forest = quality.IsolationForest(rows, trees=20, subsample=64)
    c = lambda n: 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(tree, x, rng, depth=0, at=1):  # what each leaf holds, by the definition
        f = forest.feature[tree, at]
        if f < 0:
            assert depth == forest.depth or len(x) <= 1 or (x == x[0]).all()
            assert forest.path[tree, at] == pytest.approx(depth + c(len(x)))
            return
        low, high = x[:, f].min(), x[:, f].max()
        assert low < high and low <= forest.split[tree, at] <= high
        grow(tree, x[x[:, f] < forest.split[tree, at]], rng, depth + 1, 2 * at)
        grow(tree, x[x[:, f] >= forest.split[tree, at]], rng, depth + 1, 2 * at + 1)

    draw = np.random.default_rng(quality.SEED)
    own = draw.choice(len(rows), 64, replace=False)
    grow(0, rows[own], draw)
    got = forest.score(rows)
    want = [2 ** (-np.mean([naive_path(forest, t, r) for t in range(20)]) / c(64)) for r in rows]
    assert got == pytest.approx(want)
    odd = np.vstack([np.zeros((99, len(quality.FEATURES))), np.full((1, len(quality.FEATURES)), 9.0)])
    alone = quality.IsolationForest(odd).score(odd)
    assert alone[-1] > alone[0] + 0.2


def test_threshold_against_all_thresholds(spark):
    rng = np.random.default_rng(6)
    rows = [(i, 50, 0, float(x)) for i, x in enumerate(np.concatenate([rng.beta(4, 8, 900), rng.beta(8, 5, 100)]))]
    rows += [(5000 + i, 5, 0, 0.01) for i in range(50)]  # fail the base: not counted
    label = [(i, int(i < 900)) for i in range(1000)] + [(5000 + i, 0) for i in range(50)]
    rated = spark.createDataFrame(rows, "doc_id long, n_words long, n_repeat_words long, anomaly double")
    labels = spark.createDataFrame(label, "doc_id long, quality int")
    for loss in (0.005, 0.05, 1.0):
        found = quality.calibrate(rated, labels, loss=loss)
        good, bad = (np.array([int(r[3] * quality.BINS) for r in rows[a:b]]) for a, b in ((0, 900), (900, 1000)))
        gains = {t: np.mean(bad >= t) - np.mean(good >= t) for t in range(quality.BINS) if np.mean(good >= t) <= loss}
        best = [t for t, g in gains.items() if g == max(gains.values())]
        assert found == (best[0] + best[-1]) / 2 / quality.BINS
    assert quality.calibrate(rated, labels.where("quality = 1")) == float("inf") == quality.calibrate(rated, None)


def test_few_labels_and_clashing_names(spark):
    good = [(i, "plain words that say nothing odd at all in this line " + str(i)) for i in range(40)]
    bad = [(100 + i, " ".join(f"w{j}$$ {i}{j}&&" for j in range(20))) for i in range(6)]
    names = "doc_id long, text string, anomaly string, features string, _anomaly string, i long, at long, rows long, cut string, part long, epochs long, rest long, _drop string, _host string, size string, taken string, source string"
    frame = spark.createDataFrame([(i, t, "a", "f", "_a", 1, 2, 3, "c", 4, 5, 6, "d", "h", "s", "t", "src") for i, t in good + bad], names)
    labels = spark.createDataFrame([(i, 1) for i in range(9)] + [(100, 0), (101, 0)], "doc_id long, quality int")
    kept = quality.keep_good(frame, labels)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == set(range(40))
    assert quality.keep_good(frame, labels.limit(0)).count() == 46 == quality.keep_good(frame, None).count()
    rated = quality.rate(frame, labels)
    assert rated.columns.count("anomaly") == 1 and {r.doc_id for r in rated.where("kept").collect()} == set(range(40))
    assert line_dedup.dedup_lines(frame).count() == 46 and line_dedup.dedup_lines(frame, broadcast_lines=-1).select("_drop", "_host").distinct().collect() == [("d", "h")]
    mixed = mixing.mix(frame)
    assert mixed.select("rows", "cut", "part", "epochs", "rest").distinct().collect() == [(3, "c", 4, 5, 6)] and mixed.schema["size"].dataType.simpleString() == "bigint"
    taken = mixing.repeat_mixed(frame)
    assert taken.columns == frame.columns and taken.select("size", "taken").distinct().collect() == [("s", "t")]


def test_labels_agree_with_verdicts(spark):
    d = "/root/testdata/sf0.01"
    rated = quality.op10_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    by = {(r.quality, r.kept): r["count"] for r in rated.groupBy("quality", "kept").count().collect()}
    assert by.get((0, True), 0) <= 0.05 * (by.get((0, True), 0) + by[0, False]) and by[1, True] >= 0.95 * (by[1, True] + by[1, False])
    assert rated.where(F.col("base_failed") & F.col("kept")).count() == 0


def test_topk_of_huge_and_empty_vectors(spark):
    rows = [(0, [3e9, 1.0]), (50, [1e30, -2.0]), (1, [-3e9, 5.0]), (2, []), (3, [1e17, 1e17]), (4, [0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    hold = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = []
    for i, q in ints:
        if i % 50 == 0:
            scores = sorted((-hold(sum(a * b for a, b in zip(q, v, strict=False))), j) for j, v in ints if j != i)[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == sorted(want)
    empty = spark.createDataFrame([(0, []), (50, []), (7, [])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(empty).collect()) == [(0, 1, 7, 0), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 7, 0)]


def test_topk_over_many_shards_and_rounds(spark, monkeypatch):
    for name, value in (("SEED_ROWS", 16), ("SHARD_BYTES", 4000), ("BLOCK_BYTES", 400), ("ROUND", 2)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(600, 12)), 2)
    x[300:] = x[:300] * 0.5 + x[rng.integers(0, 300, 300)]
    x[400:450] = x[400]
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    m = np.floor(256 * x)
    want = []
    for i in range(0, 600, 50):
        s = m @ m[i]
        want += [(i, n + 1, int(j), int(s[j])) for n, j in enumerate([j for j in np.lexsort((np.arange(600), -s)) if j != i][:5])]
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == sorted(want)


def test_max_score_with_a_score_to_beat():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 24)) * 60
    x = np.floor(centres[rng.integers(0, 8, 3000)] + rng.normal(size=(3000, 24)) * 12)
    shard = topk.Shard(x)
    for q in x[:40]:
        full = x @ q
        for least in (np.sort(full)[-5], np.sort(full)[-200], full.max() + 1, -np.inf):
            alive, score = topk.max_score(shard, q, 5, np.array([], int), least)
            assert (score == full[alive]).all()
            need = max(least, np.sort(full)[-5])
            assert set(np.flatnonzero(full >= need).tolist()) <= set(alive.tolist())
    walked = shard.postings(3, 10.0, True)
    assert sorted(walked.tolist()) == np.flatnonzero(x[:, 3] >= 10).tolist()
    assert sorted(shard.postings(3, 10.0, False).tolist()) == np.flatnonzero(x[:, 3] <= 10).tolist()


def test_very_long_texts_and_inner_names(spark):
    long = "wörd 😀 " * 150_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long + "end"), (2, 0, "user", long), (2, 1, "assistant", "short")]
    names = "conv_id long, turn long, role string, text string, opening string, key string, pair string, turns string, m string, c string, r string, _at long, _n long"
    got = chat.preferences(spark.createDataFrame([(*r, *"abcdefg", 1, 2) for r in rows], names)).collect()
    assert len(got) == 1 and got[0].chosen_id == 1 and got[0].n_prefix == 1 and got[0].prompt == f"<|im_start|>user\n{long}<|im_end|>\n"
    mask = got[0].chosen_mask[0]
    assert got[0].chosen[mask.start : mask.end] == long + "end<|im_end|>\n"
    mixed = mixing.mix(docs(spark, [(1, "w " * 300_000, "a"), (2, "x y z", "b"), (3, "w", "a")])).collect()
    assert {r.doc_id: r.size for r in mixed} == {1: 300_000, 2: 3, 3: 1} and all(r.taken <= 2 * r.size for r in mixed)


NAMES = ["_k1", "_k2", "_stays", "_n", "_row", "a.b", "c`d", "_lines", "_host", "_size"]


def test_inner_names_and_dots_in_every_stage(spark):
    import corpus_pipeline

    words = lambda i: " ".join(f"w{(j * 7919 + i) * 40503 % 1_000_003}" for j in range(40))
    rows = [(i, words(i), "en", "ab"[i % 2], 9) for i in range(20)] + [(3, words(3), "en", "b", 9), (30, words(4), "en", "a", 9), (None, words(77), "en", None, 1)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    more = plain
    for c in NAMES:
        more = more.withColumn(c, F.lit(c))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, more, "/root/testdata/sf0.001")
        assert out.columns == more.columns, name
        got = out.collect()
        assert got and all(tuple(r)[5:] == tuple(NAMES) for r in got), name
        want = stage(spark, plain, "/root/testdata/sf0.001").collect()
        if name != "mix sources":
            assert Counter(tuple(r)[:5] for r in got) == Counter(map(tuple, want)), name
    assert len(simhash.keep_one(more).collect()) == len(simhash.keep_one(plain).collect())


def test_components_beyond_a_double_s_range(spark):
    vecs = [(0, [1e307, 1.0]), (1, [1e307, 3.0]), (2, [-1e307, 3.0]), (3, [0.0, 2.0]), (4, [1.7e308, -1.7e308]), (50, [1.0, -1.0]), (100, [0.0, 1.5])]
    got = {}
    for r in topk.top_k(spark.createDataFrame(vecs, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = {i: [int(x) * 256 if abs(x) > 2**53 else int(np.floor(x * 256)) for x in v] for i, v in vecs}
    hold = lambda s: max(-(2**63), min(2**63 - 1, s))
    for q in (0, 50, 100):
        best = sorted((-hold(sum(a * b for a, b in zip(whole[q], whole[i], strict=True))), i) for i in whole if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_many_lines_of_one_host(spark):
    rows = spark.range(60_000).select(F.lit("hot").alias("host"), F.struct(F.xxhash64("id").alias("a"), F.xxhash64(F.lit(1), "id").alias("b")).alias("line"))
    few = rows.limit(3).withColumn("host", F.lit(None).cast("string"))
    got = {r.host: r for r in line_dedup.line_lists(rows.unionByName(few)).select("host", F.size("slots").alias("n"), F.aggregate("slots", F.lit(0), lambda s, x: s + F.size(x)).alias("lines")).collect()}
    assert (got["hot"].n, got["hot"].lines, got[None].n, got[None].lines) == (60_000, 60_000, 3, 3)
    placed = line_dedup.line_lists(rows.limit(500)).select(F.posexplode("slots").alias("slot", "lines")).select("slot", F.explode("lines").alias("line"))
    assert placed.count() == 500 and placed.where(F.pmod("line.a", F.lit(500)) != F.col("slot")).isEmpty()


def test_scores_for_any_kind_of_id(spark):
    for kind in ("smallint", "decimal(10,0)", "string"):
        docs = spark.createDataFrame([(1, "a b a"), (2, "a c"), (3, None)], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
        got = katz.score(docs, F.lit(True))
        assert got.schema["doc_id"].dataType.simpleString() == kind and got.count() == 3


def test_very_long_texts_and_clashing_names_through_spark(spark):
    long = " ".join(f"t{i * 40503 % 999_983}" for i in range(200_000))
    rows = [(1, long, "a"), (2, long + " end", "a"), (3, "short text of five words", "b"), (4, None, None)]
    some = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("fp", F.lit("x")).withColumn("_text", F.lit(1)).withColumn("hash", F.lit(2)).withColumn("spans", F.lit(3))
    assert {r.doc_id: r.component_id for r in jaccard.near_groups(some).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert len(simhash.near_groups(some).collect()) == 4
    found = secrets.scan_secrets(some.withColumn("text", F.concat("text", F.lit(" password = hunter22"))))
    assert {r.doc_id: r.n_assign for r in found.collect()} == {1: 1, 2: 1, 3: 1, 4: 0}
