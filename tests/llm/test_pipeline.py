"""The pipeline against a brute-force version of each stage's contract, stage by stage."""

from collections import Counter

import numpy as np

import corpus_pipeline as P
from tests.llm.test_jaccard import brute
from wayfare.llm import packing
from wayfare.llm.encode import Encoder

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = P.quality_rules(spark, docs, SF)
    before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in kept.collect()}
    assert all(before[i] == r for i, r in after.items()) and kept.columns == docs.columns
    good = [i for i in before if labels.get(i) == 1]
    assert sum(i in after for i in good) >= 0.9 * len(good)

    lined = P.drop_lines(spark, kept, SF)
    rows = {r.doc_id: r for r in lined.collect()}
    pages, total = Counter(), Counter()
    for source, text in {(r.source, r.text) for r in after.values()}:
        total[source] += 1
        for line in {x.strip(" \t\n\x0b\x0c\r") for x in text.split("\n")} - {""}:
            pages[source, line] += 1
    for i, r in after.items():
        want = [x for x in r.text.split("\n") if not ((n := pages[r.source, x.strip(" \t\n\x0b\x0c\r")]) >= 3 and n > 0.05 * total[r.source])]
        assert rows[i].text == "\n".join(want) and rows[i].n_chars == (len(rows[i].text) if len(want) < len(r.text.split("\n")) else r.n_chars)

    single = P.near_dedup(spark, lined, SF)
    order = sorted(rows)
    roots = brute([rows[i].text for i in order])
    assert sorted(r.doc_id for r in single.collect()) == sorted({order[j] for j in roots})

    mixed = P.mix_sources(spark, single, SF)
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) <= set(r.doc_id for r in single.collect()) and max(times.values()) == 2 and mixed.columns == docs.columns

    e = Encoder(added=True)
    text = {r.doc_id: r.text for r in single.collect()}
    out = P.run(spark, SF).collect()
    tokens = Counter()
    for r in out:
        tokens[r.doc_id] += r.length
    assert tokens == Counter({i: n * (len(e.ids(text[i])) // 4 + 1) for i, n in times.items()})
    bins = len({r.sequence_id for r in out})
    assert bins <= np.ceil(sum(tokens.values()) / packing.CAPACITY) * 1.1 + 1
    assert P.run.__module__ == "corpus_pipeline" and [n for n, _ in P.STAGES][0] == "quality rules"


ODD = "doc_id long, text string, lang string, source string, n_chars long, size string, n_lines string, kept string, root string, k1 string, _key string, block string"


def odd_docs(spark):
    """Nulls, blanks, repeated rows and ids, ties, a very long text, and columns with names that stages use inside."""
    words = lambda n, k: " ".join(f"w{(i * 7919 + k) * 40503 % 1_000_003}" for i in range(n))
    rows = [(i, words(40, 3 + i), "en", "ab"[i % 2], 9) for i in range(30)]
    rows += [(3, words(40, 6), "en", "b", 9), (3, "another text " + words(30, 99), "en", "b", 9), (3, "another text " + words(30, 99), "en", "b", 9), (None, words(40, 500), None, None, None)]
    rows += [(100, None, None, "a", None), (101, "", "en", None, 0), (102, " \n\t", "en", "a", 3), (103, words(60_000, 17), "en", "a", 9), (104, "few words", "en", "a", 9)]
    return spark.createDataFrame([(*r, "s", "l", "k", "r", "1", "y", "b") for r in rows], ODD)


def test_stages_keep_columns_and_survive_odd_rows(spark):
    docs = odd_docs(spark)
    n = docs.count()
    for name, stage in P.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        got = out.collect()
        assert all((r.size, r.n_lines, r.kept, r.root, r.k1, r["_key"], r.block) == ("s", "l", "k", "r", "1", "y", "b") for r in got), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        ids = Counter(r.doc_id for r in got)
        if name == "quality rules":
            assert not {100, 101, 102, 104} & set(ids) and ids[103] == 1 and ids[None] == 1
        elif name == "line dedup":
            assert len(got) == n and next(r for r in got if r.doc_id == 100).text is None
        elif name == "near dedup":
            assert sum(ids[i] for i in (100, 101, 102)) == 1 and ids[3] == 2 and ids[None] == 1 and ids[103] == 1
        else:
            assert not {100, 101, 102} & set(ids) and max(ids[i] for i in range(4, 30)) <= 2
    pieces = P.pack_sequences(spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()} and sum(r.doc_id == 3 for r in pieces) == 4
    assert P.pack_sequences(spark, docs.limit(0), SF).count() == 0
