import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wayfare.llm import simhash as S


def brute(fps, bits=4):
    """Least index reachable over links."""
    fps = np.array(fps, np.uint64)
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= bits):
            a, b = root(i), root(i + 1 + int(j))
            label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def print_of(text, n=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in (None, "", " \n", "One", "a b c", "A b c D", "É é x y z É", "x y\tz\x1cw \r\n a b", "a b c d e f g " * 40, "word " * 5000):
        assert S.fingerprint(text) == print_of(text)


def test_codewords_are_shared_within_two_bits():
    errors = S.golay_table()
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 23, 3000).astype(np.uint32)
    codes = [set(x) for x in S.fuzzy(words, errors).tolist()]
    assert {len(x) for x in codes} == {1, 6}
    for i in range(23):
        for j in range(i, 23):
            other = S.fuzzy(words ^ np.uint32((1 << i) | (1 << j)), errors).tolist()
            assert all(a & set(b) for a, b in zip(codes, other, strict=True))


def test_linked_fingerprints_share_a_key():
    rng = np.random.default_rng(6)
    errors = S.golay_table()
    a = rng.integers(0, 2**63, 500, dtype=np.uint64) * np.uint64(2)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, 4, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    ka, kb = ([set(k[p == i].tolist()) for i in range(len(a))] for p, k in (S.keys(a, errors), S.keys(b, errors)))
    assert all(x & y for x, y in zip(ka, kb, strict=True))


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(7)
    fps = list(rng.integers(0, 2**63, 150, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    for centre in fps[:6]:
        for n in (1, 2, 3, 4, 5, 6, 9):
            x = int(centre)
            for bit in rng.choice(64, n, replace=False):
                x ^= 1 << int(bit)
            fps.append(np.uint64(x))
    tight = int(fps[7])  # one group far over SMALL
    fps += [np.uint64(tight ^ (1 << int(i)) ^ (1 << int(j))) for i, j in rng.integers(0, 64, (400, 2))]
    return [int(x) for x in fps] + [int(x) for x in fps[:20]] + [0, 0]


def test_groups_against_brute_force(spark, clustered):
    ids = [3 * i + 5 for i in range(len(clustered))]
    want = dict(zip(ids, (ids[i] for i in brute(clustered)), strict=True))
    signed = [x - 2**64 if x >= 2**63 else x for x in clustered]
    frame = spark.createDataFrame(list(zip(ids, signed, strict=True)), "doc_id long, fp long")
    links = S.candidate_links(frame.select("fp").distinct().repartition(3))
    pairs = links.collect()
    assert all(bin((p.u ^ p.v) & (2**64 - 1)).count("1") <= 16 and p.u < p.v for p in pairs) and len(pairs) < 20000
    group = {r.node: r.root for r in S.components(links).collect()}
    least = {}
    for i, x in zip(ids, signed, strict=True):
        least[group.get(x, x)] = min(i, least.get(group.get(x, x), i))
    assert {i: least[group.get(x, x)] for i, x in zip(ids, signed, strict=True)} == want


def test_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect()
    want = brute([S.fingerprint(r.text) for r in docs])
    got = {r.doc_id: r for r in S.op4_simhash_golay(spark, d).collect()}
    assert [got[r.doc_id].component_id for r in docs] == [docs[i].doc_id for i in want]
    assert all(int(got[r.doc_id].fingerprint, 16) == S.fingerprint(r.text) and len(got[r.doc_id].fingerprint) == 16 for r in docs[:200])
    kept = S.keep_one(spark.read.parquet(f"{d}/documents.parquet"))
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({docs[i].doc_id for i in want})


def test_edges(spark):
    schema = "doc_id long, text string, fp string, u long"
    rows = [(4, None, "a", 1), (2, "", "a", 1), (None, " ", None, None), (9, "some words stand here now", "b", 2), (9, "some words stand here now", "b", 2), (1, "long " * 20000, "c", 3)]
    got = sorted((r.doc_id or 0, r.component_id) for r in S.near_groups(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 2), (1, 1), (2, 2), (4, 2), (9, 9), (9, 9)]
    kept = S.keep_one(spark.createDataFrame(rows, schema))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 9] and kept.columns == ["doc_id", "text", "fp", "u"]
    assert S.near_groups(spark.createDataFrame([], schema)).count() == 0
    assert S.components(spark.createDataFrame([(1, 2), (2, 3), (5, 4), (-7, 5)], "u long, v long")).agg(F.collect_set("root")).first()[0].sort() is None
