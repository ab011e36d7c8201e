"""Lists that are cut before they meet users or sessions equal those of all users times all items."""

import numpy as np
import pytest

from wayfare.operators import retrieval as R


def test_global_lists_of_unseen_items(spark):
    rng = np.random.default_rng(0)
    scores = {i: float(np.round(s, 1)) for i, s in enumerate(rng.uniform(size=40))}
    seen = [(u, int(i)) for u in range(12) for i in rng.choice(40, int(rng.integers(1, 38)), replace=False)] + [(99, i) for i in range(40)]
    got = {}
    for r in R.global_unseen(spark.createDataFrame(list(scores.items()), "item_id int, score double"), spark.createDataFrame(seen + seen[:50], "user_id long, item_id int"), 5).collect():
        got.setdefault(r.user_id, []).append((r["rank"], r.item_id))
    for u in range(12):
        own = {i for v, i in seen if v == u}
        want = sorted((i for i in scores if i not in own), key=lambda i: (-scores[i], i))[:5]
        assert sorted(got.get(u, [])) == [(n + 1, i) for n, i in enumerate(want)]
    assert 99 not in got


@pytest.mark.parametrize("whole", [False, True])
def test_cold_start_equals_all_sessions_times_all_items(spark, whole):
    rng = np.random.default_rng(1)
    pop = {i: float(np.round(s, 2)) for i, s in enumerate(rng.uniform(size=30))}
    sessions = {s: sorted({int(i) for i in rng.choice(30, 3)}) for s in range(8)} | {50: [7]}
    aff = {(s, int(i)): float(np.round(x, 3)) for s in range(8) for i, x in zip(rng.choice(30, 30 if whole else 6, replace=False), rng.uniform(0.1, 1, 30), strict=False)}
    aff[0, 999] = 5.0  # not in the list
    got = {}
    frame = R.cold_start(spark.createDataFrame([(s, i, x) for (s, i), x in aff.items()], "session int, item_id int, score double"), spark.createDataFrame(list(pop.items()), "item_id int, score double"), spark.createDataFrame([(s, i) for s, v in sessions.items() for i in v], "session int, item_id int"), 6)
    for r in frame.collect():
        got.setdefault(r.session, []).append((r["rank"], r.item_id, r.score))
    low, high = min(pop.values()), max(pop.values())
    for s, own in sessions.items():
        a = {i: aff.get((s, i), 0.0) for i in pop}
        l, h = min(a.values()), max(a.values())
        score = {i: round(0.7 * ((a[i] - l) / (h - l) if h > l else 0.0) + 0.3 * (pop[i] - low) / (high - low), 9) for i in pop if i not in own}
        want = sorted(score, key=lambda i: (-score[i], i))[:6]
        assert [x[1] for x in sorted(got[s])] == want and all(abs(x[2] - score[x[1]]) < 1e-8 for x in got[s])


def test_blocks_are_put_together(spark):
    import numpy as np

    from wayfare.operators import vectors

    x = np.random.default_rng(5).integers(-3, 4, (300, 4)).astype(float)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>").repartition(12)
    found = vectors.checkpointed(vectors.blocks(v), "many")
    one = vectors.full(found).collect()
    assert found.count() > 1 and len(one) == 1 and one[0].n == 300
    ids, rows = np.frombuffer(one[0].ids, np.int64), np.frombuffer(one[0].matrix).reshape(300, 4)
    assert sorted(ids) == list(range(300)) and (rows == x[ids]).all()
    assert vectors.full(found.limit(0)).count() == 0
    got = [(r.query, r.id) for r in vectors.inner_topk(v.where("id < 40"), v, 3, None).orderBy("query", "rank").collect()]
    s = x[:40] @ x.T
    s[np.arange(40), np.arange(40)] = -np.inf
    assert got == [(q, int(i)) for q in range(40) for i in sorted(range(300), key=lambda i: (-s[q, i], i))[:3]]
