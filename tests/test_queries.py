"""Every query with an SQL twin gives the twin's rows; the others run and keep their columns."""

import glob
import os

import duckdb
import pytest

from tests.conftest import SF
from wayfare.plans.registry import ORACLES, QUERIES
from wayfare.plans.retrieval import listed


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(found, cols):
    return sorted(repr([x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x for x in (r[c] for c in cols)]) for r in found)


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n != "fil2_k_core"))
def test_twin(spark, con, name):
    found = con.execute(ORACLES[name])
    cols = sorted(c[0] for c in found.description)
    want = [dict(zip([c[0] for c in found.description], r, strict=True)) for r in found.fetchall()]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == cols
    assert rows((r.asDict() for r in got.collect()), cols) == rows(want, cols)


def test_core_twin_where_a_core_is_left(spark):
    d, con = "/root/testdata/sf0.01", duckdb.connect()
    for name in ("orders", "lineitem"):
        con.execute(f"create view {name} as select * from '{d}/{name}.parquet'")
    cols = ["user_id", "n", "items"]
    want = [dict(zip(cols, r, strict=True)) for r in con.execute(f"SELECT user_id, n, items FROM ({ORACLES['fil2_k_core']})").fetchall()]
    assert want and rows((r.asDict() for r in QUERIES["fil2_k_core"](spark, d).collect()), cols) == rows(want, cols)


def ranks_hold(got, by, k):
    """Ranks run from 1 without gaps, scores fall, and no item comes twice."""
    lists = {}
    for r in got:
        lists.setdefault(r[by], []).append((r["rank"], r["score"], r["id"] if by == "query" else r["item_id"]))
    assert lists
    for rows in lists.values():
        rows.sort()
        assert [x[0] for x in rows] == list(range(1, len(rows) + 1)) and len(rows) <= k and len({x[2] for x in rows}) == len(rows)
        assert all(a[1] >= b[1] for a, b in zip(rows, rows[1:], strict=False))
    return lists


@pytest.mark.parametrize(("name", "by", "k"), [("rk3_pairwise_ranker", "user_id", 10), ("rk3_listwise_ranker", "user_id", 10), ("md6_bpr_topk", "user_id", 10), ("tk6_index_topk", "query", 10), ("tk6_graph_topk", "query", 10)])
def test_lists(spark, name, by, k):
    lists = ranks_hold(QUERIES[name](spark, SF).collect(), by, k)
    if by == "query":
        n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
        assert set(lists) == {i for i in range(n) if i % 100 == 0} and all(q not in {x[2] for x in rows} and len(rows) == k for q, rows in lists.items())
    else:
        users = {r.user_id for r in QUERIES["fil4_temporal_split"](spark, SF).join(spark.read.parquet(f"{SF}/events.parquet"), "event_id").where("split = 'train'").select("user_id").distinct().collect()}
        assert set(lists) <= users and (name != "md6_bpr_topk" or set(lists) == users)


def test_fused_lists_with_learnt_sources(spark):
    seen = {(r.user_id, r.item_id) for r in QUERIES["src1_typed_events"](spark, SF).join(QUERIES["fil4_temporal_split"](spark, SF), "event_id").where("split = 'train'").select("user_id", "item_id").distinct().collect()}
    for name in ("sv2_four_sources", "fu3_index_source"):
        got = QUERIES[name](spark, SF).collect()
        assert got and not {(r.user_id, r.item_id) for r in got} & seen
        assert max(r.n_sources for r in got) == 4 and max(r.position for r in got) <= 25 and all(r.fused <= 4 / 61 + 1e-9 for r in got)


def test_expected_rows_of_lists(spark):
    train = spark.createDataFrame([(u, i) for u in range(9) for i in range(u + 1)], "user_id long, item_id int")
    assert 45 + 8 * 4 * 30 <= listed(train, 4) <= 45 + 10 * 4 * 30


def test_bootstrap_holds_the_lift(spark):
    lift, (one,) = QUERIES["ab4_lift"](spark, SF).first(), QUERIES["ab3_bootstrap"](spark, SF).collect()
    named = one.asDict()
    low, high = named["lower"], named["upper"]
    assert low <= lift.absolute <= high or low == high


def test_contributions_add_up(spark):
    rows = QUERIES["rk4_shapley_values"](spark, SF).collect()
    assert rows
    lists = {}
    for r in rows:
        lists.setdefault((r.user_id, r.item_id), []).append((r.place, abs(r.value)))
        assert abs(r.base - rows[0].base) < 1e-9
    assert all([p for p, _ in sorted(x)] == list(range(len(x))) and all(a[1] >= b[1] - 1e-12 for a, b in zip(sorted(x), sorted(x)[1:], strict=False)) for x in lists.values())
    got = QUERIES["rk5_listwise_gains"](spark, SF).collect()
    assert abs(sum(r.importance for r in got) - 1) < 1e-6 and all(r.importance >= 0 for r in got)
    assert QUERIES["rk4_tree_explanations"](spark, SF).where("place > 1").isEmpty()


def test_index_reports(spark):
    one = QUERIES["vx3_index_benchmark"](spark, SF).first()
    assert 0.9 <= one.recall <= 1 and one.probed <= one.lists and one.vectors == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    both = {r["index"]: r for r in QUERIES["vx3_index_comparison"](spark, SF).collect()}
    assert set(both) == {"graph", "lists"} and all(r.recall >= 0.9 for r in both.values())


def test_every_model_has_all_users(spark):
    rows = {r.model: r for r in QUERIES["ev14_every_model"](spark, SF).collect()}
    assert set(rows) == {"popularity", "trending", "contextual", "item_cf", "als", "bpr", "two_tower"}
    assert len({r.users for r in rows.values()}) == 1 and all(0 <= r.ndcg_10 <= 1 and r.recall_5 <= r.recall_10 <= r.recall_20 for r in rows.values())
    two = {r.model: r for r in QUERIES["ev14_model_table"](spark, SF).collect()}
    assert all(tuple(two[m]) == tuple(rows[m]) for m in two)


def test_vectors_come_back(spark):
    from wayfare.operators import retrieval as R

    rows = spark.createDataFrame([(1, [1.5, -2.25]), (2, None), (3, [])], "id long, v array<float>")
    text = rows.select("id", R.vector_text(rows.v).alias("t"))
    assert {r.id: r.t for r in text.collect()} == {1: "AADAPwAAEMA=", 2: None, 3: ""}
    assert {r.id: r.v for r in text.select("id", R.text_vector(text.t).alias("v")).collect()} == {1: [1.5, -2.25], 2: None, 3: []}


def test_jobs_end_in_an_experiment(spark):
    got = QUERIES["job_experiment"](spark, SF).collect()
    assert got and all(x == x for r in got for x in r if isinstance(x, float))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["item_id", "score"] and e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())


def test_cf_lists_are_made_once(spark):
    from wayfare.plans.quality import recommendations

    lists = recommendations(spark, SF)[3]
    plan = lists._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and lists.groupBy("user_id").count().where("count > 20").isEmpty()
