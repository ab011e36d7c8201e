"""Category tables of the towers: gradients by finite differences, falling loss, plans that don't grow, saved models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.operators import neural, towers
from wayfare.sources.tables import scratch


def test_gradients_of_a_batch_are_finite_differences():
    rng = np.random.default_rng(3)
    pair = (towers.Tower(3 + 2 * 2 + 1, 5, 4), towers.Tower(3 + 2 + 2, 5, 4))
    w = np.concatenate([t.start(rng) for t in pair]) + rng.normal(0, 0.1, sum(t.size for t in pair))
    f, g, e = rng.normal(size=(4, 3)), rng.normal(size=(5, 3)), rng.normal(size=(6, 2))
    users, items = {"c": rng.integers(0, 6, (4, 2))}, {"c": rng.integers(0, 6, (5, 1)), "x": np.hstack([rng.normal(size=(5, 2)), rng.normal(size=(5, 1)) - 3])}
    part = {"u": np.array([0, 1, 2, 3, 0, 2]), "i": np.array([0, 1, 2, 3, 4, 0]), "x": rng.normal(size=(6, 1))}
    known = rng.uniform(size=(6, 6)) < 0.2
    _, *grads = towers.batch_gradients(pair, w, f, g, e, users, items, part, 0.5, known)
    for value, grad in zip((w, f, g, e), grads, strict=True):
        for at in list(np.ndindex(value.shape))[::3]:
            old, h = value[at], 1e-6
            loss = []
            for x in (old + h, old - h):
                value[at] = x
                loss.append(towers.batch_gradients(pair, w, f, g, e, users, items, part, 0.5, known)[0])
            value[at] = old
            assert (loss[0] - loss[1]) / 2 / h == pytest.approx(grad[at] / 1, abs=2e-4)


def data(spark, merchants=7):
    """Users of a region like the merchants of its parity."""
    rng = np.random.default_rng(2)
    likes = [(int(u), int(i)) for u in range(40) for i in rng.choice(np.arange(0, 40, 2) + u % 2, 8, replace=False)]
    pairs = spark.createDataFrame([(u, i, [0.0], u % 2) for u, i in likes], "user_id long, item_id long, x array<double>, region int")
    items = spark.createDataFrame([(i, [0.5, float(-np.log(40))], i % 2 + 2 * (i % merchants)) for i in range(40)], "item_id long, x array<double>, merchant int")
    pairs = pairs.withColumn("c", F.array(towers.category("region", "region"))).drop("region")
    return pairs, items.withColumn("c", F.array(towers.category("merchant", "merchant"), towers.category("half", F.col("merchant") % 2))).drop("merchant")


@pytest.mark.parametrize("group", [200_000, 80])
def test_loss_falls_over_epochs_and_state_outlives_rounds(spark, monkeypatch, group):
    monkeypatch.setattr(neural, "GROUP_PAIRS", group)
    pairs, items = data(spark)
    losses = [towers.two_tower_loss(towers.fit_two_tower(pairs, items, dim=8, hidden=16, epochs=e, passes=2, batch=64), pairs, items, batch=64, batches=5) for e in (0, 1, 4)]
    assert losses[0] > losses[1] > losses[2]


def test_state_grows_from_round_to_round(spark, monkeypatch):
    pairs, items = data(spark)
    kept, real = [], towers.train_blocks

    def spy(*args, **how):
        state, weights = real(*args, **how)
        kept.append((state, weights))
        return state, weights

    monkeypatch.setattr(towers, "train_blocks", spy)
    for epochs in (1, 2):
        towers.fit_two_tower(pairs, items, dim=8, hidden=16, epochs=epochs, passes=1, batch=64)
    sums = [state.select(F.aggregate(F.slice("f", F.size("f") / 2 + 1, F.size("f") / 2), F.lit(0.0), lambda s, x: s + x).alias("s")).agg(F.sum("s")).first()[0] for state, _ in kept]
    halves = [w[len(w) // 2 :].sum() for _, w in kept]
    assert sums[1] > sums[0] * 1.05 and halves[1] > halves[0] * 1.05  # Adagrad's sums go on where the round before ended


def test_plan_does_not_grow_with_merchants(spark):
    from wayfare.plans import registry  # noqa: F401
    from wayfare.plans import retrieval

    def size(merchants):
        e = retrieval.splits(spark, "/root/testdata/sf0.001")[1].withColumn("merchant_id", (F.col("item_id") % merchants).cast("int"))
        pairs, items, users = retrieval.tower_data(e)
        return [len(df._jdf.queryExecution().analyzed().toString()) for df in (users,)], items.agg(F.max(F.size("x"))).first()[0], items.agg(F.max(F.size("c"))).first()[0]

    few, many = size(3), size(100)
    assert abs(few[0][0] - many[0][0]) < 200 and few[1:] == many[1:]


def test_saved_towers_encode_alike_and_unknown_categories_are_null_vectors(spark):
    pairs, items = data(spark)
    model = towers.fit_two_tower(pairs, items, dim=8, hidden=16, epochs=1, passes=1, batch=64)
    path = scratch(spark, "towers")
    towers.save_towers(model, path)
    again = towers.load_towers(spark, path)
    rows = items.select(F.col("item_id").alias("id"), F.slice("x", 1, 1).alias("x"), "c")
    one, two = ({r.id: r.embedding for r in m.encode(rows, 1).collect()} for m in (model, again))
    assert one == two and len(one) == 40
    odd = rows.withColumn("c", F.array(F.lit(1).cast("long"), towers.category("half", F.lit(None).cast("int")))).unionByName(rows.limit(1).withColumn("id", F.lit(999).cast("long")))
    assert again.encode(odd, 1).count() == 40  # 999 has no id vector
    spark.read.parquet(f"{path}/weights").withColumn("version", F.lit("1")).write.parquet(f"{path}-old/weights")
    with pytest.raises(ValueError, match="version"):
        towers.load_towers(spark, f"{path}-old")


def test_rows_are_encoded_in_tasks_of_bounded_size(spark, monkeypatch):
    pairs, items = data(spark)
    model = towers.fit_two_tower(pairs, items, dim=8, hidden=16, epochs=0)
    rows = items.select(F.col("item_id").alias("id"), F.slice("x", 1, 1).alias("x"), "c").localCheckpoint()
    whole = {r.id: r.embedding for r in model.encode(rows, 1).collect()}
    monkeypatch.setattr(towers, "ENCODE_ROWS", 4, raising=False)
    dealt = model.encode(rows, 1)
    assert dealt.groupBy(F.spark_partition_id().alias("p")).count().count() > 5
    got = {r.id: r.embedding for r in dealt.collect()}
    assert got.keys() == whole.keys() and all(got[i] == pytest.approx(whole[i]) for i in whole)
