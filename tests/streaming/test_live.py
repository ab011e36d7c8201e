"""Live features against the batch operator, late and tied events, restarts, and a sink that holds no row twice."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import wayfare.plans.registry  # noqa: F401  (registers all plans before one is imported by itself)
from tests.conftest import SF
from wayfare.operators import asof
from wayfare.plans import streams
from wayfare.plans.features import splits
from wayfare.sources.tables import orders_as_events, scratch
from wayfare.streaming import asof as live
from wayfare.streaming import events as S
from wayfare.streaming import sink


def rows(df):
    return {r.event_id: tuple(None if x is None else round(float(x), 9) for x in r[1:]) for r in df.collect()}


def test_stream_equals_batch_across_a_restart(spark):
    events = splits(spark, SF)[0]
    got = rows(streams.live_features(spark, events, 5, 2))
    want = rows(asof.asof_features(events).select("event_id", *asof.FEATURES))
    assert len(want) > 500 and got == want


def test_ties_within_and_across_batches(spark):
    """Day-grained times: events of one time see nothing of each other, in one batch or in several."""
    events = orders_as_events(spark, SF).where("user_id <= 40").withColumn("vertical", F.col("item_id").cast("int") % 3)
    events = events.withColumn("event_id", F.xxhash64(*events.columns)).dropDuplicates(["event_id"]).withColumn("item_id", (F.col("item_id") % 50).cast("int")).withColumn("merchant_id", F.col("merchant_id").cast("int"))
    events = events.withColumn("price_at_event", F.col("price_at_event").cast("double")).cache()
    want = rows(asof.asof_features(events).select("event_id", *asof.FEATURES))
    where = scratch(spark, "ties")
    before = spark.conf.get(*streams.PROVIDER)
    spark.conf.set(*streams.PROVIDER)
    try:
        cut = events.agg(F.sort_array(F.collect_set("ts"))).first()[0]
        cut = cut[len(cut) // 2]
        for nr, part in enumerate((F.col("ts") < cut, (F.col("ts") == cut) & (F.col("event_id") % 2 == 0), (F.col("ts") == cut) & (F.col("event_id") % 2 != 0), F.col("ts") > cut)):
            events.where(part).select(*streams.COLUMNS).coalesce(1).write.mode("append").parquet(f"{where}/in")
        sides = [streams._drain(f(S.read_stream(spark, f"{where}/in", 1, S.LIVE_SCHEMA)), where, f.__name__, "append").drop("batch") for f in (live.user_features, live.item_features)]
    finally:
        spark.conf.set(streams.PROVIDER[0], before)
    got = rows(sides[0].join(sides[1], "event_id").select("event_id", *asof.FEATURES))
    assert {i for i in want if got[i] != want[i]} == set()


def test_records_keep_late_events_behind():
    one = (1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0)
    record = None
    for t in (10, 20, 20):
        assert live.known(record, t)[0] == {10: 0, 20: 1}[t]
        record = live.added(record, t, one)
    record = live.added(record, 15, one)  # late
    assert record[0] == 20 and live.known(record, 20)[0] == 2 and live.known(record, 21)[0] == 4
    assert live.known(record, 21)[-2:] == (10, 20) and live.known(record, 20)[-1] == 15


class Lost(Exception):
    pass


def test_replayed_batches_hold_no_row_twice(spark, monkeypatch):
    """The query is lost between write and commit, then between commit and its own checkpoint; readers see each row once."""
    where = scratch(spark, "replay")
    for nr in range(4):
        spark.range(nr * 100, nr * 100 + 100, 1, 2).select(F.col("id").alias("event_id")).write.mode("append").parquet(f"{where}/in")
    stream = lambda: spark.readStream.schema("event_id long").option("maxFilesPerTrigger", 2).parquet(f"{where}/in")
    real, lost = sink.commit, {}

    def commit(spark, nr, path, schema):
        if nr in (1, 2) and lost.setdefault((nr, "before"), True):
            lost[nr, "before"] = False
            assert sink.committed(spark, path, schema).where(f"batch = {nr}").isEmpty()
            raise Lost
        real(spark, nr, path, schema)
        if nr == 2 and lost.setdefault((nr, "after"), True):
            lost[nr, "after"] = False
            raise Lost

    monkeypatch.setattr(sink, "commit", commit)
    failed = 0
    for _ in range(6):
        try:
            out = streams._drain(stream(), where, "out", "append")
            break
        except Exception as e:
            assert "Lost" in str(e)
            failed += 1
    assert failed == 3 and sorted(r.event_id for r in out.collect()) == list(range(400))
    assert sink.committed_batch(spark, f"{where}/out") == 3 and [r.n for r in out.groupBy("batch").agg(F.count("*").alias("n")).collect()] == [100] * 4
    spark.range(5).select(F.col("id").alias("event_id")).write.parquet(f"{where}/out/data/batch=9")  # never committed
    assert sink.committed(spark, f"{where}/out", spark.range(0).select(F.col("id").alias("event_id")).schema).count() == 400


def test_empty_sink(spark):
    schema = spark.range(0).schema
    assert sink.committed_batch(spark, scratch(spark, "none")) == -1 and sink.committed(spark, scratch(spark, "none"), schema).columns == ["id", "batch"]


@pytest.mark.parametrize("name", ["st1_running_state", "st3_closed_sessions"])
def test_streams_keep_batch_numbers(spark, name):
    from wayfare.plans.registry import QUERIES

    assert QUERIES[name](spark, SF).count() > 0


def test_a_batch_exchanges_its_state_as_a_whole():
    import pandas as pd

    class State:
        def __init__(self):
            self.rows, self.calls = [], 0

        def exists(self):
            return bool(self.rows)

        def get(self):
            self.calls += 1
            return self.rows

        def put(self, rows):
            self.rows, self.calls = list(rows), self.calls + 1

        def appendList(self, rows):
            self.rows, self.calls = self.rows + list(rows), self.calls + 1

        def update(self, row):
            self.rows, self.calls = row, self.calls + 1

    class Handle:
        states = {}

        def getListState(self, name, schema):
            return self.states.setdefault(name, State())

        getValueState = getListState

    for side, own, count in ((live.UserSide(), "item_id", "user_distinct_items"), (live.ItemSide(), "user_id", "item_distinct_users")):
        handle = Handle()
        handle.states = {}
        side.init(handle)
        for batch in range(2):
            e = pd.DataFrame({"event_id": range(50), "user_id": 1, "item_id": 1, "t": range(batch * 50 + 1, batch * 50 + 51), "converts": 0, "price": 1.0, "vertical": 2.0, "merchant_id": 3.0})
            e[own] = range(50)
            out = next(side.handleInputRows((1,), iter([e]), None))
        assert list(out[count]) == [50] * 50 and sum(s.calls for s in handle.states.values()) <= 6


def one_by_one(events, own, partners):
    """Each event's sums by known() and added(), a record at a time: {event_id: (own sums, [the partners' rows and conversions])}."""
    records, met, out = {}, set(), {}
    for _, batch in events.groupby("batch"):
        for _, tied in batch.sort_values(["t", "event_id"]).groupby("t", sort=True):
            names = lambda e: [(p, e[own], e[p]) for p in partners if e[p] != live.MISSING or p == partners[0]]
            for e in tied.to_dict("records"):
                out[e["event_id"]] = (live.known(records.get(e[own]), e["t"]), {x[0]: live.known(records.get(x), e["t"]) for x in names(e)})
            for e in tied.to_dict("records"):
                price = e["price"] if e["price"] > 0 else 0.0
                pair = (e[own], e[partners[0]])
                change = (1.0, float(e["converts"]), float(pair not in met), float(price > 0), price, float(e["converts"] and price > 0), price * e["converts"])
                met.add(pair)
                for x in (e[own], *names(e)):
                    records[x] = live.added(records.get(x), e["t"], change)
    return out


class Kept:
    """A list of the state store, with the number of exchanges."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.calls += 1
        return list(self.rows)

    def put(self, rows):
        self.rows, self.calls = list(rows), self.calls + 1

    def appendList(self, rows):
        self.rows, self.calls = self.rows + list(rows), self.calls + 1


class Store(dict):
    def getListState(self, name, schema):
        return self.setdefault(name, Kept())


@pytest.mark.parametrize("own", ["user_id", "item_id"])
def test_a_bucket_of_keys_in_one_call_equals_one_record_at_a_time(own):
    """Many keys come in one call, with ties, late events, null ids and times before 1970; batches of few keys leave the other records as they are."""
    rng, n = np.random.default_rng(5), 3000
    batch = np.sort(rng.integers(0, 20, n))
    e = pd.DataFrame({"event_id": rng.permutation(n), "batch": batch, "t": (batch * 8 - 60 + rng.integers(-20, 20, n)) * 3_600_000_000, "user_id": rng.integers(0, 40, n) * 2**40, "item_id": rng.integers(0, 12, n)})
    e["vertical"], e["merchant_id"], e["converts"], e["price"] = e.item_id % 3, e.item_id % 4, rng.integers(0, 2, n), np.round(rng.random(n) * 50 - 5, 2)
    for c in ("user_id", "item_id", "vertical", "merchant_id"):
        e.loc[rng.random(n) < 0.05, c] = live.MISSING
    e.loc[rng.random(n) < 0.05, "price"] = np.nan
    e = e[(e.batch < 4) | (e[own] % 5 == 0)]  # later batches meet few of the keys
    side, store = {"user_id": live.UserSide, "item_id": live.ItemSide}[own](), Store()
    side.init(store)
    got, want = {}, one_by_one(e, own, side.partners)
    for _, b in e.groupby("batch"):
        calls = sum(s.calls for s in store.values())
        out = next(side.handleInputRows((0,), iter([b.iloc[:50].drop(columns="batch"), b.iloc[50:].drop(columns="batch")]), None))
        assert sum(s.calls for s in store.values()) - calls <= 4  # for all of the bucket's keys
        got |= {r.event_id: r for r in out.itertuples(index=False)}
    assert len(store["pairs"].rows) <= live.BLOBS and set(got) == set(want) == set(e.event_id)
    over = lambda a, b: a / b if b else None
    days = lambda t, x, i: (t - x[i]) / live.DAY if x[0] else None
    for r in e.to_dict("records"):
        (x, pairs), t, g = want[r["event_id"]], r["t"], got[r["event_id"]]
        rows = [x[0], x[1], over(x[1], x[0]), x[2], days(t, x, -1), days(t, x, -2)]
        if own == "user_id":
            pair, average = pairs["item_id"], over(x[4], x[3])
            rows += [average, over(x[6], x[5]), pair[0], pair[1], days(t, pair, -1)]
            rows += [over(pairs[p][0], x[0]) if p in pairs else None for p in ("vertical", "merchant_id")]
            rows += [over(0.0 if np.isnan(r["price"]) else r["price"], average) if average else None]
        assert [None if v != v else round(v, 9) for v in g[1:]] == [None if v is None else round(v, 9) for v in rows], r


def test_many_users_are_few_keys(spark):
    """A batch's keys of the state are as many as the buckets, however many users come."""
    where = scratch(spark, "many")
    for nr in range(2):
        e = spark.range(nr * 5000, nr * 5000 + 5000, 1, 1).select(F.col("id").alias("event_id"), F.timestamp_micros(F.col("id") * 1000).alias("ts"), (F.col("id") % 2500).alias("user_id"), (F.col("id") % 7).cast("int").alias("item_id"))
        e.select("*", F.when(F.col("event_id") % 2 == 0, 9).alias("event_type"), F.lit(2.0).alias("price_at_event"), F.lit(1).alias("vertical"), F.lit(None).cast("int").alias("merchant_id")).write.mode("append").parquet(f"{where}/in")
    before = spark.conf.get(*streams.PROVIDER)
    spark.conf.set(*streams.PROVIDER)
    try:
        out = streams._drain(live.user_features(S.read_stream(spark, f"{where}/in", 1, S.LIVE_SCHEMA), 16), where, "out", "append")
        state = spark.read.format("statestore").option("stateVarName", "totals").load(f"{where}/out-state")
        assert state.select("key").distinct().count() == 16
    finally:
        spark.conf.set(streams.PROVIDER[0], before)
    got = out.orderBy("event_id").collect()
    assert [r.event_id for r in got] == list(range(10000)) and all(r.user_event_count == r.event_id // 2500 for r in got)
    assert all(r.user_purchase_count == (r.user_event_count if r.event_id % 2 == 0 else 0) for r in got) and all(r.user_merchant_affinity is None for r in got)


def test_buckets_grow_with_events():
    assert live.buckets_for(0) == live.buckets_for(1000) == live.LEAST_BUCKETS and 36_000_000 / live.buckets_for(36_000_000) <= live.BUCKET_ROWS


def test_dealt_events_are_whole_and_few(monkeypatch):
    rng, n = np.random.default_rng(2), 5000
    e = {c: rng.integers(-9, 10**15, n) for c in live.ROW.names[:-1]}
    price = np.where(rng.random(n) < 0.1, np.nan, rng.random(n))
    table = pa.table({"bucket": pa.array(rng.integers(0, 5, n), pa.int32()), **e, "price": pa.array(price, from_pandas=True)})
    monkeypatch.setattr(live, "DEAL_ROWS", 2000)
    got = list(live.dealt(iter([*table.to_batches(700), pa.RecordBatch.from_pylist([], table.schema)])))
    assert [b.schema.names for b in got] == [["bucket", "rows"]] * len(got) and sum(b.num_rows for b in got) == 5 * len(got) == 15
    frames = [live._events(b.to_pandas()).assign(bucket=np.repeat(b["bucket"].to_numpy(), [len(x.as_py()) // live.ROW.itemsize for x in b["rows"]])) for b in got]
    pd.testing.assert_frame_equal(*(x[table.column_names].sort_values(["event_id", "t"]).reset_index(drop=True).astype({"bucket": "int64"}) for x in (pd.concat(frames), table.to_pandas())))
    assert list(live.dealt(iter([]))) == []


def test_more_events_come_in_more_files(spark):
    where = scratch(spark, "files")
    streams._files(spark, splits(spark, SF)[0], where, 2, range(2), 6)
    found = spark.read.parquet(f"{where}/in")
    assert len(found.inputFiles()) == 12 and found.count() == splits(spark, SF)[0].count()
