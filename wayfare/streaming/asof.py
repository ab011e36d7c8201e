"""Point-in-time features as a stream: keyed state is read before the event that changes it.

Users and items are two keyed states.  Each record holds its sums twice: up to its last time, and strictly before it,
so that events of one time don't see each other, in whichever batches they come.  Late events read what was known
before the record's last time, are added to both sums, and never move a time back.

known() and added() say so for one record and one event; fold() does the same for many records and a batch's events as
arrays.  State is dealt over buckets of users or items, and a bucket's records are a list of column blobs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wayfare.functions.expr import DAY, converts

#: What a record sums: rows, conversions, distinct partners, priced rows, prices, priced conversions, their prices; then its first and last time, 0 while there are no rows.
SUMS = 7
#: What records of pairs sum: rows and conversions.
PAIR_SUMS = 2
USER_FEATURES = (
    "user_event_count long, user_purchase_count long, user_conversion_rate double, user_distinct_items long, user_days_since_last double, user_tenure_days double, user_avg_interaction_price double, user_avg_order_value double, "
    "ui_prior_events long, ui_prior_purchases long, ui_days_since_last double, user_category_affinity double, user_merchant_affinity double, price_ratio_to_user_avg double"
)
ITEM_FEATURES = "item_event_count long, item_purchase_count long, item_conversion_rate double, item_distinct_users long, item_days_since_last double, item_age_days double"
NONE = (0.0,) * (SUMS + 2)
#: Keys of the state, where events can't be counted before; a checkpoint holds for one number of them.
BUCKETS = 1024
#: Events of a bucket in all batches, and the buckets of few events.
BUCKET_ROWS, LEAST_BUCKETS = 32_768, 64
#: Blobs of a list before it is written as one.
BLOBS = 8
#: Stands for a null id.
MISSING = -(2**63)
#: An event as bytes, and how many are dealt to buckets at a time.
ROW = np.dtype([(c, "int64") for c in ("event_id", "t", "user_id", "item_id", "vertical", "merchant_id", "converts")] + [("price", "float64")])
DEAL_ROWS = 131_072


def known(record: tuple | None, t: int) -> tuple:
    """A record's sums as an event of time t sees them."""
    return NONE if record is None else tuple(record[2]) if t > record[0] else tuple(record[1])


def added(record: tuple | None, t: int, change: tuple) -> tuple:
    """The record with an event of time t."""
    plus = lambda x: (*(a + b for a, b in zip(x[:SUMS], change, strict=True)), float(min(x[-2], t) if x[0] else t), float(max(x[-1], t) if x[0] else t))
    if record is None:
        return t, NONE, plus(NONE)
    at, before, upto = record
    if t > at:
        return t, tuple(upto), plus(upto)
    return at, plus(before) if t < at else tuple(before), plus(upto)


def _plus(sums: np.ndarray, change: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """sums with what rows from `first` to `last` add; a change without rows adds nothing."""
    k, some, any_ = change.shape[1], sums[:, 0] > 0, change[:, 0] > 0
    low = np.where(some & any_, np.minimum(sums[:, k], first), np.where(any_, first, sums[:, k]))
    high = np.where(some & any_, np.maximum(sums[:, k + 1], last), np.where(any_, last, sums[:, k + 1]))
    return np.column_stack([sums[:, :k] + change, low, high])


class Folded:
    """Records after a batch: what its rows saw, which of them are the first of their group, and the records that changed.

    `rows` are groups' numbers of rows in the order of their times t, `held` those of records, the latest of a group last.
    """

    def __init__(self, held: np.ndarray, at: np.ndarray, before: np.ndarray, upto: np.ndarray, rows: np.ndarray, t: np.ndarray, change: np.ndarray) -> None:
        n, blank = len(held), np.zeros((1, change.shape[1] + 2))
        at, before, upto = np.append(at, MISSING), np.vstack([before, blank]), np.vstack([upto, blank])  # record -1 is none
        groups = np.concatenate([held, rows])
        order = np.argsort(groups, kind="stable")
        group = np.cumsum(np.diff(groups[order], prepend=groups[order[0]]) != 0)
        old = order < n
        record = np.full(group[-1] + 1, -1)
        record[group[old]] = order[old]
        row, group = order[~old] - n, group[~old]
        when, place = t[row], np.arange(len(row))
        opens = np.append(True, group[1:] != group[:-1])
        begin = np.maximum.accumulate(np.where(opens, place, 0))
        run = np.maximum.accumulate(np.where(opens | np.append(True, when[1:] != when[:-1]), place, 0))  # first of its time
        r = record[group]
        sums = pd.DataFrame(change[row]).groupby(group, sort=False).cumsum().to_numpy()  # compensated, group by group
        earlier = np.where((run > begin)[:, None], sums[run - 1], 0.0)
        seen = _plus(np.where((when > at[r])[:, None], upto[r], before[r]), earlier, when[begin], when[run - 1])
        self.seen, self.fresh = np.empty_like(seen), np.empty(len(row), bool)
        self.seen[row], self.fresh[row] = seen, opens & (r < 0)

        end = np.flatnonzero(np.append(opens[1:], True))
        r, first, last, total = r[end], when[begin[end]], when[end], sums[end]
        self.last, self.had = row[end], r >= 0  # a row of each changed group, and whether it had a record
        self.at, self.upto = np.maximum(at[r], last), _plus(upto[r], total, first, last)
        self.before = np.where((last < at[r])[:, None], _plus(before[r], total, first, last), seen[end])
        others = np.ones(len(record), bool)
        others[group] = False
        self.kept = record[others]


def _numbers(*columns: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the groups of (records' values, rows' values) of some columns."""
    code = 0
    for held, rows in columns:
        one, values = pd.factorize(np.concatenate([held, rows]))
        code = code * len(values) + one
    return code[: len(columns[0][0])], code[len(columns[0][0]) :]


def _packed(columns: dict[str, np.ndarray]) -> bytes:
    table, out = pa.table(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


class Records:
    """A bucket's records in a list of blobs: each has the records that a batch changed, and the latest of a key holds.

    `ids` name a record; without sums only new ones are written.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str, ids: dict[str, str], sums: int) -> None:
        self.state, self.ids, self.sums = handle.getListState(name, "columns BINARY"), ids, sums
        self.names = [f"{x}{i}" for x in ("before", "upto") for i in range(sums + 2)] if sums else []

    def load(self) -> None:
        blobs = [b for (b,) in self.state.get()] if self.state.exists() else []
        tables = [pa.ipc.open_stream(pa.py_buffer(bytes(b))).read_all() for b in blobs]
        kinds = self.ids | ({"at": "int64"} | dict.fromkeys(self.names, "float64") if self.sums else {})
        self.columns = {c: np.concatenate([np.empty(0, k), *(x[c].to_numpy() for x in tables)]) for c, k in kinds.items()}
        self.sizes = [x.num_rows for x in tables]

    def fold(self, ids: dict[str, np.ndarray], t: np.ndarray, change: np.ndarray) -> Folded:
        """Rows with these ids at t meet their records; what changes is written."""
        held, rows = _numbers(*((self.columns[c], ids[c]) for c in self.ids))
        n, width = len(held), change.shape[1] + 2
        if self.sums:
            both = np.column_stack([self.columns[c] for c in self.names])
            f = Folded(held, self.columns["at"], both[:, :width], both[:, width:], rows, t, change)
        else:
            f = Folded(held, np.full(n, MISSING), np.zeros((n, width)), np.zeros((n, width)), rows, t, change)
        use = slice(None) if self.sums else ~f.had
        new = {c: ids[c][f.last[use]] for c in self.ids} | ({"at": f.at} | dict(zip(self.names, np.hstack([f.before, f.upto]).T, strict=True)) if self.sums else {})
        size = len(new[next(iter(self.ids))])
        if not self.sizes or len(self.sizes) >= BLOBS or sum(self.sizes[1:]) + size > self.sizes[0]:
            left = f.kept if self.sums else slice(None)
            self.state.put([(_packed({c: np.concatenate([self.columns[c][left], x]) for c, x in new.items()}),)])
        elif size:
            self.state.appendList([(_packed(new),)])
        return f


def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events as (bucket, the bytes of some of its events), so that the shuffle and the processor take few rows."""

    def one() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        bucket = table["bucket"].to_numpy()
        order = np.argsort(bucket, kind="stable")
        rows, bucket = np.empty(len(order), ROW), bucket[order]
        for c in ROW.names:
            rows[c] = table[c].to_numpy()[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        return pa.record_batch({"bucket": bucket[cuts], "rows": pa.array([x.tobytes() for x in np.split(rows, cuts[1:])], pa.binary())})

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= DEAL_ROWS:
            yield one()
            held, size = [], 0
    if held:
        yield one()


def _events(frame: pd.DataFrame) -> pd.DataFrame:
    """The events of a processor's frame, as they are or dealt."""
    return pd.DataFrame(np.frombuffer(b"".join(frame["rows"]), ROW)) if "rows" in frame else frame


def _days(t: np.ndarray, seen: np.ndarray, place: int) -> np.ndarray:
    return np.where(seen[:, 0] > 0, (t - seen[:, place]) / DAY, np.nan)


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(len(a), np.nan), where=b > 0)


class AsOf(StatefulProcessor):
    """One side of the features, of `own` ids; records of pairs are made with `partners`, of which the first are counted."""

    own: str
    partners: tuple[str, ...]
    pair_sums: int
    fields: list[list[str]]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = Records(handle, "totals", {"own": "int64"}, SUMS)
        self.pairs = Records(handle, "pairs", {"own": "int64", "key": "int64", "map": "int8"}, self.pair_sums)

    def features(self, t: np.ndarray, seen: np.ndarray, price: np.ndarray, pairs: list) -> list[np.ndarray]:
        """What rows saw of their own record, and (whether there is one, what they saw) of each partner's."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat([_events(x) for x in rows]).sort_values(["t", "event_id"], kind="stable")  # one bucket's rows of one batch
        whole = lambda c: batch[c].to_numpy("int64")
        t, own, size = whole("t"), whole(self.own), len(batch)
        price, bought = batch["price"].to_numpy("float64"), batch["converts"].to_numpy("float64")
        paid = np.where(price > 0, price, 0.0)
        self.totals.load()  # a list is read once and written once
        self.pairs.load()

        # A null partner counts as one; of others, nothing is recorded.
        keys = [whole(c) for c in self.partners]
        there = [np.arange(size) if i == 0 else np.flatnonzero(k != MISSING) for i, k in enumerate(keys)]
        row = np.concatenate(there)
        ids = {"own": own[row], "key": np.concatenate([k[i] for k, i in zip(keys, there, strict=True)]), "map": np.repeat(np.arange(len(keys), dtype="int8"), [len(i) for i in there])}
        pairs = self.pairs.fold(ids, t[row], np.column_stack([np.ones(len(row)), bought[row]]))
        # A pair counts as a partner from its earliest event on.
        change = np.column_stack([np.ones(size), bought, pairs.fresh[:size], price > 0, paid, bought * (price > 0), paid * bought])
        seen = self.totals.fold({"own": own}, t, change).seen

        found, at = [], 0
        for i in there:
            of, sums = np.zeros(size, bool), np.zeros((size, PAIR_SUMS + 2))
            of[i], sums[i] = True, pairs.seen[at : at + len(i)]
            found.append((of, sums))
            at += len(i)
        ids = whole("event_id")
        out = {"event_id": pd.arrays.IntegerArray(ids, ids == MISSING)}
        for (name, kind), x in zip(self.fields, self.features(t, seen, np.where(np.isnan(price), 0.0, price), found), strict=True):
            out[name] = x.astype("int64") if kind == "long" else x
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def _fields(ddl: str) -> list[list[str]]:
    return [x.split() for x in ddl.split(", ")]


class UserSide(AsOf):
    """A user's records: themselves, and those with each item, vertical and merchant."""

    own, partners, pair_sums, fields = "user_id", ("item_id", "vertical", "merchant_id"), PAIR_SUMS, _fields(USER_FEATURES)

    def features(self, t, seen, price, pairs):
        n, conv, items, priced, prices, bought, paid = seen.T[:SUMS]
        (_, pair), *others = pairs
        average = _over(prices, priced)
        return [n, conv, _over(conv, n), items, _days(t, seen, -1), _days(t, seen, -2), average, _over(paid, bought), pair[:, 0], pair[:, 1], _days(t, pair, -1), *(np.where(of, _over(x[:, 0], n), np.nan) for of, x in others), _over(price, average)]


class ItemSide(AsOf):
    """An item's records: itself, and which users it has met."""

    own, partners, pair_sums, fields = "item_id", ("user_id",), 0, _fields(ITEM_FEATURES)

    def features(self, t, seen, price, pairs):
        n, conv, users = seen.T[:3]
        return [n, conv, _over(conv, n), users, _days(t, seen, -1), _days(t, seen, -2)]


def buckets_for(rows: int) -> int:
    """As many buckets as so many events need; what a task holds doesn't grow with the events."""
    return max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))


def _dealt(events: DataFrame, own: str, buckets: int) -> DataFrame:
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(MISSING)).alias(c)
    bucket = F.pmod(F.xxhash64(own), F.lit(buckets)).cast("int").alias("bucket")
    bought = F.coalesce(converts().cast("int"), F.lit(0)).alias("converts")
    rows = events.select(bucket, *map(whole, ("event_id", "user_id", "item_id", "vertical", "merchant_id")), F.unix_micros("ts").alias("t"), bought, F.col("price_at_event").cast("double").alias("price"))
    return rows.mapInArrow(dealt, "bucket int, rows binary")


def user_features(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(event_id, what was known of its user, and of the user with its item, before the event) of a stream of events.

    Undefined values are null; a task holds one bucket's rows of one batch and its records; state lies in the state store.
    """
    return _dealt(events, "user_id", buckets).groupBy("bucket").transformWithStateInPandas(UserSide(), f"event_id long, {USER_FEATURES}", "Append", "None")


def item_features(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(event_id, what was known of its item before the event); a popular item's rows of one batch meet in a task, so batches bound them."""
    return _dealt(events, "item_id", buckets).groupBy("bucket").transformWithStateInPandas(ItemSide(), f"event_id long, {ITEM_FEATURES}", "Append", "None")
