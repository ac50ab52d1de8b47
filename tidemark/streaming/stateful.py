"""Folds over each key's rows in the order of event time, with state that survives restarts.

Rows wait in the state until the watermark has passed them, so that what a fold sees does not depend on how the stream is
cut in micro-batches; rows later than the watermark are dropped, as in windows. A fold takes the key's state (None at first) and
a row, and gives the new state and a result (None for none). ``ttl`` ends a key's state that long after its last row, in
event time. Folds are small functions: Spark deals keys in buckets, keeps a bucket's state and sets its timer.

State lies in RocksDB: start such queries within ``rocksdb``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, IntegralType, LongType, StructField, StructType, TimestampType, _parse_datatype_string

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Rows of a chunk of the state, and of those that are Python values at a time.
CHUNK = 10_000
#: Fields whose nulls one number tells.
BITS = 62
Fold = Callable[[tuple | None, dict], tuple[tuple | None, tuple | None]]


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that are started within keep their state in RocksDB; those of other queries are left as they are."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, old) if old else spark.conf.unset(PROVIDER)


class _InOrder(StatefulProcessor):
    """Folds of the keys that are dealt to one bucket. The state is a few values for a bucket, not for a key or row, since each
    call of it is a message to Spark: chunks of rows that wait, and a table of the keys' states, both as Arrow streams."""

    def __init__(self, keys: list[str], waiting: pa.Schema, ts: str, order: list[str], fold: Fold, held: pa.Schema, out: list[tuple[str, str]], ttl: int | None):
        self.keys, self.waiting, self.ts, self.order, self.fold = keys, waiting, ts, order, fold
        self.held, self.out, self.ttl = held, out, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        chunk = StructType([StructField("chunk", BinaryType())])
        self.rows = handle.getListState("rows", chunk)
        self.value = handle.getValueState("value", chunk)
        self.until = handle.getValueState("until", StructType([StructField("ms", LongType())]))  # the timer that is set

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            # by place: pandas renames columns that begin with an underscore
            at = part.shape[1] - len(self.waiting)
            null = [(part.iloc[:, 1 + i // BITS].to_numpy() >> i % BITS) & 1 == 1 for i in range(len(self.waiting))]
            made = [pa.array(part.iloc[:, at + i], f.type, mask=null[i], from_pandas=False) for i, f in enumerate(self.waiting)]
            self.rows.appendList([(_stream(pa.Table.from_arrays(made, schema=self.waiting)),)])
            low = int(pc.min(made[-1]).as_py())
            first = low if first is None else min(first, low)
        if first is not None:
            self._wake(first)
        return iter([])

    def _wake(self, ms: int) -> None:
        """A timer at ms, unless an earlier one is set."""
        set_ = self.until.get()[0] if self.until.exists() else None
        if set_ is None or ms < set_:
            if set_ is not None:
                self.handle.deleteTimer(set_)
            self.handle.registerTimer(ms)
            self.until.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.until.clear()
        n = len(self.keys)
        held = pa.concat_tables([_table(r[0]) for r in self.rows.get()]) if self.rows.exists() else self.waiting.empty_table()
        states = {k[:n]: k[n:] for k in _tuples(_table(self.value.get()[0]))} if self.value.exists() else {}
        due = held.filter(pc.less_equal(held["_ms"], now))
        due = due.take(pc.sort_indices(due, [(c, "ascending") for c in (self.ts, *self.order)], null_placement="at_start"))
        rest = held.filter(pc.greater(held["_ms"], now))
        for at in range(0, due.num_rows, CHUNK):
            results = []
            for r in _tuples(due.slice(at, CHUNK)):
                k = r[:n]
                *given, last = states.get(k, (None,))
                given = tuple(given) if given and (self.ttl is None or r[-1] - last <= self.ttl) else None
                given, result = self.fold(given, dict(zip(self.waiting.names, r, strict=True)))
                if given is None:
                    states.pop(k, None)
                else:
                    states[k] = (*given, r[-1])
                if result is not None:
                    results.append((*k, *result))
            if results:
                yield pd.DataFrame({c: pd.Series(x, dtype=t) for (c, t), x in zip(self.out, zip(*results, strict=True), strict=True)})
        if self.ttl is not None:
            states = {k: s for k, s in states.items() if now - s[-1] <= self.ttl}
        if states:
            columns = zip(*[(*k, *s) for k, s in states.items()], strict=True)
            self.value.update((_stream(pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, self.held, strict=True)], schema=self.held)),))
        else:
            self.value.clear()
        if rest.num_rows:
            self.rows.put([(_stream(rest.slice(at, CHUNK)),) for at in range(0, rest.num_rows, CHUNK)])
            self._wake(pc.min(rest["_ms"]).as_py())
        else:
            self.rows.clear()
        if states and self.ttl is not None:
            self._wake(min(s[-1] for s in states.values()) + self.ttl + 1)


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


def _tuples(table: pa.Table) -> Iterator[tuple]:
    return zip(*[c.to_pylist() for c in table.columns], strict=True)


def in_order(df: DataFrame, keys: list[str], ts: str, fold: Fold, state: str, result: str, delay: str, order: list[str] | None = None, ttl: dt.timedelta | None = None, buckets: int = 1024) -> DataFrame:
    """The keys and the fold's results (a schema string, as is that of the state) of a stream. Rows of equal time are taken by
    ``order``; rows without a time are left out. Keys are dealt in ``buckets``; a task holds the waiting rows of one at a time."""
    rows = df.where(F.col(ts).isNotNull()).withWatermark(ts, delay).withColumn("_ms", F.unix_millis(F.col(ts).cast("timestamp")))
    fields = sorted(rows.schema.fields, key=lambda f: keys.index(f.name) if f.name in keys else len(keys) if f.name != "_ms" else len(keys) + 1)
    # pandas makes integers with nulls doubles, and has one value for null and NaN: nulls are the bits of a number beside them
    bits = [F.shiftleft(F.col(f.name).isNull().cast("long"), i % BITS) for i, f in enumerate(fields)]
    nulls = [sum(bits[i:i + BITS], F.lit(0)).alias(f"_nulls{i}") for i in range(0, len(bits), BITS)]
    whole = [F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)).alias(f.name) if isinstance(f.dataType, IntegralType) else F.col(f.name) for f in fields]
    rows = rows.select(F.pmod(F.hash(*keys), F.lit(buckets)).alias("_bucket"), *nulls, *whole)
    out = StructType([*[f for f in fields[:len(keys)]], *_parse_datatype_string(result).fields])
    held = StructType([*fields[:len(keys)], *_parse_datatype_string(state).fields, StructField("_last", LongType())])
    plain = lambda s: to_arrow_schema(StructType([StructField(f.name, f.dataType) for f in s]), timestamp_utc=False)
    work = _InOrder(keys, plain(fields), ts, order or [], fold, plain(held), [(f.name, "datetime64[ns]" if isinstance(f.dataType, TimestampType) else "object") for f in out], int(ttl.total_seconds() * 1000) if ttl else None)
    return rows.groupBy("_bucket").transformWithStateInPandas(statefulProcessor=work, outputStructType=out, outputMode="Append", timeMode="EventTime")


def balances(df: DataFrame, delay: str, user: str = "user_id", ts: str = "created_at", key: str = "transaction_id") -> DataFrame:
    """(user_id, transaction_id, balance): a user's balance after each transaction (deposits and wins add, other kinds take; null
    amounts count as 0)."""

    def fold(state, r):
        amount = r["amount"] or 0.0
        now = (state[0] if state else 0.0) + (amount if r["transaction_type"] in ("deposit", "win") else -amount)
        return (now,), (r[key], now)

    return in_order(df.select(user, ts, key, "amount", "transaction_type"), [user], ts, fold, "balance double", f"{key} long, balance double", delay, [key])


def last_features(df: DataFrame, features: list[str], ttl: dt.timedelta, delay: str, user: str = "user_id", ts: str = "created_at", key: str = "transaction_id") -> DataFrame:
    """(user_id, transaction_id, last_<feature>..., age): each row with the numbers that its user's row before it carried, and its
    age in seconds; null where that is older than ``ttl``, or there is none. State ends with the ttl."""

    def fold(state, r):
        now = tuple(None if r[f] is None else float(r[f]) for f in features)
        before = (*state[:-1], (r["_ms"] - state[-1]) / 1000) if state else (None,) * (len(features) + 1)
        return (*now, r["_ms"]), (r[key], *before)

    names = ", ".join(f"{f} double" for f in features)
    return in_order(df.select(*dict.fromkeys([user, ts, key, *features])), [user], ts, fold, f"{names}, at long", f"{key} long, " + ", ".join(f"last_{f} double" for f in features) + ", age double", delay, [key], ttl)


def alerts(df: DataFrame, delay: str, threshold: float = 0.9, cooldown: dt.timedelta = dt.timedelta(minutes=15), dimension: str = "dimension", ts: str = "ts", score: str = "score") -> DataFrame:
    """(dimension, severity, raised): alerts of metrics below the threshold, critical below 0.7 and high below 0.85 of it; of one
    dimension and severity an alert silences those of the next minutes. The same as ``quality_alerts`` on a table. Metrics that
    are not below the threshold do not move the watermark."""
    low = df.where(F.col(score) < threshold).withColumn("severity", F.when(F.col(score) < 0.7 * threshold, "critical").when(F.col(score) < 0.85 * threshold, "high").otherwise("medium"))
    wait = int(cooldown.total_seconds() * 1000)

    def fold(state, r):
        if state is not None and r["_ms"] - state[0] < wait:
            return state, None
        return (r["_ms"],), (r[ts],)

    return in_order(low.select(F.col(dimension), "severity", F.col(ts)), [dimension, "severity"], ts, fold, "at long", "raised timestamp", delay, ttl=cooldown)
