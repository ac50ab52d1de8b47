"""Ingest and counters as Structured Streaming plans; each works on a stream or a table of the same columns."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..sources.shared import StateLog

# Fields that messages of a topic need.
REQUIRED = {
    "user-events": ["user_id", "event_type", "timestamp"],
    "transactions": ["user_id", "amount", "currency", "transaction_type", "timestamp"],
    "game-sessions": ["user_id", "game_type", "session_start", "session_duration"],
    "deposits-withdrawals": ["user_id", "amount", "operation_type", "timestamp", "status"],
}
STATUS_ORDER = ["delivered", "opened", "clicked", "converted"]


def read_topics(spark: SparkSession, servers: str, topics: list[str], per_trigger: int = 10_000) -> DataFrame:
    """The Kafka source with its columns; needs the Kafka package on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("maxOffsetsPerTrigger", per_trigger).load()


def decode(df: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """JSON payloads as column ``data``; a payload that can't be read is kept in ``raw_data``."""
    rows = df.withColumn("data", F.from_json(F.col(value).cast("string"), f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("data").isNull() | F.col("data._bad").isNotNull()
    return rows.withColumn("raw_data", F.when(bad, F.col(value).cast("string"))).withColumn("data", F.when(~bad, F.col("data").dropFields("_bad")))


def validate_topics(df: DataFrame, topic: str = "topic") -> DataFrame:
    """Adds ``missing``: the required fields of the message's topic that it lacks; null for unknown topics."""
    message = F.col("data")
    cases = None
    for name, fields in REQUIRED.items():
        lacks = F.filter(F.array(*[F.when(message[f].isNull(), F.lit(f)) if _has(df, f) else F.lit(f) for f in fields]), lambda x: x.isNotNull())
        cases = F.when(F.col(topic) == name, lacks) if cases is None else cases.when(F.col(topic) == name, lacks)
    return df.withColumn("missing", cases)


def _has(df: DataFrame, field: str) -> bool:
    return field in df.schema["data"].dataType.fieldNames()


def split_dlq(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid messages, and those that can't be read or lack fields."""
    bad = F.col("raw_data").isNotNull() | F.col("missing").isNull() | (F.size("missing") > 0)
    return df.where(~bad), df.where(bad)


def dedup_stream(df: DataFrame, ts: str = "timestamp", keys: tuple[str, ...] = ("topic", "partition", "key"), within: str = "5 minutes") -> DataFrame:
    """One message per key within a span of event time."""
    rows = df.withWatermark(ts, within)
    return rows.dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else df.dropDuplicates(list(keys))


def windowed_counts(df: DataFrame, ts: str, keys: list[str], size: str = "60 seconds", late: str = "30 seconds") -> DataFrame:
    rows = df.withWatermark(ts, late)
    w = F.window(ts, size)
    return rows.groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum("amount").alias("amount")).select(F.col("window.start").alias("start"), *keys, "n", "amount")


def activity_counters(df: DataFrame) -> DataFrame:
    """Increments per user of bets, deposits and withdrawals, and the last activity."""
    n = lambda k: F.count_if(F.col("transaction_type") == k)
    return df.groupBy("user_id").agg(n("bet").alias("bets"), n("deposit").alias("deposits"), n("withdrawal").alias("withdrawals"), F.max("created_at").alias("last_activity"))


def apply_activity(state: DataFrame, increments: DataFrame) -> DataFrame:
    """Counters after increments."""
    i = increments.select("user_id", *[F.col(c).alias(f"_{c}") for c in ("bets", "deposits", "withdrawals", "last_activity")])
    rows = state.join(i, "user_id", "full")
    add = lambda c: (F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
    return rows.select("user_id", add("bets"), add("deposits"), add("withdrawals"), F.greatest("last_activity", "_last_activity").alias("last_activity"))


def furthest_status(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the furthest status that its events reached, and when it was first reached."""
    place = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("status"))
    best = df.withColumn("_p", place).groupBy(*keys).agg(F.max(F.struct("_p", -F.col("at").cast("double"), "at", "status")).alias("m"))
    return best.select(*keys, F.col("m.status").alias("status"), F.col("m.at").alias("at"))


def process(df: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """A running query that hands each micro-batch to the handler; offsets are kept in the checkpoint. With ``once`` it
    works off what is there and ends."""
    writer = df.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def stream_metrics(progress: list[dict], spark: SparkSession) -> DataFrame:
    """(batch, rows, rows_per_second, dropped) of a query's recent progress."""
    rows = [(int(p["batchId"]), int(p["numInputRows"]), float(p.get("processedRowsPerSecond") or 0.0), int(sum(s.get("numRowsDroppedByWatermark", 0) for s in p.get("stateOperators", [])))) for p in progress]
    return spark.createDataFrame(rows, "batch long, rows long, rows_per_second double, dropped long")


def _offsets(value, place: tuple = ()) -> dict[tuple, int]:
    """The numbers of an offset's JSON by their places in it: topic and partition, for messages."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            return {}
    if isinstance(value, dict):
        return {k: n for name, inner in value.items() for k, n in _offsets(inner, (*place, str(name))).items()}
    return {place: value} if isinstance(value, int) and not isinstance(value, bool) else {}


def lags(progress: dict) -> dict[str, int]:
    """Offsets of each topic and partition (``topic:0``) that a batch's progress leaves to be read. A partition that the batch
    has not touched counts from 0, one that has gone counts nothing; a source that doesn't tell its latest offsets has none."""
    out: dict[str, int] = {}
    for source in progress.get("sources", []):
        done = _offsets(source.get("endOffset"))
        for place, latest in _offsets(source.get("latestOffset")).items():
            name = ":".join(place)
            out[name] = out.get(name, 0) + max(0, latest - done.get(place, 0))
    return out


class ProgressLog(StreamingQueryListener):
    """A listener that writes a row for each batch of every query of the session: ``spark.streams.addListener(log)``. The rows
    are tables in a folder (use one that executors share), one for each query and batch, so that a batch that is repeated
    after a restart counts once; idle progress without rows is left out. ``rows`` reads them."""

    SCHEMA = "at timestamp, rows long, rows_per_second double, seconds double, dropped long, lag map<string, long>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._ended: set[str] = set()
        self._change = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        if not p["numInputRows"]:
            return
        dropped = sum(s.get("numRowsDroppedByWatermark", 0) for s in p.get("stateOperators", []))
        row = (p["timestamp"], int(p["numInputRows"]), float(p.get("processedRowsPerSecond") or 0.0), p.get("durationMs", {}).get("triggerExecution", 0) / 1000, int(dropped), lags(p))
        rows = self.spark.createDataFrame([row], self.SCHEMA.replace("at timestamp", "at string")).withColumn("at", F.col("at").cast("timestamp"))
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/query={p['id']}/batch={int(p['batchId'])}")

    def onQueryTerminated(self, event) -> None:
        with self._change:
            self._ended.add(str(event.runId))
            self._change.notify_all()

    def wait(self, query, seconds: float = 60.0) -> bool:
        """Whether the rows of an ended query are all written, within so many seconds: listeners hear of batches later."""
        with self._change:
            return self._change.wait_for(lambda: str(query.runId) in self._ended, seconds)

    def rows(self) -> DataFrame:
        """(at, rows, rows_per_second, seconds, dropped, lag, query, batch); fails where nothing has been written yet."""
        return self.spark.read.schema(f"{self.SCHEMA}, query string, batch long").parquet(self.path)


def enrich_stream(events: DataFrame, features: DataFrame, ts: str, ttl: str = "300 seconds") -> DataFrame:
    """Events with their user's stored features (user_id, updated_at, ...), a stream-static join: features that are older than
    ``ttl`` at the event, or younger than it, count as missing (null), and so do those of unknown users. For features that the
    stream itself brings see ``stateful.last_features``."""
    names = [c for c in features.columns if c not in ("user_id", "updated_at")]
    f = features.select("user_id", F.col("updated_at").alias("_at"), *[F.col(c).alias(f"_{c}") for c in names])
    rows = events.join(f, "user_id", "left")
    fresh = (F.col("_at") >= F.col(ts) - F.expr(f"interval {ttl}")) & (F.col("_at") <= F.col(ts))
    return rows.select(*events.columns, *[F.when(fresh, F.col(f"_{c}")).alias(c) for c in names])


class OnlineKMeans:
    """Centres that move with micro-batches: each batch is scaled by the running mean and spread of all batches so far, is
    assigned in Spark, and adds its sums to the centres' with ``decay`` for the past. Only k sums a batch come to the
    driver. ``version`` goes up with every ``per_version`` batches. Used as a handler of ``process``. With a ``log`` each
    batch's state is stored under its number: a restarted stream goes on from there, and a batch that is handed over again
    counts once."""

    def __init__(self, k: int, columns: list[str], decay: float = 1.0, per_version: int = 100, log: StateLog | None = None):
        self.k, self.columns, self.decay, self.per_version = k, columns, decay, per_version
        self.n, self.mean, self.m2 = 0, [0.0] * len(columns), [0.0] * len(columns)
        self.centres: list[list[float]] = []
        self.weights: list[float] = []
        self.batches = 0
        self.log = log
        self._seen = self._restore()

    def _restore(self) -> int:
        """The state of the log's last batch, and its number (-1 without one)."""
        entry = self.log.last() if self.log else None
        if entry is None:
            return -1
        for name, value in json.loads(entry[1]).items():
            setattr(self, name, value)
        return entry[0]

    @property
    def version(self) -> int:
        return self.batches // self.per_version

    def _scaled(self) -> list:
        spread = [(m / self.n) ** 0.5 if self.n and m > 0 else 1.0 for m in self.m2]
        return [(F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, m, s in zip(self.columns, self.mean, spread, strict=True)]

    def predict(self, df: DataFrame) -> DataFrame:
        """df with label (the nearest centre, the first among equals) and confidence: 1 minus the spread of the columns'
        distances, within 0.1 and 1; rows with nulls get neither."""
        x = F.array(*self._scaled())
        far = F.array(*[F.aggregate(F.zip_with(x, F.array(*[F.lit(v) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for c in self.centres])
        rows = df.withColumn("_d", far)
        best = F.array_min("_d")
        gaps = F.array(*[F.abs(v - F.array(*[F.lit(c[i]) for c in self.centres])[F.col("label")]) for i, v in enumerate(self._scaled())])
        rows = rows.withColumn("label", (F.array_position("_d", best) - 1).cast("int")).withColumn("_g", gaps)
        mean = F.aggregate("_g", F.lit(0.0), lambda s, v: s + v) / len(self.columns)
        spread = F.sqrt(F.aggregate(F.transform("_g", lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda s, v: s + v) / len(self.columns))
        return rows.withColumn("confidence", F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1 - spread))).drop("_d", "_g")

    def learn(self, df: DataFrame, batch: int = 0) -> None:
        if self.log and batch <= self._seen:
            return
        self._learn(df)
        if self.log:
            self.log.put(batch, json.dumps({x: getattr(self, x) for x in ("n", "mean", "m2", "centres", "weights", "batches")}))
            self._seen = batch

    def _learn(self, df: DataFrame) -> None:
        rows = df.select(*self.columns).dropna()
        s = rows.agg(F.count("*").alias("n"), *[f(F.col(c).cast("double")).alias(f"{p}{i}") for i, c in enumerate(self.columns) for p, f in (("m", F.avg), ("v", F.var_pop))]).first()
        if not s.n:
            return
        for i in range(len(self.columns)):  # two means and spreads into one
            d, total = s[f"m{i}"] - self.mean[i], self.n + s.n
            self.m2[i] += s[f"v{i}"] * s.n + d * d * self.n * s.n / total
            self.mean[i] += d * s.n / total
        self.n += s.n
        if len(self.centres) < self.k:
            scaled = rows.select(F.array(*self._scaled()).alias("x")).distinct().orderBy(F.xxhash64("x"), "x").limit(self.k - len(self.centres)).collect()
            self.centres += [list(r.x) for r in scaled]
            self.weights += [0.0] * len(scaled)
        sums = self.predict(rows).groupBy("label").agg(F.count("*").alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(self._scaled())]).collect()
        for r in sums:
            old = self.weights[r.label] * self.decay
            self.centres[r.label] = [(c * old + r[f"s{i}"]) / (old + r.n) for i, c in enumerate(self.centres[r.label])]
            self.weights[r.label] = old + r.n
        self.batches += 1


def score_stream(df: DataFrame, model, features: list[str]) -> DataFrame:
    """A stream or table through a fitted pyspark.ml clustering model: label and confidence 1 / (1 + distance)."""
    from ..operators.clustering import assign_clusters

    rows = df.withColumn("features", F.array(*[F.col(c).cast("double") for c in features]))
    return assign_clusters(model, rows).drop("features")


def quality_monitor(out: str, measure: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A handler that appends each micro-batch's measures to a table, with the batch's number. A repeated batch replaces
    its own part, so measures count once."""

    def handle(df: DataFrame, batch: int) -> None:
        measure(df).withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{out}/part={batch}")

    return handle
