"""The sliding window as a keyed state operator, for streams and batches."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

from palisade.functions.instants import epoch_ms
from palisade.operators.members import Members
from palisade.operators.window import trackable
from palisade.policy import Policy

_START = T.StructType([T.StructField("start", T.LongType())])
_MEMBERS = T.StructType([
    T.StructField("ids", T.ArrayType(T.StringType())),
    T.StructField("times", T.ArrayType(T.LongType())),
])
_SEEN = T.StructType([T.StructField("last", T.LongType())])


class WindowProcessor(StatefulProcessor):
    """Holds one client's live window as a map of time buckets. A micro-batch reads the map
    once and writes only the buckets whose members came, went or moved. Late events are never
    dropped: there is no watermark, and each anchors on its own time.

    The whole client expires after ``ttl_ms`` of silence by the clock. A lifetime per bucket
    would not do, as a bucket may live on unchanged, so the time of the last observation is kept
    beside the map and one timer per client clears both."""

    def __init__(self, window_ms: int, threshold: int, carried: Sequence[str], ttl_ms: int | None):
        self.window_ms = window_ms
        self.threshold = threshold
        self.carried = list(carried)
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.out = Row(*self.carried, "repeatOffender")
        self.buckets = handle.getMapState("buckets", _START, _MEMBERS)
        if self.ttl_ms is not None:
            self.seen = handle.getValueState("seen", _SEEN)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.ttl_ms is not None:
            self._see(timerValues.getCurrentProcessingTimeInMs())
        stored = {start: held for (start,), held in self.buckets.iterator()}
        members = Members(self.window_ms, (
            pair for ids, times in stored.values() for pair in zip(ids, times)))
        # A shuffle promises no order; the arrival sequence does.
        for row in sorted(rows, key=lambda r: r["_order"]):
            flag = False
            if row["_ms"] is not None:
                flag = members.observe(row["_id"], row["_ms"]) > self.threshold
            yield self.out(*(row[c] for c in self.carried), flag)
        for start, held in members.changed().items():
            if held:
                self.buckets.updateValue((start,), (list(held), list(held.values())))
            elif start in stored:
                self.buckets.removeKey((start,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        (last,) = self.seen.get()
        if last + self.ttl_ms <= timerValues.getCurrentProcessingTimeInMs():
            self.buckets.clear()
            self.seen.clear()
        else:
            self.handle.registerTimer(last + self.ttl_ms)
        return iter(())

    def _see(self, now: int) -> None:
        """Notes an observation; what outlived its time but not yet its timer is forgotten."""
        before = self.seen.get()
        if before is None:
            self.handle.registerTimer(now + self.ttl_ms)
        elif before[0] + self.ttl_ms <= now:
            self.buckets.clear()
        self.seen.update((now,))

    def close(self) -> None:
        pass


# What the state operator needs: a store that holds its kind of state, and no empty
# micro-batches, with which a processing-time query would never drain.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def check_settings(spark: SparkSession) -> None:
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    if not store.endswith("RocksDBStateStoreProvider"):
        raise ValueError(
            "the state operator needs the RocksDB state store; run under"
            " palisade.session.settings(spark, processor.STATE_SETTINGS)")
    # A batch run needs the state coordinator, which the stream manager brings up.
    _ = spark.streams


def flag_stream(
    df: DataFrame, policy: Policy = Policy(), time_mode: str = "ProcessingTime",
    order: str = "arrival_seq", keys: Sequence[str] = ("clientIp",),
) -> DataFrame:
    """Adds or replaces ``repeatOffender`` in arrival order per ``keys``, batch or stream: a
    client, or a client of one configuration with ``["configId", "clientIp"]``.

    ``time_mode`` ``"None"`` leaves the idle-client expiry out, for back-fills.
    """
    check_settings(df.sparkSession)
    columns = [c for c in df.columns if c != "repeatOffender"]
    counted = trackable("eventId", "timestamp", keys)
    packed = [f for f in df.select(*columns).schema.fields if _exact_as_text(f.dataType)]
    apart = [c for c in columns if c not in {f.name for f in packed}]
    # Python reads and writes rows cell by cell, so what it does not look at is one cell of text.
    payload = F.to_json(F.struct(*(
        (F.unix_micros(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)).alias(f.name)
        for f in packed)), {"ignoreNullFields": "true"})
    staged = df.select(
        *apart, payload.alias("_payload"), F.col("eventId").alias("_id"), F.col(order).alias("_order"),
        F.when(counted, epoch_ms(F.col("timestamp"))).alias("_ms"),
        # Untracked events need no common state, so they are spread out.
        F.when(counted, F.to_json(F.array(*(F.col(k).cast("string") for k in keys)))).otherwise(
            F.pmod(F.xxhash64(order), F.lit(1024)).cast("string")).alias("_key"))
    carried = [*apart, "_payload"]
    out = T.StructType([*staged.select(*carried).schema.fields,
                        T.StructField("repeatOffender", T.BooleanType())])
    ttl_ms = policy.state_ttl_ms if time_mode == "ProcessingTime" else None
    flagged = staged.groupBy("_key").transformWithState(
        WindowProcessor(policy.window_ms, policy.threshold, carried, ttl_ms),
        out, "Append", time_mode)
    text = T.StructType([
        T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.TimestampType) else f.dataType)
        for f in packed])
    # A generator's output is computed once, not for each column that is taken from it.
    read = flagged.select(*apart, "repeatOffender", F.inline(F.array(F.from_json(
        "_payload", text, {"mode": "FAILFAST", "maxStringLen": str(2 ** 31 - 1)}))))
    stamps = {f.name for f in packed if isinstance(f.dataType, T.TimestampType)}
    return read.select(
        *(F.timestamp_micros(c).alias(c) if c in stamps else F.col(c) for c in columns), "repeatOffender")


def _exact_as_text(kind: T.DataType, within: bool = False) -> bool:
    """Whether JSON gives back exactly what it was given; an instant goes as its microseconds."""
    if isinstance(kind, T.StructType):
        return bool(kind.fields) and all(_exact_as_text(f.dataType, True) for f in kind.fields)
    return type(kind) in (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType) or (
        type(kind) is T.TimestampType and not within)
