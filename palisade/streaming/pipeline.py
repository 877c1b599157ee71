"""Streaming pipeline: parse or read, validate, enrich, upsert; refused input goes aside."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from palisade.operators.enrich import score
from palisade.operators.validate import is_valid, stamp_received, with_errors
from palisade.policy import Policy
from palisade.schema import EVENT_SCHEMA
from palisade.sources import store
from palisade.sources.payloads import accepted_events, parse_payloads, rejected_bodies
from palisade.session import settings
from palisade.streaming.processor import STATE_SETTINGS, flag_stream

# The cadence of the live service: a flush every second.
LIVE_TRIGGER = {"processingTime": "1 second"}
DRAIN = {"availableNow": True}


# Files of one micro-batch, unless told otherwise.
MAX_FILES = 64


def event_stream(
    spark: SparkSession, path: str, max_files: int | None = MAX_FILES,
) -> DataFrame:
    """JSON Lines events from a folder, in the event schema plus the ``arrival_seq`` the
    producer sets. ``max_files`` bounds a micro-batch (``None``: all there is); a log source
    bounds it by offsets and gives its order by ``log_order``."""
    schema = T.StructType([*EVENT_SCHEMA.fields, T.StructField("arrival_seq", T.LongType())])
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def log_order(offset: str, partition: str, partitions: int) -> Column:
    """One order for a keyed log of a fixed number of partitions: unique, and by offset within
    each of them, so events of one key keep their order."""
    return F.col(offset).cast("bigint") * F.lit(partitions) + F.col(partition).cast("bigint")


def payload_events(
    bodies: DataFrame, body: str = "body", order: str = "arrival_seq",
    policy: Policy = Policy(),
) -> tuple[DataFrame, DataFrame]:
    """``(events, refused bodies)`` of a stream of request bodies that carry ``order``.

    Events are sequenced by body, then by their index in it: a text value holds under 2 GiB,
    so fewer than 2**24 valid events."""
    parsed = parse_payloads(bodies, body, policy)
    events = accepted_events(parsed).drop(body)
    sequenced = events.withColumn(
        order, F.col(order) * 2 ** 24 + F.col("index")).drop("index")
    return sequenced, rejected_bodies(parsed)


def enriched_stream(
    events: DataFrame, policy: Policy = Policy(), time_mode: str = "ProcessingTime",
    keys: Sequence[str] = ("clientIp",),
) -> DataFrame:
    """Valid events of a stream with flag, attack type and score; a window for each ``keys``."""
    return score(
        flag_stream(events.where(is_valid(policy)), policy, time_mode, keys=keys), policy)


def run(
    events: DataFrame,
    table: str,
    checkpoint: str,
    policy: Policy = Policy(),
    trigger: dict | None = None,
    time_mode: str = "ProcessingTime",
    stamp: bool = True,
    keys: Sequence[str] = ("clientIp",),
) -> StreamingQuery:
    """Starts validate, enrich and upsert as one query. A retried micro-batch replaces its
    own rows, a repeated event id its own document. The writer is the query's id, which lives
    in the checkpoint: a stream with another checkpoint adds to the table."""
    def write(batch: DataFrame, epoch: int) -> None:
        writer = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        store.upsert(batch, table, f"stream-{writer}", epoch, cluster=False)

    # A query takes its settings along when it starts.
    with settings(events.sparkSession, STATE_SETTINGS):
        enriched = enriched_stream(
            stamp_received(events) if stamp else events, policy, time_mode, keys)
        return (
            enriched.writeStream.outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or LIVE_TRIGGER))
            .foreachBatch(write).start())


def run_quarantine(
    refused: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
) -> StreamingQuery:
    """Starts the dead-letter query: refused bodies or invalid events, with their messages.
    Nothing in either query raises for a bad event, so one cannot stop the stream."""
    return (
        refused.writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or LIVE_TRIGGER)).start(path))


def invalid_events(events: DataFrame, policy: Policy = Policy()) -> DataFrame:
    return with_errors(events, policy).where(F.size("errors") > 0)


def drain(*queries: StreamingQuery, timeout: int | None = None) -> None:
    """Waits until each query has used up its available input, ``timeout`` seconds at most if
    given."""
    for query in queries:
        if timeout is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout):
            query.stop()
            raise TimeoutError(f"stream {query.id} did not drain in {timeout} s")
