"""Registered queries: every operator over the events of a data folder.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from palisade.functions import scoring
from palisade.functions.instants import iso_label
from palisade.operators import audit, networks, replay, samples, stats, table, validate, window
from palisade.operators.enrich import enrich
from palisade.operators.filters import SampleQuery, StatsQuery, lookup, series_params
from palisade.plans import projection
from palisade.plans.ingest import accepted_events, stored_events, valid_events
from palisade.policy import Policy
from palisade.schema import ENRICHED_SCHEMA, EVENT_SCHEMA
from palisade.session import tune
from palisade.sources import files, keyed, payloads, store
from palisade.sources.scratch import scratch_dir
from palisade.streaming import pipeline

POLICY = Policy()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _zoneless(fn(tune(spark), sf_dir))

    QUERIES[fn.__name__] = run
    return run


def _zoneless(df: DataFrame) -> DataFrame:
    """Timestamps as UTC wall time, which every client shows the same way."""
    return df.selectExpr(*(
        f"CAST(`{f.name}` AS TIMESTAMP_NTZ) AS `{f.name}`"
        if isinstance(f.dataType, T.TimestampType) else f"`{f.name}`" for f in df.schema.fields))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.events(spark, sf_dir)


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table.flatten(_events(spark, sf_dir), ["arrival_seq"])


_TABLES: dict[tuple[str, str], str] = {}


def _table(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the enriched table of all rows, written once per session and data folder; rows
    without a category are its UNKNOWN bucket."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TABLES:
        raw, table_dir = scratch_dir(spark, "stored"), scratch_dir(spark, "compacted")
        store.upsert(stored_events(_events(spark, sf_dir), POLICY), raw)
        store.compact(spark, raw, table_dir)
        _TABLES[key] = table_dir
    return _TABLES[key]


def _stored(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    return store.read_compacted(spark, _table(spark, sf_dir), start, end)


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_events(_events(spark, sf_dir), POLICY)


# --- filters and samples ---------------------------------------------------------------

WEEK = {"from": "2024-01-05T00:00:00Z", "to": "2024-01-12T00:00:00Z"}


@query
def filter_config(spark, sf_dir):
    where = StatsQuery.from_params(configId=71).predicate()
    return _flat(spark, sf_dir).where(where).select("eventId", "configId", "clientIp", "path")


@query
def filter_time_range(spark, sf_dir):
    where = StatsQuery.from_params(**WEEK).predicate()
    return _flat(spark, sf_dir).where(where).select("eventId", "timestamp")


@query
def filter_ip_exact(spark, sf_dir):
    where = SampleQuery.from_params(clientIp=" 100.64.0.7 ").predicate()
    return _flat(spark, sf_dir).where(where).select("eventId", "clientIp", "path")


@query
def filter_ip_cidr(spark, sf_dir):
    where = SampleQuery.from_params(clientIp="100.64.0.64/26").predicate()
    return _flat(spark, sf_dir).where(where).select("eventId", "clientIp")


@query
def most_specific_network(spark, sf_dir):
    """Longest of nested blocks around the table's own addresses: /16 for even second octets, /24
    for odd third ones, and by the fourth a /26, /29 or /32."""
    flat = _flat(spark, sf_dir)
    octet = [F.split_part("clientIp", F.lit("."), F.lit(n)).try_cast("int") for n in range(1, 5)]
    lengths = F.filter(F.array(
        F.when(octet[1] % 2 == 0, 16), F.when(octet[2] % 2 == 1, 24),
        F.element_at(F.array(F.lit(None), F.lit(26), F.lit(29), F.lit(32)), octet[3] % 4 + 1)),
        lambda n: n.isNotNull())
    blocks = flat.select("clientIp", F.explode(lengths).alias("n")).select(
        F.concat_ws("/", "clientIp", "n").alias("cidr"))
    return networks.most_specific(flat, blocks).select("eventId", "clientIp", "network")


@query
def filter_category_action(spark, sf_dir):
    where = SampleQuery.from_params(category=" injection ", action="deny").predicate()
    return _flat(spark, sf_dir).where(where).select("eventId", "ruleCategory", "ruleAction")


@query
def filter_repeat_offender(spark, sf_dir):
    where = SampleQuery.from_params(repeatOffender=True).predicate()
    return _stored(spark, sf_dir).where(where).select("eventId", "clientIp", "repeatOffender")


@query
def samples_combined(spark, sf_dir):
    return samples.matching(_stored(spark, sf_dir), SampleQuery.from_params(
        configId=71, clientIp="10.0.0.0/16", category="xss", action="ALERT",
        repeatOffender=True, **{"from": "2024-01-02T00:00:00Z", "to": "2024-01-25T00:00:00Z"}))


@query
def samples_page(spark, sf_dir):
    page = SampleQuery.from_params(limit=20, offset=40)
    return samples.ranked(samples.page(_stored(spark, sf_dir), page), page.offset)


@query
def samples_total(spark, sf_dir):
    return samples.total(_stored(spark, sf_dir), SampleQuery.from_params(
        repeatOffender=False, action="deny", limit=20, offset=40))


@query
def lookup_by_id(spark, sf_dir):
    return lookup(_stored(spark, sf_dir), "req-42").drop("arrival_seq")


# --- stored shape, payloads, files -----------------------------------------------------

@query
def flatten_events(spark, sf_dir):
    return table.flatten(_events(spark, sf_dir))


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies: an array of 50 events per batch, or, for one batch in five, each event
    as a body of its own."""
    events = _events(spark, sf_dir)
    fields = [c for c in events.columns if c not in ("arrival_seq", "batch_id")]
    lone = F.col("batch_id") % 5 == 4
    iso = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    arrays = events.where(~lone).groupBy("batch_id").agg(
        F.sort_array(F.collect_list(F.struct("arrival_seq", F.struct(*fields).alias("e"))))
        .alias("_sent"))
    arrays = arrays.select(
        F.concat(F.lit("batch-"), "batch_id").alias("body_id"), "batch_id",
        F.to_json(F.transform("_sent", lambda s: s["e"]), iso).alias("body"))
    objects = events.where(lone).select(
        F.concat(F.lit("event-"), "arrival_seq").alias("body_id"), "batch_id",
        F.to_json(F.struct(*fields), iso).alias("body"))
    return arrays.unionByName(objects)


@query
def parse_payload(spark, sf_dir):
    parsed = payloads.parse_payloads(_bodies(spark, sf_dir), "body", POLICY)
    return payloads.accepted_events(parsed).select(
        "body_id", "index", "eventId", "timestamp", "configId", "clientIp", "path",
        "statusCode", "userAgent", "requestSize", F.col("rule.severity").alias("ruleSeverity"),
        F.col("rule.category").alias("ruleCategory"), F.col("geoLocation.city").alias("geoCity"))


@query
def reject_malformed(spark, sf_dir):
    damage = F.col("batch_id") % 6
    damaged = _bodies(spark, sf_dir).withColumn("body", (
        F.when(damage == 1, F.expr("left(body, length(body) - 1)"))
        .when(damage == 2, F.lit("[]"))
        .when(damage == 3, F.lit("17"))
        .when(damage == 4, F.replace("body", F.lit('"CRITICAL"'), F.lit('"SEVERE"')))
        .when(damage == 5, F.lit(" \n"))
        .otherwise(F.col("body"))))
    parsed = payloads.parse_payloads(damaged, "body", POLICY)
    return payloads.rejected_bodies(parsed).select(
        "body_id", "rejection", F.size("failures").cast("bigint").alias("failures"))


def _round_trip(spark: SparkSession, sf_dir: str, extension: str) -> DataFrame:
    path = scratch_dir(spark, "events") + extension
    # One client field gets white space, quotes and line breaks, as agents and paths may hold.
    odd = _events(spark, sf_dir).withColumn("userAgent", F.concat(
        F.lit("  \""), "userAgent", F.lit("\",\n ")))
    files.write_events(odd, path)
    back = files.read_events(spark, path, split=False)
    return table.flatten(back).drop("attackType", "threatScore", "repeatOffender")


@query
def scan_json_roundtrip(spark, sf_dir):
    return _round_trip(spark, sf_dir, ".json")


@query
def scan_csv_roundtrip(spark, sf_dir):
    return _round_trip(spark, sf_dir, ".csv").drop("receivedAt")


# Events of one file of the written feeds, and the fewest files of arrays and of quoted CSV.
FILE_ROWS = 200_000
FEW_FILES = 3


def _files_of(events: DataFrame) -> int:
    """Files for so many events: a task that sorts and writes one of them does not grow with the
    table."""
    return max(FEW_FILES, -(-events.count() // FILE_ROWS))


@query
def scan_json_array(spark, sf_dir):
    """A few files of one JSON array each, read by ranges."""
    path = scratch_dir(spark, "arrays") + ".json"
    events = _events(spark, sf_dir)
    lines = events.repartitionByRange(_files_of(events), "arrival_seq").sortWithinPartitions(
        "arrival_seq").select(F.to_json(
            F.struct(*(c for c in EVENT_SCHEMA.fieldNames() if c in events.columns)), {
                "ignoreNullFields": "false",
                "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("value"))
    lines.mapInArrow(_as_array, "value string").write.text(path)
    return table.flatten(files.read_events(spark, path, array=True), ["arrival_seq"]).drop(
        "attackType", "threatScore", "repeatOffender")


def _as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a partition as one array: a bracket or comma before each, one more at the end."""
    before = "["
    for batch in batches:
        if batch.num_rows:
            marks = pa.array([before] + [","] * (batch.num_rows - 1))
            yield pa.RecordBatch.from_arrays(
                [pc.binary_join_element_wise(marks, batch.column(0), "")], names=["value"])
            before = ","
    if before == ",":
        yield pa.RecordBatch.from_pylist([{"value": "]"}])


@query
def scan_csv_ranges(spark, sf_dir):
    """Quoted CSV with line breaks in cells, read by ranges."""
    path = scratch_dir(spark, "cells") + ".csv"
    odd = _events(spark, sf_dir).withColumn("userAgent", F.concat(
        F.lit("  \""), "userAgent", F.lit("\",\n\n ")))
    files.write_events(odd.repartitionByRange(_files_of(odd), "arrival_seq").sortWithinPartitions(
        "arrival_seq"), path)
    return table.flatten(files.read_events(spark, path), ["arrival_seq"]).drop(
        "receivedAt", "attackType", "threatScore", "repeatOffender")


@query
def ingest_file_order(spark, sf_dir):
    """Events in several files: their order in the files is their arrival order."""
    path = scratch_dir(spark, "ordered") + ".jsonl"
    in_order = _events(spark, sf_dir).repartitionByRange(7, "arrival_seq")
    files.write_events(in_order.sortWithinPartitions("arrival_seq"), path)
    return files.read_events(spark, path).select("arrival_seq", "eventId")


@query
def export_chronological(spark, sf_dir):
    """Feed order of an export, by what a reader of its files sees."""
    path = scratch_dir(spark, "export") + ".csv"
    files.write_events(files.chronological(_events(spark, sf_dir)), path)
    return files.read_events(spark, path).select("arrival_seq", "eventId")


@query
def receive_stamp(spark, sf_dir):
    """The server's time of receipt replaces what a client sent."""
    instant = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("batch_id"))
    return validate.stamp_received(_events(spark, sf_dir), instant).select("eventId", "receivedAt")


@query
def upsert_latest(spark, sf_dir):
    """A second feed re-sends one event in ten with another status; the newest one shows."""
    path = scratch_dir(spark, "table")
    first = _flat(spark, sf_dir)
    again = first.where(F.col("arrival_seq") % 10 == 0).withColumns({
        "statusCode": F.lit(500), "arrival_seq": F.col("arrival_seq") + 10 ** 12})
    store.upsert(first, path)
    store.upsert(again, path)
    return store.read_table(spark, path).select("eventId", "statusCode", "arrival_seq")


@query
def store_two_writers(spark, sf_dir):
    """Two writers use the same epochs, one of them retries; nothing is lost or doubled."""
    path, flat = scratch_dir(spark, "table"), _flat(spark, sf_dir)
    half = F.col("arrival_seq") % 2 == 0
    store.upsert(flat.where(half), path, "even", 0)
    store.upsert(flat.where(~half), path, "odd", 0)
    store.upsert(flat.where(half), path, "even", 0)
    return store.read_table(spark, path).select("eventId", "arrival_seq")


def _keyed(spark: SparkSession, sf_dir: str) -> str:
    """A table by event id: all events, then one in ten with another status, both compacted, then
    one in fifty that no compaction has seen."""
    path, flat = scratch_dir(spark, "keyed"), _flat(spark, sf_dir)
    keyed.create(spark, path, KEYED_BUCKETS)
    for part, (every, status) in enumerate(((1, None), (10, 500), (50, 501))):
        changed = flat.where(F.col("arrival_seq") % every == 0).withColumn(
            "arrival_seq", F.col("arrival_seq") + part * 10 ** 12)
        keyed.upsert(changed if status is None else changed.withColumn(
            "statusCode", F.lit(status)), path, "feed", part)
        if part < 2:
            keyed.compact(spark, path)
    return path


# Buckets of the registered queries' tables, which are small.
KEYED_BUCKETS = 16


@query
def keyed_upserts(spark, sf_dir):
    return keyed.read(spark, _keyed(spark, sf_dir)).select("eventId", "statusCode", "arrival_seq")


@query
def keyed_lookup(spark, sf_dir):
    return keyed.lookup(spark, _keyed(spark, sf_dir), "req-50").select(
        "eventId", "clientIp", "path", "statusCode", "timestamp", "arrival_seq")


@query
def store_range(spark, sf_dir):
    """Stored events of a range that begins and ends within a day."""
    query = StatsQuery.from_params(
        **{"from": "2024-01-05T06:30:00Z", "to": "2024-01-09T17:45:30Z"})
    return _stored(spark, sf_dir, query.start, query.end).select(
        "eventId", "timestamp", "threatScore")


@query
def clear_counts(spark, sf_dir):
    """What clearing a stream's table and windows removes, and what is left."""
    path = _streamed(spark, sf_dir)
    cleared = store.clear(spark, f"{path}/table", f"{path}/checkpoint")
    left = store.read_table(spark, f"{path}/table").agg(F.count(F.lit(1)).alias("left_over"))
    return left.select(
        F.lit(cleared.events).cast("bigint").alias("events"),
        F.lit(cleared.clients).cast("bigint").alias("clients"), "left_over")


# --- validation ------------------------------------------------------------------------

def _damaged(events: DataFrame) -> DataFrame:
    """One kind of fault per residue of the arrival number."""
    kind = F.col("arrival_seq") % 20

    def fault(column: str, *cases: tuple[int, Column]) -> Column:
        value = F.col(column)
        for residue, broken in cases:
            value = F.when(kind == residue, broken).otherwise(value)
        return F.when(kind != 15, value).alias(column.split(".")[-1])

    null = F.lit(None)
    rule = F.struct(
        fault("rule.id", (10, null)), fault("rule.name"), fault("rule.message"),
        fault("rule.severity", (11, F.lit("SEVERE"))), fault("rule.action", (12, null)),
        fault("rule.category", (13, F.lit(" xss\t")), (14, F.lit("FOOBAR")), (16, F.lit("  "))))
    return events.withColumns({
        "eventId": fault("eventId", (1, F.lit("  "))),
        "timestamp": fault("timestamp", (2, null)),
        "configId": fault("configId", (3, null)),
        "clientIp": fault("clientIp", (4, F.lit("\t"))),
        "hostname": fault("hostname", (5, null)),
        "path": fault("path", (6, F.lit(""))),
        "method": fault("method", (7, null)),
        "statusCode": fault("statusCode", (8, null)),
        "rule": F.when(kind != 9, rule),
    })


@query
def validate_errors(spark, sf_dir):
    checked = validate.with_errors(_damaged(_events(spark, sf_dir)), POLICY)
    return checked.select(
        "arrival_seq", F.size("errors").cast("bigint").alias("error_count"),
        F.array_join("errors", "; ").alias("errors"))


@query
def batch_accept(spark, sf_dir):
    return accepted_events(_events(spark, sf_dir), POLICY).select("batch_id", "eventId")


@query
def batch_errors(spark, sf_dir):
    checked = validate.with_errors(_events(spark, sf_dir), POLICY)
    return validate.batch_errors(checked).select(
        "batch_id", "index", F.array_join("messages", "; ").alias("messages"))


@query
def batch_ledger(spark, sf_dir):
    return validate.ledger(validate.with_errors(_events(spark, sf_dir), POLICY))


# --- scoring and enrichment ------------------------------------------------------------

@query
def attack_type(spark, sf_dir):
    """Categories in mixed case, unknown or blank for some residues."""
    n, category = F.col("arrival_seq"), F.col("rule.category")
    spelled = (
        F.when(n % 13 == 0, "CUSTOM_RULE").when(n % 13 == 1, F.concat(F.lit(" "), F.lower(category)))
        .when(n % 13 == 2, " ").otherwise(category))
    return _events(spark, sf_dir).select("eventId", scoring.attack_type(
        spelled, POLICY).alias("attackType"))


@query
def base_score(spark, sf_dir):
    severity, action = F.col("rule.severity"), F.col("rule.action")
    return _events(spark, sf_dir).select(
        "eventId", scoring.severity_score(severity, POLICY).alias("severity_score"),
        scoring.action_score(action, POLICY).alias("action_score"),
        scoring.base_score(severity, action, POLICY).alias("base_score"))


@query
def path_bonus(spark, sf_dir):
    """Upper-cased paths for odd arrivals: the match ignores case."""
    path = F.when(F.col("arrival_seq") % 2 == 1, F.upper("path")).otherwise(F.col("path"))
    return _events(spark, sf_dir).select(
        "eventId", path.alias("path"), scoring.path_bonus(path, POLICY).alias("bonus"))


@query
def threat_score(spark, sf_dir):
    return enrich(_valid(spark, sf_dir), POLICY).select(
        "eventId", "threatScore")


@query
def sliding_count(spark, sf_dir):
    return window.sliding_count(_valid(spark, sf_dir), POLICY.window_ms).select(
        "eventId", "clientIp", "window_count")


@query
def repeat_offender(spark, sf_dir):
    return window.repeat_offender(_valid(spark, sf_dir), POLICY).select(
        "eventId", "clientIp", "repeatOffender")


@query
def replay_flags(spark, sf_dir):
    return replay.replay_flags(_valid(spark, sf_dir), POLICY).select("eventId", "repeatOffender")


@query
def replay_disordered(spark, sf_dir):
    """Arrivals reversed within runs of 500: events come minutes to hours late."""
    n = F.col("arrival_seq")
    late = _valid(spark, sf_dir).withColumn("arrival_seq", n - n % 500 + 499 - n % 500)
    return replay.replay_flags(late, POLICY).select("eventId", "repeatOffender")


@query
def replay_future_clock(spark, sf_dir):
    """Every client's first arrival is stamped years ahead."""
    first = F.row_number().over(Window.partitionBy("clientIp").orderBy("arrival_seq")) == 1
    ahead = _valid(spark, sf_dir).withColumn("timestamp", F.when(
        first, F.col("timestamp") + F.expr("INTERVAL 5 YEARS")).otherwise(F.col("timestamp")))
    return replay.replay_counts(ahead, POLICY.window_ms).select("arrival_seq", "window_count")


@query
def enrich_events(spark, sf_dir):
    """The batch pipeline: validate each event, enrich, flatten."""
    valid = valid_events(_events(spark, sf_dir), POLICY)
    return table.flatten(enrich(valid, POLICY))


@query
def enrich_retries(spark, sf_dir):
    """Every event arrives a second time; retries neither double a window nor a row."""
    events = _valid(spark, sf_dir)
    again = events.withColumn("arrival_seq", F.col("arrival_seq") + 10 ** 12)
    return enrich(events.unionByName(again), POLICY).select(
        "eventId", "threatScore", "repeatOffender", "arrival_seq")


# Files of a part of a feed, at least.
FEED_FILES = 4


class Feed(NamedTuple):
    """A folder of files, and how many of them are a part."""
    path: str
    files: int


def _feed(spark: SparkSession, events: DataFrame, parts: int = 4) -> Feed:
    """A folder of JSON Lines files, written one after the other in arrival order, so that a
    file stream takes them in that order. Each part is written by several tasks, a file each, and
    by more of them for more events."""
    path = scratch_dir(spark, "feed")
    found = events.agg(F.count(F.lit(1)), F.expr(
        f"percentile_approx(arrival_seq, array({', '.join(str((i + 1) / parts) for i in range(parts))}))"
    )).first()
    files_of_part = max(FEED_FILES, -(-found[0] // (parts * FILE_ROWS)))
    low = F.lit(True)
    for edge in dict.fromkeys(found[1] or []):
        part = events.where(low & (F.col("arrival_seq") <= edge))
        # Dealt out by a hash: taking turns would sort whole rows first.
        part.drop("batch_id").repartition(files_of_part, "arrival_seq").write.mode("append").options(
            ignoreNullFields=False, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
        low = F.col("arrival_seq") > edge
    return Feed(path, files_of_part)


def _part_stream(spark: SparkSession, feed: Feed) -> DataFrame:
    """A part of the feed per micro-batch."""
    return pipeline.event_stream(spark, feed.path, feed.files)


def _stream(spark: SparkSession, feed: Feed, path: str) -> None:
    # A back-fill: no idle expiry, so the query drains.
    pipeline.drain(pipeline.run(
        _part_stream(spark, feed), f"{path}/table", f"{path}/checkpoint",
        POLICY, pipeline.DRAIN, time_mode="None", stamp=False))


def _streamed(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_dir(spark, "stream")
    _stream(spark, _feed(spark, _events(spark, sf_dir)), path)
    return path


@query
def stream_enrich(spark, sf_dir):
    """The streaming pipeline over the table as a file stream, read back from its store."""
    # Written as a glob, the path may be one file or a folder of files.
    source = spark.readStream.schema(projection.SOURCE_SCHEMA).parquet(
        f"{sf_dir}/events.parque[t]")
    path = scratch_dir(spark, "stream")
    pipeline.drain(pipeline.run(
        projection.project(source).drop("batch_id"), f"{path}/table", f"{path}/checkpoint",
        POLICY, pipeline.DRAIN, time_mode="None", stamp=False))
    return store.read_table(spark, f"{path}/table").select(*ENRICHED_SCHEMA.fieldNames())


@query
def stream_multi_batch(spark, sf_dir):
    """A micro-batch per file: windows are carried over, invalid events stop nothing."""
    return store.read_table(spark, f"{_streamed(spark, sf_dir)}/table").select(
        "eventId", "repeatOffender", "threatScore")


@query
def stream_late(spark, sf_dir):
    """Late events over micro-batches: arrivals reversed within runs of 500."""
    n = F.col("arrival_seq")
    late = _events(spark, sf_dir).withColumn("arrival_seq", n - n % 500 + 499 - n % 500)
    path = scratch_dir(spark, "stream")
    _stream(spark, _feed(spark, late), path)
    return store.read_table(spark, f"{path}/table").select("eventId", "repeatOffender")


@query
def stream_tenants(spark, sf_dir):
    """A window for each client of each configuration, carried over micro-batches."""
    path = scratch_dir(spark, "stream")
    pipeline.drain(pipeline.run(
        _part_stream(spark, _feed(spark, _events(spark, sf_dir))),
        f"{path}/table", f"{path}/checkpoint", POLICY, pipeline.DRAIN, time_mode="None",
        stamp=False, keys=["configId", "clientIp"]))
    return store.read_table(spark, f"{path}/table").select("eventId", "repeatOffender")


@query
def stream_restart(spark, sf_dir):
    """A second stream with a checkpoint of its own writes the other half into one table, and
    both restart once with nothing new to read."""
    path, n = scratch_dir(spark, "stream"), F.col("arrival_seq")
    for part in (0, 1):
        feed = _feed(spark, _events(spark, sf_dir).where(n % 2 == part), 2)
        for _ in range(2):
            pipeline.drain(pipeline.run(
                _part_stream(spark, feed), f"{path}/table",
                f"{path}/checkpoint-{part}", POLICY, pipeline.DRAIN, "None", False))
    return store.read_table(spark, f"{path}/table").select("eventId", "arrival_seq")


@query
def stream_quarantine(spark, sf_dir):
    """Invalid events of a stream go aside with their messages."""
    feed, path = _feed(spark, _events(spark, sf_dir)), scratch_dir(spark, "aside")
    pipeline.drain(pipeline.run_quarantine(
        pipeline.invalid_events(pipeline.event_stream(spark, feed.path), POLICY), f"{path}/rows",
        f"{path}/checkpoint", pipeline.DRAIN))
    return spark.read.parquet(f"{path}/rows").select(
        "arrival_seq", F.array_join("errors", "; ").alias("errors"))


# --- statistics ------------------------------------------------------------------------

CONFIG = StatsQuery.from_params(configId=82)


@query
def summary_totals(spark, sf_dir):
    return stats.totals(_stored(spark, sf_dir))


@query
def stats_by_category(spark, sf_dir):
    return stats.by_category(_stored(spark, sf_dir))


@query
def stats_by_action(spark, sf_dir):
    return stats.by_action(_flat(spark, sf_dir), CONFIG)


@query
def top_attackers(spark, sf_dir):
    return stats.top_attackers(_stored(spark, sf_dir))


@query
def top_paths(spark, sf_dir):
    return stats.top_paths(_flat(spark, sf_dir), StatsQuery.from_params(**WEEK))


@query
def summary_grouping_sets(spark, sf_dir):
    return stats.summary(_stored(spark, sf_dir), CONFIG)


@query
def summary_no_match(spark, sf_dir):
    """A configuration nobody uses: one total row of 0 and 0.0."""
    return stats.summary(_stored(spark, sf_dir), StatsQuery.from_params(configId=1))


@query
def timeseries_1m(spark, sf_dir):
    where, step = series_params(
        interval="1m", **{"from": "2024-01-03T06:00:30Z", "to": "2024-01-03T18:00:00Z"})
    return stats.timeseries(_flat(spark, sf_dir), where, step).select(
        iso_label(F.col("bucket")).alias("bucket"), "events")


@query
def timeseries_5m(spark, sf_dir):
    """Non-empty buckets of the whole table."""
    _, step = series_params(interval=" 5M ", **WEEK)
    return stats.histogram(_flat(spark, sf_dir), step)


@query
def timeseries_1h_zerofill(spark, sf_dir):
    where, step = series_params(
        configId=93, interval="1h",
        **{"from": "2023-12-31T20:30:00Z", "to": "2024-02-01T00:00:00Z"})
    return stats.timeseries(_flat(spark, sf_dir), where, step)


# --- audits ----------------------------------------------------------------------------

@query
def flagged_count(spark, sf_dir):
    return audit.flagged_count(window.repeat_offender(_valid(spark, sf_dir), POLICY))


@query
def flag_sequence(spark, sf_dir):
    return audit.flag_sequence(window.repeat_offender(_valid(spark, sf_dir), POLICY))


@query
def burst_profile(spark, sf_dir):
    return audit.bursts(_events(spark, sf_dir), POLICY)


@query
def burst_islands(spark, sf_dir):
    """Waves of clients over all paths: a client may attack again and again."""
    return audit.burst_islands(_events(spark, sf_dir), POLICY, ["clientIp"])


def _tampered(stored: DataFrame) -> DataFrame:
    return stored.withColumn("threatScore", F.when(
        F.col("arrival_seq") % 500 == 0, F.col("threatScore") + 7
    ).when(F.col("arrival_seq") % 500 == 1, F.lit(None)).otherwise(F.col("threatScore")))


@query
def score_integrity(spark, sf_dir):
    return audit.score_integrity(_tampered(_stored(spark, sf_dir)), POLICY)


@query
def score_integrity_healthy(spark, sf_dir):
    return audit.score_integrity(_stored(spark, sf_dir), POLICY)


@query
def snapshot_diff(spark, sf_dir):
    """Against a snapshot with altered, missing and foreign rows."""
    stored = _stored(spark, sf_dir)
    n = F.col("arrival_seq")
    snapshot = _tampered(stored).where(n % 500 != 2).withColumns({
        "eventId": F.when(n % 500 == 3, F.concat("eventId", F.lit("-x"))).otherwise(
            F.col("eventId")),
        "path": F.when(n % 1000 == 0, F.lit("/moved")).otherwise(F.col("path")),
        "receivedAt": F.col("receivedAt") + F.expr("INTERVAL 1 HOUR"),
    }).drop("arrival_seq")
    return audit.snapshot_diff(stored.drop("arrival_seq"), snapshot).withColumn(
        "changed", F.array_join("changed", ","))
