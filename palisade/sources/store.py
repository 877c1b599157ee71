"""The stored table: Parquet partitioned by event date, one visible row per event id.

Writes append; reads show the newest arrival of each id. Every write goes to a folder named by
its writer and epoch. The same writer and epoch replace their own folder, so a retried
micro-batch cannot double its rows; nothing else is ever replaced.
"""
from __future__ import annotations

import uuid
from datetime import date, datetime, timezone
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.operators.filters import conjunction, in_range
from palisade.operators.table import compacted, flatten, latest
from palisade.schema import ENRICHED_SCHEMA

TABLE_SCHEMA = T.StructType([
    *ENRICHED_SCHEMA.fields,
    T.StructField("arrival_seq", T.LongType()),
    T.StructField("event_date", T.DateType()),
    T.StructField("writer", T.StringType()),
    T.StructField("epoch", T.LongType()),
])


class Cleared(NamedTuple):
    """What ``clear`` removed."""
    events: int
    clients: int


def upsert(
    events: DataFrame, path: str, writer: str | None = None, epoch: int = 0,
    cluster: bool = True,
) -> None:
    """Stores enriched events, nested or already flat, that carry ``arrival_seq``.

    Without a ``writer`` the rows are added, whatever was stored before. A retry gives the
    writer and epoch of its first attempt and replaces what that left. ``cluster`` brings each
    date's rows together, big dates split and small ones merged by adaptive execution, so that
    a wide date range does not leave a file per task and date. A micro-batch spans few dates
    and goes without that shuffle.
    """
    writer = writer or f"batch-{uuid.uuid4().hex}"
    flat = flatten(events, ["arrival_seq"]) if "rule" in events.columns else events.select(
        *ENRICHED_SCHEMA.fieldNames(), "arrival_seq")
    dated = flat.withColumn("event_date", F.to_date("timestamp"))
    (
        (dated.hint("rebalance", "event_date") if cluster else dated)
        .write.mode("overwrite").option("partitionOverwriteMode", "static")
        .partitionBy("event_date").parquet(f"{path}/writer={writer}/epoch={epoch}"))


def read_table(
    spark: SparkSession,
    path: str,
    start: datetime | None = None,
    end: datetime | None = None,
    base: str | None = None,
) -> DataFrame:
    """Stored events, the newest arrival of each id, with ``start <= timestamp <= end``.

    ``base`` is a compacted table older than everything in ``path``: its rows need no ranking
    and no shuffle of their own, only the ids written since are taken out. A time range prunes
    its date partitions; elsewhere the range is applied after the newest row is chosen, as an
    update may have moved an event in time.
    """
    rows = latest(_scan(spark, path))
    if base is not None:
        written = _scan(spark, path).select("eventId")
        rows = rows.unionByName(
            _scan(spark, base).where(_days(start, end)).join(written, "eventId", "left_anti"))
    return _shown(rows, start, end)


def read_compacted(
    spark: SparkSession, path: str, start: datetime | None = None, end: datetime | None = None,
) -> DataFrame:
    """A compacted table on its own: one row per id already, date partitions pruned."""
    return _shown(_scan(spark, path), start, end)


def _shown(rows: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    exact = conjunction([*in_range(start, end)])
    return rows.where(_days(start, end) & exact).drop("event_date", "writer", "epoch")


def _days(start: datetime | None, end: datetime | None) -> Column:
    """Date partitions a time range touches."""
    return conjunction([
        None if start is None else F.col("event_date") >= F.lit(_utc_day(start)),
        None if end is None else F.col("event_date") <= F.lit(_utc_day(end)),
    ])


def _utc_day(instant: datetime) -> date:
    return instant.astimezone(timezone.utc).date()


def _scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMA).parquet(path)


def compact(spark: SparkSession, source: str, target: str) -> None:
    """Rewrites the newest rows into a new table folder, clustered by date."""
    rows = compacted(_scan(spark, source)).withColumns(
        {"writer": F.lit("compacted"), "epoch": F.lit(0).cast("bigint")})
    # Range partitions on (date, id) keep files per date few without one task per date.
    (
        rows.repartitionByRange("event_date", "eventId")
        .write.mode("errorifexists").partitionBy("writer", "epoch", "event_date").parquet(target))


def clear(spark: SparkSession, path: str, checkpoint: str | None = None) -> Cleared:
    """Empties the table and, with the checkpoint folder of a stopped stream, forgets its client
    windows. A new stream may then start with the same folders."""
    shown, clients = read_table(spark, path).count(), 0
    spark.createDataFrame([], TABLE_SCHEMA).write.mode("overwrite").option(
        "partitionOverwriteMode", "static").partitionBy(
        "writer", "epoch", "event_date").parquet(path)
    if checkpoint is not None:
        clients = (
            spark.read.format("statestore").option("stateVarName", "buckets").load(checkpoint)
            .select("key").distinct().count())
        folder = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return Cleared(shown, clients)
