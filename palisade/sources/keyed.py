"""A stored table laid out by event id, for lookups and upserts that touch few files.

Rows lie in a fixed number of hash buckets of their id, a folder each, sorted by id and with a
Parquet bloom filter on it. A write adds a commit of its own below ``delta``. ``compact`` merges
the commits since into new files of those buckets only that they touch, then names the files that
count in the next version of a small manifest; nothing a reader may be using is replaced.
``vacuum`` deletes what the newest version no longer names.

Choose ``buckets`` so that one holds about a gigabyte. Rows without an id are all kept and lie in
the bucket of their arrival number. One compaction may run at a time, beside any number of
writers and readers.
"""
from __future__ import annotations

import json
import time
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.operators.filters import lookup as with_id
from palisade.operators.table import flatten, latest
from palisade.schema import ENRICHED_SCHEMA

ROWS = T.StructType([*ENRICHED_SCHEMA.fields, T.StructField("arrival_seq", T.LongType())])
_BLOOM = {"parquet.bloom.filter.enabled#eventId": "true"}


class Version(NamedTuple):
    """What counts: the generation of each bucket that has rows, and the commits merged."""
    number: int
    buckets: int
    base: dict[int, int]
    merged: list[str]


def create(spark: SparkSession, path: str, buckets: int = 256) -> None:
    """An empty table; fails where there is one."""
    _publish(spark, path, Version(0, buckets, {}, []))


def upsert(
    events: DataFrame, path: str, writer: str | None = None, epoch: int = 0,
) -> None:
    """Adds a commit of enriched events, nested or flat, that carry ``arrival_seq``. A retry
    gives the writer and epoch of its first attempt; its newest finished attempt counts."""
    spark = events.sparkSession
    flat = flatten(events, ["arrival_seq"]) if "rule" in events.columns else events
    name = f"{writer or uuid.uuid4().hex}@{epoch}@{time.time_ns():020d}"
    _write(latest(flat.select(*ROWS.fieldNames())), f"{path}/delta/{name}",
           current(spark, path).buckets)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The newest arrival of each id. Buckets without a new commit are scanned as they are."""
    version = current(spark, path)
    return _merged(spark, path, version, _commits(spark, path, version), None)


def lookup(spark: SparkSession, path: str, event_id: str) -> DataFrame:
    """The row of one id, from the files of its bucket alone."""
    version = current(spark, path)
    mine = spark.range(1).select(
        _bucket(F.lit(event_id), F.lit(0), version.buckets)).first()[0]
    touched = {c: [b for b in own if b == mine]
               for c, own in _commits(spark, path, version).items()}
    return with_id(_merged(spark, path, version, touched, mine, event_id), event_id)


def compact(spark: SparkSession, path: str) -> list[int]:
    """Merges the commits since into new files of the buckets they touch, which it returns."""
    version = current(spark, path)
    commits = _commits(spark, path, version)
    dirty = sorted({b for own in commits.values() for b in own})
    number = version.number + 1
    if dirty:
        # A failed attempt may have left a generation behind that no version names.
        _write(_newest(spark, path, version, commits, dirty), f"{path}/base/{number}",
               version.buckets)
    if commits:
        here = set(_names(spark, f"{path}/delta"))
        _publish(spark, path, Version(
            number, version.buckets, {**version.base, **dict.fromkeys(dirty, number)},
            [*(m for m in version.merged if m in here), *commits]))
    return dirty


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes merged commits and files that the newest version does not name, once no reader
    of an older version is left. Returns how many folders went."""
    version, gone = current(spark, path), 0
    fs, at = _files(spark, path)
    taken = {name.rpartition("@")[0]: name for name in sorted(version.merged)}
    # Older attempts of a merged commit go with it: alone they would count again.
    stale = [f"delta/{name}" for name in _names(spark, f"{path}/delta")
             if name <= taken.get(name.rpartition("@")[0], "")]
    for gen in _names(spark, f"{path}/base"):
        stale.extend(f"base/{gen}/{b}" for b in _names(spark, f"{path}/base/{gen}")
                     if b.startswith("bucket=")
                     and version.base.get(int(b.removeprefix("bucket="))) != int(gen))
    for folder in stale:
        gone += bool(fs.delete(at(f"{path}/{folder}"), True))
    return gone


def current(spark: SparkSession, path: str) -> Version:
    done = [int(n) for n in _names(spark, f"{path}/versions")
            if "_SUCCESS" in _names(spark, f"{path}/versions/{n}")]
    if not done:
        raise ValueError(f"no table at {path}")
    number = max(done)
    (row,) = spark.read.text(f"{path}/versions/{number}", wholetext=True).collect()
    stored = json.loads(row[0])
    return Version(number, stored["buckets"], {int(b): g for b, g in stored["base"].items()},
                   stored["merged"])


def _publish(spark: SparkSession, path: str, version: Version) -> None:
    spark.createDataFrame([(json.dumps(version._asdict()),)], "value string").coalesce(
        1).write.text(f"{path}/versions/{version.number}")


def _bucket(key: Column, order: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key, F.when(key.isNull(), order)), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, folder: str, buckets: int) -> None:
    """Each bucket's rows together, large ones split by adaptive execution, sorted by id."""
    (
        rows.withColumn("bucket", _bucket(F.col("eventId"), F.col("arrival_seq"), buckets))
        .hint("rebalance", "bucket").sortWithinPartitions("bucket", "eventId")
        .write.mode("overwrite").option("partitionOverwriteMode", "static").options(**_BLOOM)
        .partitionBy("bucket").parquet(folder))


def _merged(
    spark: SparkSession, path: str, version: Version, commits: dict[str, list[int]],
    only: int | None, event_id: str | None = None,
) -> DataFrame:
    dirty = sorted({b for own in commits.values() for b in own})
    clean = [f"{path}/base/{gen}/bucket={b}" for b, gen in version.base.items()
             if b not in dirty and only in (None, b)]
    if not dirty:
        return _scan(spark, clean)
    newest = _newest(spark, path, version, commits, dirty, event_id)
    return _scan(spark, clean).unionByName(newest) if clean else newest


def _newest(
    spark: SparkSession, path: str, version: Version, commits: dict[str, list[int]],
    dirty: list[int], event_id: str | None = None,
) -> DataFrame:
    """The newest rows of some buckets; of one id if given, which reaches the scan."""
    rows = _scan(spark, [
        *(f"{path}/base/{version.base[b]}/bucket={b}" for b in dirty if b in version.base),
        *(f"{path}/delta/{name}/bucket={b}" for name, own in commits.items() for b in own)])
    return latest(rows if event_id is None else with_id(rows, event_id))


def _scan(spark: SparkSession, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], ROWS)
    return spark.read.schema(ROWS).parquet(*folders)


def _commits(spark: SparkSession, path: str, version: Version) -> dict[str, list[int]]:
    """Finished commits that no version has merged yet, with the buckets they touch. Of the
    attempts of one writer and epoch the newest counts."""
    newest: dict[str, str] = {}
    listed = {}
    for name in sorted(_names(spark, f"{path}/delta")):
        inside = _names(spark, f"{path}/delta/{name}")
        if "_SUCCESS" in inside:
            newest[name.rpartition("@")[0]] = name
            listed[name] = sorted(
                int(b.removeprefix("bucket=")) for b in inside if b.startswith("bucket="))
    merged = set(version.merged)
    return {n: listed[n] for n in newest.values() if n not in merged}


def _files(spark: SparkSession, path: str):
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    return to_path(path).getFileSystem(spark._jsc.hadoopConfiguration()), to_path


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, to_path = _files(spark, folder)
    if not fs.exists(to_path(folder)):
        return []
    return [s.getPath().getName() for s in fs.listStatus(to_path(folder))]
