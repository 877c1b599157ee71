"""Checks a user runs on stored events: score integrity, snapshot diff, flag order, bursts."""
from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from palisade.functions.instants import epoch_ms, floor_to_step
from palisade.functions.scoring import threat_score
from palisade.operators.blocks import ordinal
from palisade.operators.window import sliding_count
from palisade.policy import Policy
from palisade.sources.scratch import kept


def score_integrity(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Stored events whose score differs from the one their own columns give."""
    recomputed = threat_score(
        F.col("ruleSeverity"), F.col("ruleAction"), F.col("path"), F.col("repeatOffender"),
        policy)
    return df.withColumn("recomputed", recomputed).where(
        ~F.col("threatScore").eqNullSafe(F.col("recomputed"))
    ).select("eventId", "clientIp", "path", "ruleSeverity", "ruleAction", "threatScore",
             "repeatOffender", "recomputed")


# Hashes of differing ids, of which each task gets a list; whole snapshots are joined for more.
MOST_DIFFERING = 1_000_000

# Columns of these types go into a row's digest; others are compared as they are.
_DIGESTED = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType)


def _contents(df: DataFrame, columns: Sequence[str], digested: Sequence[bool]) -> Column:
    """A SHA-256 of the digested columns and the others whole: equal contents are equal rows. Texts
    stand behind their length, which is empty for a null; other values hold no comma."""
    def parts(name: str) -> list[Column]:
        kind = df.select(name).schema[0].dataType
        if isinstance(kind, T.StringType):
            return [F.coalesce(F.octet_length(name).cast("string"), F.lit("")), F.col(name)]
        value = F.unix_micros(F.col(name)) if isinstance(kind, T.TimestampType) else F.col(name)
        return [F.coalesce(value.cast("string"), F.lit(""))]

    texts = [part for c, short in zip(columns, digested) if short for part in parts(c)]
    whole = [F.col(c).alias(f"_{n}") for n, (c, short) in enumerate(zip(columns, digested)) if not short]
    return F.struct(F.unhex(F.sha2(F.concat_ws(",", *texts), 256)).alias("_digest"), *whole)


def snapshot_diff(
    actual: DataFrame, expected: DataFrame, key: str = "eventId",
    ignore: Sequence[str] = ("receivedAt",),
) -> DataFrame:
    """``(key, status, changed)``: ids only in one snapshot, and ids whose columns differ.

    Ids and digests of both snapshots are joined at once, which costs a part of what whole rows do.
    Only rows of ids whose digests differ are then read again and compared column by column."""
    compared = [c for c in expected.columns if c != key and c not in ignore]
    digested = [
        mine.dataType == theirs.dataType and isinstance(mine.dataType, _DIGESTED)
        for mine, theirs in zip(actual.select(*compared).schema, expected.select(*compared).schema)]
    a, e = (df.select(F.col(key).alias(f"_key{side}"), _contents(df, compared, digested).alias(side))
            for df, side in ((actual, "_a"), (expected, "_e")))
    status = (
        F.when(F.col("_e").isNull(), "extra").when(F.col("_a").isNull(), "missing")
        .when(F.col("_a") != F.col("_e"), "changed"))
    apart = kept(
        a.join(e, F.col("_key_a") == F.col("_key_e"), "full_outer").withColumn("status", status)
        .where(F.col("status").isNotNull())
        .select(F.coalesce("_key_a", "_key_e").alias(key), "status",
                F.array(F.xxhash64("_key_a"), F.xxhash64("_key_e")).alias("_hashes")), "apart")
    alone = apart.where(F.col("status") != "changed").select(
        key, "status", F.array().cast("array<string>").alias("changed"))

    hashes = apart.where(F.col("status") == "changed").select(
        F.explode("_hashes").alias("_hash")).distinct()
    if hashes.limit(MOST_DIFFERING + 1).count() <= MOST_DIFFERING:
        actual, expected = (df.select(key, *compared, F.xxhash64(key).alias("_hash")).join(
            F.broadcast(hashes), "_hash", "left_semi") for df in (actual, expected))
    a, e = (df.select(key, F.struct(*compared).alias(side)) for df, side in ((actual, "_a"), (expected, "_e")))
    changed = F.array_compact(F.array(*(
        F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_e.{c}")), F.lit(c)) for c in compared)))
    return (
        a.join(e, key).withColumn("changed", changed).where(F.size("changed") > 0)
        .select(key, F.lit("changed").alias("status"), "changed").unionByName(alone))


def flag_sequence(
    df: DataFrame, key: str = "clientIp", order: str = "arrival_seq", span: int | None = None,
) -> DataFrame:
    """Per key in arrival order: events, flags, the ordinal of the first flag, and events
    left unflagged after it. A steady burst reads ``first = threshold + 1``, ``after = 0``."""
    placed = ordinal(df.select(key, order, "repeatOffender"), [key], order, "_place", span)
    first = F.min(F.when(F.col("repeatOffender"), F.col("_place")))
    unflagged = F.count_if(~F.col("repeatOffender"))
    return placed.groupBy(key).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if("repeatOffender").alias("flagged"),
        first.alias("first_flagged"),
        (unflagged - (first - 1)).alias("unflagged_after"),
    )


def flagged_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if("repeatOffender").alias("flagged"))


def bursts(
    df: DataFrame, policy: Policy = Policy(), keys: Sequence[str] = ("clientIp", "path"),
    within: timedelta | None = None,
) -> DataFrame:
    """Groups with more events than the threshold inside one window: the shape of a wave."""
    limit_ms = policy.window_ms if within is None else within // timedelta(milliseconds=1)
    return (
        df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("events"),
            F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
        .withColumn("span_ms", epoch_ms(F.col("last_seen")) - epoch_ms(F.col("first_seen")))
        .where((F.col("events") > policy.threshold) & (F.col("span_ms") <= limit_ms)))


# Windows of time in which islands are found before they are joined over its edges.
ISLAND_WINDOWS = 6


def burst_islands(
    df: DataFrame, policy: Policy = Policy(), keys: Sequence[str] = ("clientIp", "path"),
    gap: timedelta | None = None, ts: str = "timestamp", order: str = "arrival_seq",
) -> DataFrame:
    """Every wave of a key: ``events``, ``first_seen``, ``last_seen``, ``span_ms`` and ``densest``,
    the most events in one window of the policy.

    A wave ends where the next event is more than ``gap`` away (the window, unless told otherwise,
    and never less: a window would else reach over two waves); waves whose densest window holds no
    more events than the threshold are left out, so stray events neither hide a wave nor make one.
    Events without a timestamp or with a null key belong to none.

    Islands are found in chunks of time, so a key's history is dealt out by time. Only the first and
    the last island of a chunk can reach over its edge; these summaries, two a chunk at most, are
    joined by key, the others are done."""
    window_ms = policy.window_ms
    gap_ms = window_ms if gap is None else gap // timedelta(milliseconds=1)
    if gap_ms < window_ms:
        raise ValueError("gap must be at least the window")
    keys = list(keys)
    there = reduce(and_, (F.col(k).isNotNull() for k in keys), F.col(ts).isNotNull())
    counted = sliding_count(
        df.where(there).select(*keys, ts, order), window_ms, keys, ts, order, out="_density")
    rows = counted.withColumn("_ms", epoch_ms(F.col(ts))).withColumn(
        "_chunk", floor_to_step(F.col("_ms"), ISLAND_WINDOWS * gap_ms))

    def numbered(rows: DataFrame, part: list[str], start: str, end: str) -> DataFrame:
        by = Window.partitionBy(*part).orderBy(start, end)
        far = F.coalesce((F.col(start) - F.lag(end).over(by) > gap_ms).cast("long"), F.lit(1))
        return rows.withColumn("_far", far).withColumn("_island", F.sum("_far").over(
            by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    inside = (
        numbered(rows, [*keys, "_chunk"], "_ms", "_ms")
        .groupBy(*keys, "_chunk", "_island").agg(
            F.count(F.lit(1)).alias("events"), F.min("_ms").alias("_from"), F.max("_ms").alias("_to"),
            F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.max("_density").alias("densest"))
        .withColumn("_islands", F.max("_island").over(Window.partitionBy(*keys, "_chunk"))))
    edge = (F.col("_island") == 1) | (F.col("_island") == F.col("_islands"))
    found = ["events", "first_seen", "last_seen", "densest", "_from", "_to"]
    joined = (
        numbered(inside.where(edge).drop("_island"), keys, "_from", "_to").groupBy(*keys, "_island").agg(
            F.sum("events").alias("events"), F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"), F.max("densest").alias("densest"),
            F.min("_from").alias("_from"), F.max("_to").alias("_to")))
    return (
        joined.select(*keys, *found).unionByName(inside.where(~edge).select(*keys, *found))
        .where(F.col("densest") > policy.threshold)
        .select(*keys, "events", "first_seen", "last_seen",
                (F.col("_to") - F.col("_from")).alias("span_ms"), "densest"))
