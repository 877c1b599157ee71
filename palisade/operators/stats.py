"""Summary and time series over stored (flat, enriched) events."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from palisade.functions.instants import bucket_start
from palisade.functions.scoring import round_tenth
from palisade.functions.text import or_unknown
from palisade.operators.filters import StatsQuery

TOP_N = 10

EVERYTHING = StatsQuery()


def _events() -> Column:
    return F.count(F.lit(1)).alias("events")


def _avg_score() -> Column:
    return round_tenth(F.avg("threatScore")).alias("avg_threat_score")


def totals(df: DataFrame, query: StatsQuery = EVERYTHING) -> DataFrame:
    """One row: matching events and their average score, 0.0 when there is none."""
    return df.where(query.predicate()).agg(_events(), _avg_score())


def by_category(df: DataFrame, query: StatsQuery = EVERYTHING) -> DataFrame:
    return (
        df.where(query.predicate()).groupBy(or_unknown(F.col("ruleCategory")).alias("category"))
        .agg(_events(), _avg_score()))


def by_action(df: DataFrame, query: StatsQuery = EVERYTHING) -> DataFrame:
    return (
        df.where(query.predicate()).groupBy(or_unknown(F.col("ruleAction")).alias("action"))
        .agg(_events()))


def top_attackers(df: DataFrame, query: StatsQuery = EVERYTHING, n: int = TOP_N) -> DataFrame:
    """Busiest clients; a missing address is no attacker."""
    return (
        df.where(query.predicate() & F.col("clientIp").isNotNull()).groupBy("clientIp")
        .agg(_events(), _avg_score())
        .orderBy(F.desc("events"), "clientIp").limit(n))


def top_paths(df: DataFrame, query: StatsQuery = EVERYTHING, n: int = TOP_N) -> DataFrame:
    return (
        df.where(query.predicate()).groupBy(or_unknown(F.col("path")).alias("path"))
        .agg(_events()).orderBy(F.desc("events"), "path").limit(n))


_SECTIONS = {"category": 1, "action": 2, "attacker": 3, "path": 4}


def summary(df: DataFrame, query: StatsQuery = EVERYTHING, n: int = TOP_N) -> DataFrame:
    """All sections in one pass: ``(section, rank, key, events, avg_threat_score)``.

    One scan, one expand, one shuffle of partial aggregates. Categories and actions are
    complete, attackers and paths are cut to ``n``; the ``total`` section has one row, also
    when nothing matches. Averages are null where the service reports none.
    """
    base = df.where(query.predicate()).select(
        or_unknown(F.col("ruleCategory")).alias("category"),
        or_unknown(F.col("ruleAction")).alias("action"),
        F.col("clientIp").alias("attacker"),
        or_unknown(F.col("path")).alias("path"),
        "threatScore")
    grouped = base.groupingSets(
        [[F.col(name)] for name in _SECTIONS] + [[]], *(F.col(name) for name in _SECTIONS),
    ).agg(
        F.grouping_id().alias("_gid"), _events(), F.avg("threatScore").alias("_avg"))

    # grouping_id has one bit per column, cleared for the grouped one.
    section = F.lit("total")
    key = F.lit(None).cast("string")
    width = len(_SECTIONS)
    for position, name in enumerate(_SECTIONS):
        here = F.col("_gid") == (2 ** width - 1) ^ (1 << (width - 1 - position))
        section = F.when(here, name).otherwise(section)
        key = F.when(here, F.col(name)).otherwise(key)
    rows = grouped.select(
        section.alias("section"), key.alias("key"), "events", "_avg",
    ).where((F.col("section") != "attacker") | F.col("key").isNotNull())
    # Without input rows there is no empty grouping set either: a zero total stands by.
    nothing = df.sparkSession.range(1).select(
        F.lit("total").alias("section"), F.lit(None).cast("string").alias("key"),
        F.lit(0).cast("bigint").alias("events"), F.lit(None).cast("double").alias("_avg"))
    rows = rows.unionByName(nothing)

    # Complete sections give every key a partition of its own, so one rank limit serves all
    # sections and is applied map-side before the ranked rows are gathered.
    alone = F.when(~F.col("section").isin("attacker", "path"), F.col("key"))
    by_count = [F.desc("events"), F.col("key")]
    cut = rows.withColumn("_cut", F.row_number().over(
        Window.partitionBy("section", alone).orderBy(*by_count))).where(F.col("_cut") <= n)
    rank = F.row_number().over(Window.partitionBy("section").orderBy(*by_count))
    scored = F.when(
        ~F.col("section").isin("action", "path"), round_tenth(F.col("_avg")))
    return cut.select(
        "section", rank.alias("rank"), "key", "events", scored.alias("avg_threat_score"),
    ).where((F.col("section") != "total") | (F.col("rank") == 1))


def summary_document(df: DataFrame, query: StatsQuery = EVERYTHING) -> DataFrame:
    """The summary as one nested row: maps by category and action, lists of top entries."""
    rows = summary(df, query)

    def entries(section: str, *fields: str) -> Column:
        item = F.struct("rank", *fields)
        listed = F.sort_array(F.collect_list(F.when(F.col("section") == section, item)))
        return F.transform(listed, lambda e: F.struct(*(e[f].alias(f) for f in fields)))

    def total(field: str) -> Column:
        return F.max(F.when(F.col("section") == "total", F.col(field)))

    scored = ("key", "events", "avg_threat_score")
    return rows.agg(
        total("events").alias("totalEvents"),
        F.map_from_entries(F.transform(entries("category", *scored), lambda e: F.struct(
            e["key"], F.struct(e["events"].alias("count"),
                               e["avg_threat_score"].alias("avgThreatScore"))),
        )).alias("byCategory"),
        F.map_from_entries(entries("action", "key", "events")).alias("byAction"),
        entries("attacker", *scored).alias("topAttackers"),
        entries("path", "key", "events").alias("topTargetedPaths"),
        total("avg_threat_score").alias("avgThreatScore"),
    )


def histogram(df: DataFrame, step_ms: int, query: StatsQuery = EVERYTHING) -> DataFrame:
    """Non-empty epoch-aligned buckets."""
    return (
        df.where(query.predicate() & F.col("timestamp").isNotNull())
        .groupBy(bucket_start(F.col("timestamp"), step_ms).alias("bucket")).agg(_events()))


def timeseries(df: DataFrame, query: StatsQuery, step_ms: int) -> DataFrame:
    """``(bucket, events)`` from the bucket of ``start`` to that of ``end``, both included,
    empty buckets as 0. The axis is a distributed range, not an exploded array."""
    if query.start is None or query.end is None:
        raise ValueError("'from' and 'to' are required for timeseries")
    first, last = (
        int(bound.timestamp() * 1000 // step_ms) * step_ms for bound in (query.start, query.end))
    axis = df.sparkSession.range(first, last + 1, step_ms).select(
        F.timestamp_millis("id").alias("bucket"))
    counts = histogram(df, step_ms, query)
    return axis.join(counts, "bucket", "left").select(
        "bucket", F.coalesce("events", F.lit(0)).cast(T.LongType()).alias("events"))
