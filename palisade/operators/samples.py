"""Filtered, paged event samples, newest first."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from palisade.functions.instants import epoch_ms, floor_to_step
from palisade.operators.filters import SampleQuery
from palisade.schema import SAMPLE_COLUMNS

# Day, hour, minute, second, millisecond.
_SEEK_STEPS_MS = (86_400_000, 3_600_000, 60_000, 1_000, 1)


def newest_first() -> list[Column]:
    return [F.col("timestamp").desc_nulls_last(), F.col("eventId").asc()]


def matching(df: DataFrame, query: SampleQuery) -> DataFrame:
    return df.where(query.predicate()).select(*SAMPLE_COLUMNS)


def total(df: DataFrame, query: SampleQuery) -> DataFrame:
    """One row: matching events, whatever the page."""
    return df.where(query.predicate()).agg(F.count(F.lit(1)).alias("total"))


def page(df: DataFrame, query: SampleQuery) -> DataFrame:
    """The 17 sample columns of one page, lazily: a top-k of ``offset + limit`` rows."""
    rows = matching(df, query).orderBy(*newest_first())
    return rows.offset(query.offset).limit(query.limit)


def deep_page(df: DataFrame, query: SampleQuery, top_k_rows: int = 100_000) -> DataFrame:
    """The same page by seeking: counts per day, hour, minute, second and millisecond find the
    time range it lies in, at once, so that no task holds all rows before it."""
    rows, offset = _seek(matching(df, query), query.offset, query.limit, top_k_rows)
    return rows.orderBy(*newest_first()).offset(offset).limit(query.limit)


def samples(df: DataFrame, query: SampleQuery) -> tuple[DataFrame, DataFrame]:
    return page(df, query), total(df, query)


def ranked(page_rows: DataFrame, offset: int = 0) -> DataFrame:
    """Adds the row's position in the listing; a page is small by definition."""
    position = F.row_number().over(Window.orderBy(*newest_first()))
    return page_rows.withColumn("rank", position + F.lit(offset))


def _seek(
    rows: DataFrame, offset: int, limit: int, top_k_rows: int,
) -> tuple[DataFrame, int]:
    """Narrows to the time range holding the page, with the offset left inside it.

    Counts per day, then per hour of the days touched, and so on; each step returns at most
    one driver row per row of the page."""
    for step in _SEEK_STEPS_MS:
        bucket = floor_to_step(epoch_ms(F.col("timestamp")), step)
        newest = Window.orderBy(F.col("_bucket").desc_nulls_last())
        touched = (
            rows.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_through", F.sum("_n").over(newest))
            .where((F.col("_through") > offset)
                   & (F.col("_through") - F.col("_n") < offset + limit))
            .orderBy(F.col("_bucket").desc_nulls_last()).collect())
        if not touched:
            return rows.limit(0), 0
        offset -= touched[0]["_through"] - touched[0]["_n"]
        starts = [r["_bucket"] for r in touched if r["_bucket"] is not None]
        keep = F.lit(False)
        if starts:
            keep = (F.col("timestamp") >= F.timestamp_millis(F.lit(min(starts)))) & (
                F.col("timestamp") < F.timestamp_millis(F.lit(max(starts) + step)))
        if len(starts) < len(touched):
            keep = keep | F.col("timestamp").isNull()
        rows = rows.where(keep)
        if offset + limit <= top_k_rows or not starts:
            break
    return rows, offset
