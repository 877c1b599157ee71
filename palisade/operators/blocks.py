"""Running aggregates over one key's arrival order without one task per key.

A key may hold a third of the table, so a plain ``partitionBy(key)`` window would sort that
third in one task. Here the order column is cut into blocks of equal width: each block is a
window partition of its own, block totals are pre-aggregated map-side, and only the totals are
windowed by key. The order column must be a unique integer, such as an arrival sequence or a
log order. The width follows the density of its values, so sparse numbers (a log with gaps,
events numbered within bodies) make no more blocks than dense ones.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

BLOCK_ROWS = 1_000_000

_BLOCK = "_block"
_CARRY = "_carry"


def span_of(df: DataFrame, order: str, rows: int = BLOCK_ROWS) -> int:
    """Width of the order values that about ``rows`` rows take up; reads that column at once."""
    seen = df.agg(F.min(order).alias("low"), F.max(order).alias("high"),
                  F.count(order).alias("n")).first()
    if not seen["n"]:
        return rows
    width = seen["high"] - seen["low"] + 1
    return max(1, -(-width * rows // seen["n"]))


def block_of(order: str, span: int) -> Column:
    """First order value of the row's block."""
    return F.col(order) - F.pmod(F.col(order), F.lit(span))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    out: str,
    total: Callable[[Column], Column],
    combine: Callable[[Column, Column], Column],
    span: int | None = None,
) -> DataFrame:
    """Adds ``out``: ``total(value)`` over the key's rows up to and including this one.

    ``combine`` merges the total of the earlier blocks with that of the current block.
    """
    span = span or span_of(df, order)
    blocked = df.withColumn(out, value).withColumn(_BLOCK, block_of(order, span))
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(
        Window.unboundedPreceding, -1)
    totals = (
        blocked.groupBy(*keys, _BLOCK).agg(total(F.col(out)).alias("_total"))
        .select(*keys, _BLOCK, total(F.col("_total")).over(before).alias(_CARRY))
    )
    return (
        blocked.withColumn(out, total(F.col(out)).over(inside))
        .transform(join_null_safe, totals, [*keys, _BLOCK])
        .withColumn(out, combine(F.col(_CARRY), F.col(out)))
        .drop(_BLOCK, _CARRY)
    )


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on ``keys`` where a null key meets a null key."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    match = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys))
    return left.join(renamed, match, "left").drop(*(f"_right_{k}" for k in keys))


def ordinal(
    df: DataFrame, keys: Sequence[str], order: str, out: str, span: int | None = None,
) -> DataFrame:
    """1-based position of each row among its key's rows."""
    return running_sum(df, keys, order, F.lit(1).cast("bigint"), out, span)


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str,
    span: int | None = None,
) -> DataFrame:
    return running(df, keys, order, value, out, F.sum,
                   lambda carry, here: F.coalesce(carry, F.lit(0)) + here, span)


def running_max(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str,
    span: int | None = None,
) -> DataFrame:
    return running(df, keys, order, value, out, F.max, lambda carry, here: F.greatest(
        carry, here), span)
