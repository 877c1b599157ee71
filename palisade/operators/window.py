"""Event-time sliding count per client, and the repeat-offender flag built on it.

In event-time order the count of a row is its position among the key's rows less the rows
older than the window, so two running counts give it, without re-scanning each frame.

One key may hold a third of the table, so its history is cut into time chunks, and the last
window of each chunk is copied, without its payload, into the next. Every frame is complete
inside its chunk and chunks are independent: one scan, one shuffle, and a task that holds a
key's events of three windows at most, in whatever order they arrived.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from palisade.functions.instants import epoch_ms, floor_to_step
from palisade.functions.text import has_text
from palisade.policy import Policy

CHUNK_WINDOWS = 2

_MS, _OWN, _CHUNK = "_ms", "_own", "_chunk"


def sliding_count(
    df: DataFrame,
    window_ms: int,
    keys: Sequence[str] = ("clientIp",),
    ts: str = "timestamp",
    order: str = "arrival_seq",
    out: str = "window_count",
    where: Column | None = None,
) -> DataFrame:
    """Adds ``out``: the key's events in ``[t - W, t]`` counted in ``(t, order)`` order, the
    row itself included. Rows failing ``where`` are neither counted nor given a count."""
    keys = list(keys)
    counted = F.col(ts).isNotNull()
    for key in keys:
        counted &= F.col(key).isNotNull()
    if where is not None:
        counted &= where

    chunk_ms = window_ms * CHUNK_WINDOWS
    # Uncounted rows get a spread-out chunk, so that they do not meet in one partition.
    rows = df.withColumn(_MS, F.when(counted, epoch_ms(F.col(ts)))).withColumn(
        _OWN, F.coalesce(floor_to_step(F.col(_MS), chunk_ms), F.xxhash64(F.col(order))))
    next_too = F.col(_MS) >= F.col(_OWN) + F.lit(chunk_ms - window_ms)
    copies = F.explode(F.when(
        next_too, F.array(F.col(_OWN), F.col(_OWN) + chunk_ms)).otherwise(F.array(_OWN)))

    counted_rows = _count_rows(
        rows.withColumn(_CHUNK, copies), keys, order, window_ms, out, df.columns)
    return counted_rows.select(*df.columns, out)


def _count_rows(
    rows: DataFrame, keys: list[str], order: str, window_ms: int, out: str,
    columns: Sequence[str],
) -> DataFrame:
    """Counts within chunks, over the rows themselves."""
    # Copies carry no payload. Each column is blanked on its own, not packed in a struct, so
    # that columns nobody reads later are still pruned before the shuffle.
    payload = (
        f"CASE WHEN {_CHUNK} = {_OWN} THEN `{c}` END AS `{c}`" for c in columns if c not in keys)
    slim = rows.selectExpr(
        *keys, *payload, _CHUNK, _MS, f"{order} AS _order", f"{_CHUNK} = {_OWN} AS _is_own")
    by_chunk = Window.partitionBy(*keys, _CHUNK)
    position = F.row_number().over(by_chunk.orderBy(_MS, "_order"))
    expired = F.count(F.lit(1)).over(by_chunk.orderBy(_MS).rangeBetween(
        Window.unboundedPreceding, -(window_ms + 1)))
    return (
        slim.withColumns({"_position": position, "_expired": expired}).where("_is_own")
        .withColumn(out, F.expr(f"CASE WHEN {_MS} IS NOT NULL THEN _position - _expired END")))


def trackable(id_col: str, ts: str, keys: Sequence[str]) -> Column:
    """Events that enter the window: key and id not blank, timestamp present."""
    ok = has_text(F.col(id_col)) & F.col(ts).isNotNull()
    for key in keys:
        ok &= has_text(F.col(key).cast("string"))
    return ok


def repeat_offender(
    df: DataFrame,
    policy: Policy,
    keys: Sequence[str] = ("clientIp",),
    id_col: str = "eventId",
    ts: str = "timestamp",
    order: str = "arrival_seq",
) -> DataFrame:
    """Adds or replaces ``repeatOffender``: more than ``threshold`` events in the window.

    Expects one row per event id; see ``palisade.operators.table.first_arrival``.
    """
    counted = sliding_count(
        df.drop("repeatOffender"), policy.window_ms, keys, ts, order,
        out="_count", where=trackable(id_col, ts, keys))
    flag = F.coalesce(F.col("_count") > policy.threshold, F.lit(False))
    return counted.withColumn("repeatOffender", flag).drop("_count")
