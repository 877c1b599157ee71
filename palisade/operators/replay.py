"""Arrival-order replay of the sliding window, without one task per client.

In arrival order a member enters the window with its arrival ``a`` and leaves with the first
later arrival that is more than the window ahead of it, or with the next arrival of its own
id, which replaces it. The count after arrival ``i`` is thus the number of arrivals up to
``i`` less the number of departures up to ``i``: two running sums, taken block by block (see
``blocks``).

What is left is to find, for each arrival, the first later one with a time beyond its own plus
the window. A client's arrivals are cut into blocks of ``BLOCK_ARRIVALS``. Within a block one
backward pass finds it. The few arrivals still alive at the end of their block look up the
next block whose maximum is beyond them, and are searched for there. No step depends on what
the clocks say, so late events, retries and times in the future cost nothing extra.
"""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from palisade.functions.instants import epoch_ms
from palisade.operators.blocks import ordinal, running_sum, span_of
from palisade.operators.window import trackable
from palisade.policy import Policy
from palisade.sources.scratch import kept

BLOCK_ARRIVALS = 250_000


class Ahead:
    """Looks for the next of some numbers beyond a bound, while they are taken in backwards."""

    def __init__(self) -> None:
        # From the far end: each entry is nearer and smaller than the one before it.
        self.negated: list[int] = []
        self.places: list[int] = []

    def find(self, bound: int) -> int | None:
        at = bisect_left(self.negated, -bound) - 1
        return self.places[at] if at >= 0 else None

    def push(self, place: int, number: int) -> None:
        while self.negated and -self.negated[-1] <= number:
            self.negated.pop()
            self.places.pop()
        self.negated.append(-number)
        self.places.append(place)


def _search(batches: Iterator[pd.DataFrame], parts: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of blocks, last arrival first: ``_ms`` is taken in, ``_bound`` is looked for."""
    current, ahead = None, Ahead()
    for batch in batches:
        found = []
        for part, n, ms, bound in zip(
                batch[parts].itertuples(index=False, name=None), batch["_n"], batch["_ms"],
                batch["_bound"]):
            if part != current:
                current, ahead = part, Ahead()
            found.append(None if pd.isna(bound) else ahead.find(int(bound)))
            if not pd.isna(ms):
                ahead.push(n, int(ms))
        out = batch[[*parts, "_from", "_bound", "_next"]].assign(
            _leaves=pd.array(found, dtype="Int64"))
        yield out[batch["_bound"].notna()]


def _later_block(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """For each open arrival of a block, the next block with a maximum beyond its bound."""
    for batch in batches:
        rows = []
        for key, block, maxima, waiting in zip(
                batch[keys].itertuples(index=False, name=None), batch["_block"],
                batch["_maxima"], batch["_open"]):
            ahead = Ahead()
            for later in reversed(maxima):
                if later["_block"] > block:
                    ahead.push(later["_block"], later["_max"])
            for wait in waiting:
                found = ahead.find(wait["_bound"])
                if found is not None:
                    rows.append((*key, found, wait["_from"], wait["_bound"]))
        yield pd.DataFrame(rows, columns=[*keys, "_block", "_from", "_bound"])


def replay_counts(
    df: DataFrame,
    window_ms: int,
    keys: Sequence[str] = ("clientIp",),
    id_col: str = "eventId",
    ts: str = "timestamp",
    order: str = "arrival_seq",
    span: int | None = None,
    block: int = BLOCK_ARRIVALS,
) -> DataFrame:
    """``(keys, order, window_count)`` for every trackable row."""
    keys = list(keys)
    span = span or span_of(df, order)
    narrow = df.where(trackable(id_col, ts, keys)).select(
        *keys, F.col(order).alias("_seq"), F.col(id_col).alias("_id"),
        epoch_ms(F.col(ts)).alias("_ms"))
    again = Window.partitionBy(*keys, "_id").orderBy("_n")
    # A narrow table that all steps share.
    placed = kept(ordinal(narrow, keys, "_seq", "_n", span).select(
        *keys, "_seq", "_n", "_ms", F.lead("_n").over(again).alias("_next"),
        F.expr(f"(_n - 1) div {block}").alias("_block")), "arrivals")

    parts = [*keys, "_block"]
    types = {f.name: f for f in placed.schema.fields}
    long = T.LongType()
    searched = T.StructType(
        [types[p] for p in parts]
        + [T.StructField(c, long) for c in ("_from", "_bound", "_next", "_leaves")])

    def search(rows: DataFrame) -> DataFrame:
        return (
            rows.repartition(*parts).sortWithinPartitions(*parts, F.desc("_n"))
            .mapInPandas(lambda b: _search(b, parts), searched))

    own = kept(search(placed.select(
        *parts, "_n", "_ms", F.col("_n").alias("_from"),
        (F.col("_ms") + window_ms).alias("_bound"), "_next")), "departures")
    if not placed.where("_block > 0").isEmpty():
        own = _across_blocks(placed, own, keys, search)
    departures = own.select(*keys, F.least("_leaves", "_next").alias("_n")).where(
        "_n IS NOT NULL").groupBy(*keys, "_n").agg(F.count(F.lit(1)).alias("_gone"))
    with_gone = placed.select(*keys, "_seq", "_n").join(departures, [*keys, "_n"], "left")
    summed = running_sum(
        with_gone, keys, "_seq", F.coalesce("_gone", F.lit(0)).cast(long), "_gone_so_far", span)
    return summed.select(
        *keys, F.col("_seq").alias(order), (F.col("_n") - F.col("_gone_so_far")).alias(
            "window_count"))


def _across_blocks(
    placed: DataFrame, own: DataFrame, keys: list[str],
    search: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``own`` with the departures that lie in a later block than the arrival."""
    parts = [*keys, "_block"]
    types = {f.name: f for f in placed.schema.fields}
    long = T.LongType()
    nothing = F.lit(None).cast(long)
    maxima = placed.groupBy(*parts).agg(F.max("_ms").alias("_max")).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_block", "_max"))).alias("_maxima"))
    waiting = own.where("_leaves IS NULL").groupBy(*parts).agg(
        F.collect_list(F.struct("_from", "_bound")).alias("_open")).join(
        maxima.where(F.size("_maxima") > 1), keys)
    asked = kept(waiting.mapInPandas(lambda b: _later_block(b, keys), T.StructType(
        [types[p] for p in parts] + [T.StructField(c, long) for c in ("_from", "_bound")])),
        "questions")
    # Questions come after a block's arrivals, which are sorted last first.
    answered = search(
        placed.join(asked.select(*parts).distinct(), parts, "left_semi").select(
            *parts, "_n", "_ms", nothing.alias("_from"), nothing.alias("_bound"),
            nothing.alias("_next"))
        .unionByName(asked.select(
            *parts, F.lit(-1).cast(long).alias("_n"), nothing.alias("_ms"), "_from", "_bound",
            nothing.alias("_next")))).select(*keys, "_from", F.col("_leaves").alias("_later"))
    return own.join(answered, [*keys, "_from"], "left").withColumn(
        "_leaves", F.coalesce("_leaves", "_later"))


def replay_flags(
    df: DataFrame,
    policy: Policy,
    keys: Sequence[str] = ("clientIp",),
    id_col: str = "eventId",
    ts: str = "timestamp",
    order: str = "arrival_seq",
    span: int | None = None,
    block: int = BLOCK_ARRIVALS,
) -> DataFrame:
    """Adds or replaces ``repeatOffender`` as computed in arrival order."""
    counts = replay_counts(df, policy.window_ms, keys, id_col, ts, order, span, block)
    flag = F.coalesce(F.col("window_count") > policy.threshold, F.lit(False))
    return (
        df.drop("repeatOffender").join(counts, [*keys, order], "left")
        .withColumn("repeatOffender", flag)
        .select(*(c for c in df.columns if c != "repeatOffender"), "repeatOffender")
    )
