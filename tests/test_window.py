import random

import pytest
from pyspark.sql import functions as F

from helpers import fold, millis, raw, raw_frame, rows_of
from palisade.operators import blocks
from palisade.operators.enrich import enrich
from palisade.operators.replay import replay_counts, replay_flags
from palisade.operators.window import repeat_offender, sliding_count
from palisade.policy import Policy

W = 600_000


def events_frame(spark, events):
    return spark.createDataFrame(
        [(seq, ip, i, millis(ms)) for seq, ip, i, ms in events],
        "arrival_seq bigint, clientIp string, eventId string, timestamp timestamp")


def random_events(n, ips, spread_ms, seed, ids=None):
    rng = random.Random(seed)
    return [
        (s, f"10.0.0.{rng.randrange(ips)}", f"e{s if ids is None else rng.randrange(ids)}",
         1_700_000_000_000 + rng.randrange(spread_ms))
        for s in range(n)]


def in_order(events):
    """Re-sequenced so that arrival order is event-time order."""
    return [(s, ip, i, ms) for s, (_, ip, i, ms) in enumerate(
        sorted(events, key=lambda e: (e[3], e[0])))]


def test_sliding_count_equals_fold_with_ties(spark):
    # 40 distinct seconds of one hour: many equal milliseconds.
    events = [(s, ip, i, 1_700_000_000_000 + (ms % 40) * 90_000)
              for s, ip, i, ms in random_events(1500, 3, 10_000, 1)]
    events = in_order(events)
    got = dict(rows_of(sliding_count(
        events_frame(spark, events), W), "arrival_seq", "window_count"))
    assert got == fold(events, W)


def test_sliding_count_across_chunks_and_before_1970(spark):
    events = in_order([(s, ip, i, ms - 1_700_000_000_000 - 4_000_000)
                       for s, ip, i, ms in random_events(1200, 2, 9_000_000, 2)])
    got = dict(rows_of(sliding_count(events_frame(spark, events), W),
                       "arrival_seq", "window_count"))
    assert got == fold(events, W)


def test_window_lower_bound_is_inclusive(spark):
    def counts(step):
        return [c for _, c in sorted(rows_of(sliding_count(events_frame(spark, [
            (0, "a", "x", 0), (1, "a", "y", step)]), W), "arrival_seq", "window_count"))]
    assert counts(W) == [1, 2]
    assert counts(W + 1) == [1, 1]


def test_burst_flags_from_the_sixth_event(spark):
    df = raw_frame(spark, [raw(i, timestamp=millis(i * 4000)) for i in range(25)])
    for flagged in (repeat_offender(df, Policy()), replay_flags(df, Policy())):
        flags = [f for _, f in sorted(rows_of(flagged, "arrival_seq", "repeatOffender"))]
        assert flags == [False] * 5 + [True] * 20


def test_untrackable_events_are_kept_but_neither_count_nor_flag(spark):
    same = [raw(i, timestamp=millis(i)) for i in range(5)]
    odd = [raw(5, clientIp=" "), raw(6, clientIp=None), raw(7, eventId="\t"), raw(8, eventId=None),
           raw(9, timestamp=None)]
    df = raw_frame(spark, same + odd + [raw(10, timestamp=millis(10))])
    for mode in ("event_time", "arrival"):
        got = dict(rows_of(enrich(df, Policy(), mode), "arrival_seq", "repeatOffender"))
        assert got == {i: i == 10 for i in range(11)}


def test_retries_do_not_inflate_the_window(spark):
    once = [raw(i, timestamp=millis(i * 1000)) for i in range(5)]
    again = [raw(100 + i, eventId="e4", timestamp=millis(4000)) for i in range(30)]
    flagged = enrich(raw_frame(spark, once + again), Policy())
    assert flagged.count() == 5 and flagged.where("repeatOffender").count() == 0
    replayed = enrich(raw_frame(spark, once + again), Policy(), "arrival")
    assert replayed.count() == 35 and replayed.where("repeatOffender").count() == 0


@pytest.mark.parametrize("seed,ids,spread", [(3, None, 3_000_000), (4, 300, 3_000_000),
                                             (5, 40, 60_000_000), (6, None, 500)])
def test_replay_equals_fold_on_shuffled_input(spark, seed, ids, spread):
    events = random_events(1500, 4, spread, seed, ids)
    for block in (16, 250_000):
        got = dict(rows_of(replay_counts(events_frame(spark, events), W, span=64, block=block),
                           "arrival_seq", "window_count"))
        assert got == fold(events, W)


def test_a_clock_in_the_future_does_not_hold_a_client_together(spark):
    """The first event lies far ahead; all others come in order, many windows long."""
    events = [(0, "x", "e0", 4_000_000_000_000)] + [
        (n, "x", f"e{n}", 1_700_000_000_000 + n * 60_000) for n in range(1, 3000)]
    result = replay_counts(events_frame(spark, events), W, span=200, block=200)
    assert dict(rows_of(result, "arrival_seq", "window_count")) == fold(events, W)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["n"] for r in replay_counts(
            events_frame(spark, events), W, span=200, block=200).groupBy(
            F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(sizes) == 3000 and max(sizes) < 1500
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_blocks_follow_the_density_of_the_order(spark):
    df = spark.range(5000).select((F.col("id") * 2 ** 24 + 5).alias("seq"), F.lit("k").alias("k"))
    span = blocks.span_of(df, "seq", rows=1000)
    assert 5 <= df.select(blocks.block_of("seq", span)).distinct().count() <= 6
    assert sorted(rows_of(blocks.ordinal(df, ["k"], "seq", "n"), "n")) == [
        (n,) for n in range(1, 5001)]
    assert blocks.span_of(df.limit(0), "seq") == blocks.BLOCK_ROWS


def test_replay_retry_with_another_time_moves_the_member(spark):
    # The retry takes "a" back in time, so the jump to the next chunk evicts it.
    events = [(0, "x", "a", W + 500_000), (1, "x", "a", W + 1), (2, "x", "b", 2 * W + 2)]
    got = dict(rows_of(replay_counts(events_frame(spark, events), W),
                       "arrival_seq", "window_count"))
    assert got == fold(events, W) == {0: 1, 1: 1, 2: 1}


def test_late_event_counts_newer_members(spark):
    events = [(i, "x", f"e{i}", 10_000_000 + i) for i in range(6)] + [(6, "x", "late", 1)]
    got = dict(rows_of(replay_counts(events_frame(spark, events), W),
                       "arrival_seq", "window_count"))
    assert got[6] == 7


def test_one_hot_client_is_spread_over_tasks(spark):
    """One client holds all rows within two hours; no partition may hold most of them."""
    df = spark.range(40_000).select(
        F.col("id").alias("arrival_seq"), F.lit("10.0.0.1").alias("clientIp"),
        F.concat(F.lit("e"), "id").alias("eventId"),
        F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("id") * 180).alias("timestamp"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for result in (sliding_count(df, W), replay_counts(df, W, span=1000, block=1000)):
            sizes = [r["n"] for r in result.groupBy(F.spark_partition_id()).agg(
                F.count(F.lit(1)).alias("n")).collect()]
            assert sum(sizes) == 40_000 and max(sizes) < 20_000
            assert result.where("window_count > 3334").count() == 0
            assert result.where("window_count = 3334").count() == 40_000 - 3333
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_ordinal_and_running_max_with_small_blocks(spark):
    rows = [(s, s % 3 if s % 11 else None, (s * 37) % 101) for s in range(200)]
    df = spark.createDataFrame(rows, "seq bigint, k int, v int")
    placed = blocks.ordinal(df, ["k"], "seq", "place", span=16)
    peak = blocks.running_max(placed, ["k"], "seq", F.col("v"), "peak", span=16)
    seen, expected = {}, {}
    for s, k, v in rows:
        n, top = seen.get(k, (0, -1))
        seen[k] = expected[s] = (n + 1, max(top, v))
    assert {r["seq"]: (r["place"], r["peak"]) for r in peak.collect()} == expected


def test_sliding_count_reads_its_input_once(spark, tmp_path):
    """One scan and one shuffle, however disordered the arrivals and sparse their numbers."""
    events = [(s * 2 ** 24 + s % 7, "10.0.0.1", f"e{s}", 1_700_000_000_000 + (s * 7919) % 5_000_000)
              for s in range(3000)]
    events_frame(spark, events).write.parquet(str(tmp_path / "t"))
    result = sliding_count(spark.read.parquet(str(tmp_path / "t")), W)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    by_time = sorted(events, key=lambda e: (e[3], e[0]))
    seen = {s: sum(o[3] >= ms - W for o in by_time[:n + 1])
            for n, (s, _, _, ms) in enumerate(by_time)}
    assert dict(rows_of(result, "arrival_seq", "window_count")) == seen
