import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import at, millis, raw, raw_frame, rows_of, stored_frame
from palisade.operators import audit
from palisade.operators.window import repeat_offender
from palisade.plans.ingest import stored_events
from palisade.policy import Policy


def test_score_integrity(spark):
    stored = stored_events(raw_frame(spark, [raw(i, path="/login") for i in range(4)]))
    assert audit.score_integrity(stored).count() == 0
    broken = stored.withColumn("threatScore", F.when(F.col("arrival_seq") == 1, 1).when(
        F.col("arrival_seq") != 2, F.col("threatScore")))
    got = sorted(rows_of(audit.score_integrity(broken), "eventId", "threatScore", "recomputed"))
    assert got == [("e1", 1, 65), ("e2", None, 65)]


def test_snapshot_diff(spark):
    a = stored_frame(spark, [dict(eventId=i, path="/", receivedAt=at("2026-01-01T00:00:00"))
                             for i in "abc"])
    e = stored_frame(spark, [dict(eventId="a", path="/"), dict(eventId="b", statusCode=5),
                             dict(eventId="d")])
    got = sorted(rows_of(audit.snapshot_diff(
        a.drop("arrival_seq"), e.drop("arrival_seq")), "eventId", "status", "changed"))
    assert got == [("b", "changed", ["path", "statusCode"]), ("c", "extra", []),
                   ("d", "missing", [])]


def joined_whole(actual, expected, key, columns):
    """The comparison over whole rows: ``(key, status, changed)``, once for each pair of rows."""
    got = []
    a, e = (df.select(F.col(key).alias(f"key_{side}"), F.struct(*(c for c in df.columns if c != key)).alias(side))
            for df, side in ((actual, "a"), (expected, "e")))
    for r in a.join(e, F.col("key_a") == F.col("key_e"), "full_outer").select(
            "key_a", "key_e", F.col("a").isNull().alias("gone"), F.col("e").isNull().alias("new"),
            *(F.col(f"a.{c}").eqNullSafe(F.col(f"e.{c}")).alias(c) for c in columns)).collect():
        changed = [c for c in columns if not r[c]]
        if r["new"] or r["gone"]:
            got.append((r["key_a"] if r["new"] else r["key_e"], "extra" if r["new"] else "missing", []))
        elif changed:
            got.append((r["key_a"], "changed", changed))
    return sorted(got, key=str)


def test_snapshot_diff_shuffles_whole_rows_only_where_digests_differ(spark, monkeypatch):
    seen, kept = [], audit.kept
    monkeypatch.setattr(audit, "kept", lambda df, purpose: (
        seen.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, purpose))[1])
    a = stored_frame(spark, [dict(eventId=f"e{i}", path="/") for i in range(9)]).drop("arrival_seq")
    found = audit.snapshot_diff(a, a.withColumn("path", F.when(F.col("eventId") != "e3", "/")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert rows_of(found, "eventId", "status", "changed") == [("e3", "changed", ["path"])]
    assert "FullOuter" not in plan and "LeftSemi" in plan
    assert "sha2" in seen[0] and "FullOuter" in seen[0] and "<=>" not in seen[0]


def test_snapshot_diff_of_odd_rows(spark, monkeypatch):
    """Nulls and bounds of texts, ids that repeat or are null, zeros, types that differ, long fractions."""
    schema = "id string, s string, t string, n int, d double, x {}, at timestamp, l array<int>"
    when = at("2024-10-27T00:30:00")
    mine = [
        ("a", "x", None, 1, 0.0, 1, when, [1]), ("b", "ab", "c", None, float("nan"), 2, None, None),
        ("c", None, "x", 1, -0.0, 3, when, []), ("d", "", None, 1, 1.0, 4, when, [None]),
        ("d", "1,", "2", 1, 1.0, 4, when, [1, 2]), ("e", "same", "same", 7, 0.1, 0, when, [1]),
        (None, "x", "x", 1, 1.0, 1, when, [1]), ("only", None, None, None, None, None, None, None)]
    theirs = [
        ("a", None, "x", 1, -0.0, 1, when, [1]), ("b", "a", "bc", None, float("nan"), 2, None, None),
        ("c", None, "x", 1, 0.0, 3, when, None), ("d", None, "", 1, 1.0, 4, when, [None]),
        ("d", "1", ",2", 1, 1.0, 4, when, [1, 2]), ("d", "1,", "2", 1, 1.0, 4, when, [1, 2]),
        ("e", "same", "same", 7, 0.1, 0, when + timedelta(hours=1), [1]),
        (None, "x", "x", 1, 1.0, 1, when, [1]), ("new", None, None, None, None, None, None, None)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    for theirs_type, most, place in (("int", 100, "UTC"), ("bigint", 0, "UTC"), ("int", 100, "Europe/Berlin")):
        monkeypatch.setattr(audit, "MOST_DIFFERING", most)
        spark.conf.set("spark.sql.session.timeZone", place)
        try:
            a = spark.createDataFrame(mine, schema.format("int"))
            e = spark.createDataFrame(theirs, schema.format(theirs_type))
            got = rows_of(audit.snapshot_diff(a, e, "id", ()), "id", "status", "changed")
            want = joined_whole(a, e, "id", a.columns[1:])
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)
        assert sorted(got, key=str) == want
        assert ("a", "changed", ["s", "t"]) in want and ("e", "changed", ["at"]) in want and len(want) > 10


def test_flag_sequence(spark):
    events = [raw(i, timestamp=millis(i * 4000)) for i in range(25)]
    events += [raw(100 + i, clientIp="10.0.0.2") for i in range(3)]
    # A pause longer than the window, then one lone event.
    events += [raw(200, timestamp=millis(5_000_000))]
    flagged = repeat_offender(raw_frame(spark, events), Policy())
    got = sorted(rows_of(audit.flag_sequence(flagged, span=8), "clientIp", "events", "flagged",
                         "first_flagged", "unflagged_after"))
    assert got == [("10.0.0.1", 26, 20, 6, 1), ("10.0.0.2", 3, 0, None, None)]
    assert audit.flagged_count(flagged).first()[0] == 20


def test_bursts(spark):
    events = [raw(i, path="/a", timestamp=millis(i * 4000)) for i in range(25)]
    events += [raw(50 + i, path="/b", timestamp=millis(i * 200_000)) for i in range(6)]
    events += [raw(80 + i, path="/c", timestamp=millis(0)) for i in range(5)]
    df = raw_frame(spark, events)
    assert rows_of(audit.bursts(df), "path", "events", "span_ms") == [("/a", 25, 96_000)]
    assert audit.bursts(df, within=timedelta(seconds=10)).count() == 0


def test_burst_islands(spark):
    """Against one pass over sorted events: a client with half of all rows and many waves, waves
    over chunk edges, stray events between waves, equal times, nulls."""
    r = random.Random(8)
    events, seq = [], 0
    for ip in ("10.0.0.1", "10.0.0.2", None):
        at = -3_000_000
        for _ in range(260 if ip == "10.0.0.1" else 60):
            at += r.choice([0, 4_000, 4_000, 60_000, 200_000, 599_999, 600_000, 600_001, 5_000_000])
            events.append(raw(seq, clientIp=ip, timestamp=millis(at)))
            seq += 1
    events.append(raw(seq, timestamp=None))
    want = []
    for ip in ("10.0.0.1", "10.0.0.2"):
        times = sorted(int(e["timestamp"].timestamp() * 1000 + 0.5) if e["timestamp"].timestamp() >= 0 else
                       -int(-e["timestamp"].timestamp() * 1000 + 0.5)
                       for e in events if e["clientIp"] == ip and e["timestamp"])
        waves = [[times[0]]]
        for t in times[1:]:
            if t - waves[-1][-1] > 600_000:
                waves.append([])
            waves[-1].append(t)
        for w in waves:
            densest = max(sum(t - 600_000 <= u <= t for u in w) for t in w)
            if densest > 5:
                want.append((ip, len(w), w[-1] - w[0], densest))
    found = audit.burst_islands(raw_frame(spark, events), keys=["clientIp"])
    assert sorted(rows_of(found, "clientIp", "events", "span_ms", "densest")) == sorted(want)
    assert len(want) > 4
    assert audit.burst_islands(raw_frame(spark, events[:0])).count() == 0
    with pytest.raises(ValueError):
        audit.burst_islands(raw_frame(spark, events), gap=timedelta(seconds=1))
