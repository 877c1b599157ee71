import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from helpers import fold, millis, raw, raw_frame, rows_of
from palisade.operators.enrich import enrich
from palisade.policy import Policy
from palisade.sources import store
from palisade.streaming import pipeline
from palisade.session import settings
from palisade.streaming.processor import STATE_SETTINGS, flag_stream

W = 600_000


def write_files(spark, events, path, n):
    """One JSON Lines file per part, in arrival order."""
    path.mkdir()
    names = [f.name for f in raw_frame(spark, events[:1]).schema.fields]
    size = -(-len(events) // n)
    for part in range(n):
        lines = []
        for event in events[part * size:(part + 1) * size]:
            plain = {c: event[c] for c in names}
            plain["timestamp"] = event["timestamp"].isoformat() if event["timestamp"] else None
            lines.append(json.dumps(plain))
        file = path / f"part-{part}.json"
        file.write_text("\n".join(lines))
        # A file stream goes by the time of change; files written at once would tie.
        os.utime(file, (time.time() + part - n, time.time() + part - n))


def shuffled_events(n, seed, ids=None):
    rng = random.Random(seed)
    return [raw(s, eventId=f"e{s if ids is None else rng.randrange(ids)}",
                clientIp=f"10.0.0.{rng.randrange(3)}",
                timestamp=millis(1_700_000_000_000 + rng.randrange(3_000_000)))
            for s in range(n)]


def expected_flags(events):
    counts = fold([(e["arrival_seq"], e["clientIp"], e["eventId"],
                    int(e["timestamp"].timestamp() * 1000)) for e in events], W)
    return {seq: count > 5 for seq, count in counts.items()}


def test_stateful_form_in_batch_equals_fold(spark):
    events = shuffled_events(200, 1, ids=120)
    with pytest.raises(ValueError, match="RocksDB"):
        flag_stream(raw_frame(spark, events), Policy(), "None")
    with settings(spark, STATE_SETTINGS):
        flagged = flag_stream(raw_frame(spark, events), Policy(), "None").collect()
    assert {r["arrival_seq"]: r["repeatOffender"] for r in flagged} == expected_flags(events)


def test_windows_of_a_client_of_each_configuration(spark):
    """Keys that only run together as text stay apart."""
    rng = random.Random(4)
    events = [raw(s, configId=rng.choice([1, 11]), clientIp=rng.choice(["1", "11", '1","1']),
                  timestamp=millis(1_700_000_000_000 + s * 20_000)) for s in range(240)]
    with settings(spark, STATE_SETTINGS):
        flagged = flag_stream(raw_frame(spark, events), Policy(), "None", keys=[
            "configId", "clientIp"]).collect()
    counts = fold([(e["arrival_seq"], (e["configId"], e["clientIp"]), e["eventId"],
                    int(e["timestamp"].timestamp() * 1000)) for e in events], W)
    flags = {r["arrival_seq"]: r["repeatOffender"] for r in flagged}
    assert flags == {seq: n > 5 for seq, n in counts.items()} and len(set(flags.values())) == 2


def test_pipeline_over_micro_batches(spark, tmp_path):
    """Late events and poison events over three micro-batches, with idle expiry on."""
    events = shuffled_events(180, 2)
    poison = [raw(1000, hostname=" "), raw(1001, clientIp=None), raw(1002, rule=None)]
    write_files(spark, events[:90] + poison + events[90:], tmp_path / "in", 3)
    source = pipeline.event_stream(spark, str(tmp_path / "in"), max_files=1)
    main = pipeline.run(source, str(tmp_path / "table"), str(tmp_path / "c1"),
                        trigger=pipeline.DRAIN)
    aside = pipeline.run_quarantine(
        pipeline.invalid_events(source), str(tmp_path / "dead"), str(tmp_path / "c2"),
        pipeline.DRAIN)
    pipeline.drain(main, aside)
    assert len([p for p in main.recentProgress if p["numInputRows"] > 0]) == 3

    got = store.read_table(spark, str(tmp_path / "table"))
    assert {int(r["eventId"][1:]): r["repeatOffender"] for r in got.collect()} == (
        expected_flags(events))
    assert got.where("receivedAt is null").count() == 0
    dead = spark.read.parquet(str(tmp_path / "dead"))
    assert sorted(rows_of(dead, "arrival_seq", "errors")) == [
        (1000, ["hostname is required"]), (1001, ["clientIp is required"]),
        (1002, ["rule is required"])]


def test_stream_equals_batch_replay_on_retries(spark, tmp_path):
    events = shuffled_events(120, 3, ids=70)
    write_files(spark, events, tmp_path / "in", 2)
    pipeline.drain(pipeline.run(
        pipeline.event_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "table"),
        str(tmp_path / "c"), trigger=pipeline.DRAIN, time_mode="None", stamp=False))
    got = store.read_table(spark, str(tmp_path / "table"))
    last = {e["eventId"]: e["arrival_seq"] for e in events}
    flags = expected_flags(events)
    assert {r["eventId"]: r["repeatOffender"] for r in got.collect()} == {
        i: flags[seq] for i, seq in last.items()}
    batch = enrich(raw_frame(spark, events), Policy(), "arrival")
    assert dict(rows_of(batch, "arrival_seq", "threatScore")) == {
        s: 50 + 15 * f for s, f in flags.items()}


def test_idle_client_expires_after_the_ttl(spark, tmp_path):
    """A silent hour of the test: the window is forgotten although event time stands still."""
    from dataclasses import replace
    from datetime import timedelta
    policy = replace(Policy(), threshold=1, state_ttl=timedelta(seconds=1))
    source, table, check = (str(tmp_path / x) for x in ("in", "table", "c"))
    write_files(spark, [raw(0), raw(1)], tmp_path / "in", 1)
    run = lambda: pipeline.drain(pipeline.run(
        pipeline.event_stream(spark, source), table, check, policy, pipeline.DRAIN))
    run()
    time.sleep(2)
    (tmp_path / "in" / "part-9.json").write_text(json.dumps(
        {**raw(2), "timestamp": raw(2)["timestamp"].isoformat()}))
    run()
    got = dict(rows_of(store.read_table(spark, table), "eventId", "repeatOffender"))
    assert got == {"e0": False, "e1": True, "e2": False}


def test_only_touched_buckets_are_written(spark, tmp_path):
    """A minute of a client's window is a bucket. One more event writes its own bucket, an event
    that ends half the window removes what has left, and a client's state stays whole."""
    start = 1_700_000_040_000                    # a full minute
    many = [raw(n, timestamp=millis(start + n * 1000)) for n in range(600)]
    one = [raw(600, timestamp=millis(start + 90_000))]
    moved = [raw(601, eventId="e600", timestamp=millis(start + 300_000))]
    later = [raw(602, timestamp=millis(start + 300_000 + W))]
    source, check = tmp_path / "in", str(tmp_path / "c")
    writes = []
    for n, events in enumerate((many, one, moved, later)):
        write_files(spark, events, tmp_path / f"part{n}", 1)
        source.mkdir(exist_ok=True)
        (tmp_path / f"part{n}" / "part-0.json").rename(source / f"{n}.json")
        run = pipeline.run(
            pipeline.event_stream(spark, str(source)), str(tmp_path / "table"), check,
            trigger=pipeline.DRAIN, time_mode="None", stamp=False)
        pipeline.drain(run)
        writes.append([(o["numRowsUpdated"], o["numRowsRemoved"]) for p in run.recentProgress
                       if p["numInputRows"] for o in p["stateOperators"]])
    state = spark.read.format("statestore").option("stateVarName", "buckets").load(check)
    held = {r["s"]: r["n"] for r in state.select("user_map_key.start", F.size("user_map_value.ids")).toDF("s", "n").collect()}
    assert writes[0] == [(10, 0)] and writes[1] == [(1, 0)] and writes[2] == [(2, 0)]
    assert writes[3] == [(1, 5)]
    assert held == {**{start + m * 60_000: 60 + (m == 5) for m in range(5, 10)},
                    start + 300_000 + W: 1}
    flags = expected_flags([*many, *one, *moved, *later])
    got = store.read_table(spark, str(tmp_path / "table"))
    assert {r["arrival_seq"]: r["repeatOffender"] for r in got.collect()} == {
        seq: flag for seq, flag in flags.items() if seq != 600}


def test_a_busy_client_keeps_quiet_buckets(spark, tmp_path):
    """Silence is the client's, not a bucket's: old members count as long as it is heard."""
    from dataclasses import replace
    from datetime import timedelta
    policy = replace(Policy(), threshold=3, state_ttl=timedelta(seconds=12))
    source, table, check = (str(tmp_path / x) for x in ("in", "table", "c"))
    write_files(spark, [raw(0, timestamp=millis(1_700_000_000_000))], tmp_path / "in", 1)
    for n in range(1, 4):
        pipeline.drain(pipeline.run(
            pipeline.event_stream(spark, source), table, check, policy, pipeline.DRAIN))
        time.sleep(5)
        event = raw(n, timestamp=millis(1_700_000_000_000 + n * 120_000))
        (tmp_path / "in" / f"part-{n}.json").write_text(json.dumps(
            {**event, "timestamp": event["timestamp"].isoformat()}))
    pipeline.drain(pipeline.run(
        pipeline.event_stream(spark, source), table, check, policy, pipeline.DRAIN))
    got = dict(rows_of(store.read_table(spark, table), "eventId", "repeatOffender"))
    assert got == {"e0": False, "e1": False, "e2": False, "e3": True}


def test_payload_stream(spark, tmp_path):
    """Bodies are accepted or refused whole; both outcomes come from one source."""
    source = tmp_path / "bodies"
    source.mkdir()

    def body(*events):
        return json.dumps([{k: (v.isoformat() if k == "timestamp" else v) for k, v in e.items()
                            if k != "arrival_seq" and v is not None} for e in events])

    bodies = [body(*(raw(i, timestamp=millis(i)) for i in range(8))),
              body(raw(20), raw(21, path=None)), "{bad"]
    (source / "a.json").write_text("\n".join(
        json.dumps({"arrival_seq": n, "body": b}) for n, b in enumerate(bodies)))
    stream = spark.readStream.schema("arrival_seq bigint, body string").json(str(source))
    events, refused = pipeline.payload_events(stream)
    pipeline.drain(
        pipeline.run(events, str(tmp_path / "table"), str(tmp_path / "c1"),
                     trigger=pipeline.DRAIN),
        pipeline.run_quarantine(refused, str(tmp_path / "dead"), str(tmp_path / "c2"),
                                pipeline.DRAIN))
    got = store.read_table(spark, str(tmp_path / "table"))
    assert sorted(rows_of(got, "eventId", "repeatOffender")) == [
        (f"e{i}", i >= 5) for i in range(8)]
    assert sorted(rows_of(spark.read.parquet(str(tmp_path / "dead")), "arrival_seq")) == [
        (1,), (2,)]


def test_a_new_checkpoint_adds_and_clear_counts(spark, tmp_path):
    """A second stream starts at epoch 0 again; neither its rows nor the first one's go."""
    table = str(tmp_path / "table")
    for part in ("a", "b"):
        events = [raw(n, eventId=f"{part}{n}", clientIp=f"10.0.0.{n % 3}") for n in range(5)]
        write_files(spark, events, tmp_path / part, 1)
        pipeline.drain(pipeline.run(
            pipeline.event_stream(spark, str(tmp_path / part)), table, str(tmp_path / f"c{part}"),
            trigger=pipeline.DRAIN, time_mode="None", stamp=False))
    assert store.read_table(spark, table).count() == 10
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert store.clear(spark, table, str(tmp_path / "cb")) == (10, 3)
    assert not (tmp_path / "cb").exists() and store.read_table(spark, table).count() == 0


def test_log_order_is_unique_and_keeps_partitions_in_order(spark):
    df = spark.range(60).selectExpr("id div 3 AS offset", "id % 3 AS part")
    got = rows_of(df.select("offset", "part", pipeline.log_order("offset", "part", 3).alias("n")),
                  "part", "offset", "n")
    assert len({n for _, _, n in got}) == 60
    for part in range(3):
        mine = sorted((o, n) for p, o, n in got if p == part)
        assert [n for _, n in mine] == sorted(n for _, n in mine)
