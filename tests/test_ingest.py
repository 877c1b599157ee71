import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from helpers import at, raw, raw_frame, rows_of
from palisade.operators import table, validate
from palisade.operators.validate import batch_errors, ledger, split_batches, with_errors
from palisade.plans.ingest import accepted_events, stored_events, valid_events
from palisade.policy import Policy
from palisade.schema import CSV_COLUMNS, ENRICHED_SCHEMA, EVENT_SCHEMA
from palisade.session import settings
from palisade.sources import files, payloads, store


def errors(spark, **changes):
    return with_errors(raw_frame(spark, [raw(0, **changes)])).first()["errors"]


def test_valid_event_has_no_errors(spark):
    assert errors(spark) == []
    assert errors(spark, rule=dict(category="injection")) == []
    assert errors(spark, rule=dict(category=" Xss\t")) == []
    assert errors(spark, policyId=None, userAgent=None, geoLocation=None) == []


@pytest.mark.parametrize("changes,want", [
    (dict(eventId=None), ["eventId is required"]),
    (dict(eventId="\t"), ["eventId is required"]),
    (dict(rule=None), ["rule is required"]),
    (dict(rule=dict(id=None)), ["rule.id is required"]),
    (dict(rule=dict(category="  ")), ["rule.category is required"]),
    (dict(rule=dict(severity=None, action=None)),
     ["rule.severity is required", "rule.action is required"]),
])
def test_missing_fields(spark, changes, want):
    assert errors(spark, **changes) == want


def test_vocabularies(spark):
    [message] = errors(spark, rule=dict(category="FOOBAR"))
    assert message.startswith("rule.category 'FOOBAR' is not an allowed attack category; allowed:")
    assert "RATE_LIMIT" in message
    [message] = errors(spark, rule=dict(severity="high"))
    assert message.startswith("rule.severity 'high' is not one of")


def test_all_errors_are_accumulated(spark):
    nothing = {c: None for c in EVENT_SCHEMA.fieldNames()}
    got = errors(spark, **nothing)
    assert len(got) == 9 and got[0] == "eventId is required" and got[-1] == "rule is required"


def batches(spark, n, bad=()):
    df = raw_frame(spark, [raw(i, hostname=None if i in bad else "h") for i in range(n)])
    return with_errors(df.withColumn("batch_id", F.expr("arrival_seq div 50")))


def test_batches_all_accepted(spark):
    df = batches(spark, 120)
    assert rows_of(ledger(df), "total_events", "batches_sent", "batches_failed", "accepted") == [
        (120, 3, 0, 120)]
    accepted, rejected = split_batches(df)
    assert (accepted.count(), rejected.count()) == (120, 0)


@pytest.mark.parametrize("span", [8, 1_000_000])
def test_one_bad_event_rejects_its_batch_only(spark, span):
    df = batches(spark, 150, bad=(63, 99))
    assert rows_of(ledger(df), "total_events", "batches_sent", "batches_failed", "accepted") == [
        (150, 2, 1, 100)]
    accepted, rejected = split_batches(df, span=span)
    assert {r["batch_id"] for r in accepted.collect()} == {0, 2} and accepted.count() == 100
    assert {r["batch_id"] for r in rejected.collect()} == {1} and rejected.count() == 50
    assert sorted(rows_of(batch_errors(df, span=span), "batch_id", "index")) == [(1, 13), (1, 49)]
    assert accepted_events(df.drop("errors")).count() == 100


def test_events_without_a_batch_are_not_lost(spark):
    df = batches(spark, 10).withColumn("batch_id", F.lit(None).cast("bigint"))
    accepted, rejected = split_batches(df)
    assert (accepted.count(), rejected.count()) == (10, 0)


def test_empty_ledger(spark):
    assert rows_of(ledger(batches(spark, 1).limit(0)), "total_events", "accepted") == [(0, 0)]


def body_of(*events):
    def plain(event):
        kept = {k: v for k, v in event.items() if k != "arrival_seq" and v is not None}
        kept["timestamp"] = event["timestamp"].isoformat() if event["timestamp"] else None
        return kept
    return json.dumps([plain(e) for e in events])


def parse(spark, bodies):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id bigint, body string")
    return payloads.parse_payloads(df)


def test_payload_shapes(spark):
    lone = body_of(raw(0))[1:-1]
    parsed = parse(spark, [lone, body_of(raw(1), raw(2)), " " + lone])
    got = sorted(rows_of(payloads.accepted_events(parsed), "id", "index", "eventId"))
    assert got == [(0, 0, "e0"), (1, 0, "e1"), (1, 1, "e2"), (2, 0, "e0")]
    event = payloads.accepted_events(parsed).where("id = 0").first()
    assert event["timestamp"].astimezone(timezone.utc) == at("2026-07-10T10:00:00") or \
        event["timestamp"] == datetime(2026, 7, 10, 10)
    assert event["rule"]["category"] == "INJECTION" and event["geoLocation"]["city"] == "New York"
    assert payloads.rejected_bodies(parsed).count() == 0


@pytest.mark.parametrize("body,reason", [
    ("{bad", payloads.MALFORMED_BODY),
    ("", payloads.MALFORMED_BODY),
    (None, payloads.MALFORMED_BODY),
    ("[1]", payloads.MALFORMED_BODY),
    ('[{"eventId":"a"},5]', payloads.MALFORMED_BODY),
    ('{"configId":"abc"}', payloads.MALFORMED_BODY),
    ('{"timestamp":"2026-07-10"}', payloads.MALFORMED_BODY),
    ('{"rule":{"severity":"SEVERE"}}', payloads.MALFORMED_BODY),
    ('{"rule":{"action":"deny"}}', payloads.MALFORMED_BODY),
    ('{"rule":7}', payloads.MALFORMED_BODY),
    ('{"geoLocation":"US"}', payloads.MALFORMED_BODY),
    ("[]", payloads.EMPTY_BODY),
    ("17", payloads.EMPTY_BODY),
    ("null", payloads.EMPTY_BODY),
    ('"text"', payloads.EMPTY_BODY),
])
def test_refused_bodies(spark, body, reason):
    parsed = parse(spark, [body])
    assert rows_of(payloads.rejected_bodies(parsed), "rejection", "failures") == [(reason, [])]
    assert payloads.accepted_events(parsed).count() == 0


def test_second_event_invalid_rejects_the_body(spark):
    parsed = parse(spark, [body_of(raw(0), raw(1, hostname=" ", path=None)), "[null]"])
    assert payloads.accepted_events(parsed).count() == 0
    assert sorted(rows_of(payloads.rejection_report(parsed, "id"), "id", "index", "messages")) == [
        (0, 1, ["hostname is required", "path is required"]),
        (1, 0, ["event must not be null"])]


def test_unknown_keys_and_server_fields_are_ignored(spark):
    body = json.loads(body_of(raw(0)))[0]
    body.update(colour="red", threatScore="mine", receivedAt="yesterday")
    event = payloads.accepted_events(parse(spark, [json.dumps(body)])).first()
    assert event["threatScore"] is None and event["receivedAt"] is None


def test_receive_stamp_replaces_the_client_value(spark):
    df = raw_frame(spark, [raw(0, receivedAt=at("2000-01-01T00:00:00")), raw(1)])
    instant = F.timestamp_millis(F.lit(86_400_000))
    assert {r[0] for r in validate.stamp_received(df, instant).select(
        F.unix_millis("receivedAt")).collect()} == {86_400_000}
    assert validate.stamp_received(df).select("receivedAt").distinct().count() == 1


def sparse(seq):
    return raw(seq, policyId=None, userAgent=None, requestSize=None, responseSize=None,
               rule=dict(message=None), geoLocation=None)


@pytest.mark.parametrize("name", ["events.JSON", "events.jsonl", "events.csv"])
def test_round_trip(spark, tmp_path, name):
    """What is written is read back by default, in order, whatever the cells hold."""
    odd = [raw(n, hostname=text, path=text, userAgent=text, rule=dict(message=text))
           for n, text in enumerate([
               "  a  ", "two\nlines", "quote \" and, comma", "\ttab\t", "back\\slash", "a\r\nb", "é"])]
    full = raw(7, policyId="p", requestSize=7, responseSize=8,
               timestamp=at("2026-07-10T10:00:00.123456"))
    df = raw_frame(spark, [*odd, full, sparse(8)])
    path = str(tmp_path / name)
    files.write_events(df.drop("arrival_seq").coalesce(1), path)
    back = files.read_events(spark, path)
    assert back.schema.fieldNames() == [*EVENT_SCHEMA.fieldNames(), "arrival_seq"]
    want = df.drop("repeatOffender").collect()
    assert sorted(back.drop("repeatOffender").collect(), key=lambda r: r["arrival_seq"]) == want


@pytest.mark.parametrize("name", ["many.jsonl", "many.csv", "many.json"])
def test_arrival_follows_the_order_of_the_files(spark, tmp_path, name):
    """Several files, each read in several splits."""
    path = str(tmp_path / name)
    df = raw_frame(spark, [raw(n) for n in range(2000)])
    df.repartitionByRange(5, "arrival_seq").sortWithinPartitions("arrival_seq").transform(
        lambda d: files.write_events(d, path) or d)
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "20000"}):
        got = rows_of(files.read_events(spark, path, line_breaks=False), "arrival_seq", "eventId")
    assert sorted(got) == [(n, f"e{n}") for n in range(2000)]


def test_nothing_after_an_array_is_lost(spark, tmp_path):
    path = tmp_path / "events.json"
    path.write_text(body_of(raw(0)) + body_of(raw(1)))
    with pytest.raises(Exception, match="not one JSON array"):
        files.read_events(spark, str(path)).collect()
    folder = tmp_path / "arrays.json"
    folder.mkdir()
    for n in range(3):
        (folder / f"{n}.json").write_text(body_of(raw(2 * n), raw(2 * n + 1)))
    assert sorted(rows_of(files.read_events(spark, str(folder)), "arrival_seq", "eventId")) == [
        (n, f"e{n}") for n in range(6)]


def test_json_array_over_many_lines(spark, tmp_path):
    path = tmp_path / "events.json"
    path.write_text(json.dumps(json.loads(body_of(raw(0), raw(1))), indent=2))
    assert sorted(rows_of(files.read_events(spark, str(path)), "eventId")) == [("e0",), ("e1",)]


def test_csv_header_and_cells(spark, tmp_path):
    path = tmp_path / "events.csv"
    cells = ["e1", " 2026-07-10T10:00:00Z ", " 5 ", "", "1.2.3.4", "h", "/", "GET", "x", "", "", "",
             "r", "n", "", " HIGH ", " BOT", "DENY", "", "Rome"]
    path.write_text(",".join(CSV_COLUMNS) + "\n" + ",".join(cells) + "\n")
    event = files.read_events(spark, str(path)).first()
    assert (event["configId"], event["policyId"], event["statusCode"]) == (5, None, None)
    assert (event["rule"]["severity"], event["rule"]["category"], event["rule"]["message"]) == (
        "HIGH", " BOT", None)
    assert tuple(event["geoLocation"]) == (None, "Rome") and event["repeatOffender"] is False
    assert CSV_COLUMNS[11:13] == ["responseSize", "rule.id"] and len(CSV_COLUMNS) == 20


def test_unknown_extension_is_refused(spark):
    for path in ("events.xml", "events"):
        with pytest.raises(ValueError):
            files.read_events(spark, path)


def test_flatten(spark):
    flat = table.flatten(raw_frame(spark, [raw(0), raw(1, rule=None, geoLocation=None)]))
    assert flat.schema.fieldNames() == ENRICHED_SCHEMA.fieldNames() and len(flat.columns) == 24
    rows = {r["eventId"]: r for r in flat.collect()}
    assert rows["e0"]["ruleSeverity"] == "HIGH" and rows["e0"]["geoCity"] == "New York"
    assert rows["e1"]["ruleId"] is None and rows["e1"]["repeatOffender"] is False


def test_chronological_export(spark):
    df = raw_frame(spark, [raw(2), raw(1), raw(0, timestamp=at("2027-01-01T00:00:00"))])
    assert rows_of(files.chronological(df), "arrival_seq") == [(1,), (2,), (0,)]


def test_store_shows_the_latest_and_retries_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "table")
    first = stored_events(raw_frame(spark, [raw(i) for i in range(5)]))
    newer = first.where("arrival_seq < 2").withColumns(
        {"statusCode": F.lit(500), "arrival_seq": F.col("arrival_seq") + 100})
    for _ in range(2):  # the second round is a retried micro-batch
        store.upsert(first, path, "feed", 0)
        store.upsert(newer, path, "feed", 1)
    got = store.read_table(spark, path)
    assert sorted(rows_of(got, "eventId", "statusCode")) == [
        ("e0", 500), ("e1", 500), ("e2", 200), ("e3", 200), ("e4", 200)]
    assert spark.read.parquet(path).count() == 7

    compacted = str(tmp_path / "compacted")
    store.compact(spark, path, compacted)
    assert spark.read.parquet(compacted).count() == 5
    assert store.read_compacted(spark, compacted, end=at("2026-07-10T23:00:00")).count() == 5
    pruned = store.read_compacted(spark, compacted, start=at("2026-07-11T00:00:00"))
    assert pruned.count() == 0
    assert "PartitionFilters: [isnotnull(event_date" in (
        pruned._jdf.queryExecution().executedPlan().toString())

    since = str(tmp_path / "since")
    store.upsert(first.where("arrival_seq = 4").withColumns(
        {"statusCode": F.lit(404), "arrival_seq": F.lit(200).cast("bigint")}), since)
    merged = store.read_table(spark, since, base=compacted)
    assert sorted(rows_of(merged, "eventId", "statusCode")) == [
        ("e0", 500), ("e1", 500), ("e2", 200), ("e3", 200), ("e4", 404)]

    assert store.clear(spark, path) == (5, 0)
    assert store.read_table(spark, path).count() == 0


def test_writers_never_replace_each_other(spark, tmp_path):
    path = str(tmp_path / "table")
    stored = stored_events(raw_frame(spark, [raw(i, clientIp=f"10.0.0.{i}") for i in range(8)]))
    store.upsert(stored.where("arrival_seq < 5"), path)
    store.upsert(stored.where("arrival_seq >= 5"), path)
    store.upsert(stored.where("arrival_seq = 0"), path, "w", 0)
    assert store.read_table(spark, path).count() == 8


def test_ranges_are_exact(spark, tmp_path):
    path, compacted = str(tmp_path / "table"), str(tmp_path / "compacted")
    hours = [raw(i, timestamp=at(f"2026-07-10T{i:02d}:00:00")) for i in range(20)]
    store.upsert(stored_events(raw_frame(spark, hours)), path)
    store.compact(spark, path, compacted)
    bounds = at("2026-07-10T03:00:00"), at("2026-07-10T05:00:00")
    for rows in (store.read_table(spark, path, *bounds),
                 store.read_compacted(spark, compacted, *bounds),
                 store.read_table(spark, str(tmp_path / "table"), *bounds, base=compacted)):
        assert sorted(rows_of(rows, "eventId")) == [("e3",), ("e4",), ("e5",)]


def test_rows_without_an_id_are_all_stored(spark):
    df = raw_frame(spark, [raw(0, eventId=None), raw(1, eventId=None), raw(2), raw(3, eventId="e2")])
    assert sorted(rows_of(table.latest(df), "arrival_seq")) == [(0,), (1,), (3,)]


@pytest.mark.parametrize("text,status", [
    ("200", 200), ("200.0", 200), ("2e2", 200), ('"200"', 200), ('" 200 "', 200)])
def test_spellings_of_a_number(spark, text, status):
    body = body_of(raw(0)).replace('"statusCode": 200', f'"statusCode": {text}')
    assert text in body
    assert payloads.accepted_events(parse(spark, [body])).first()["statusCode"] == status


def test_a_fraction_is_no_status_code_and_seconds_are_a_timestamp(spark):
    body = body_of(raw(0))
    half = body.replace('"statusCode": 200', '"statusCode": 200.5')
    assert rows_of(payloads.rejected_bodies(parse(spark, [half])), "rejection") == [
        (payloads.MALFORMED_BODY,)]
    late = json.loads(body)
    late[0]["timestamp"] = 86400.5
    event = payloads.accepted_events(parse(spark, [json.dumps(late)])).select(
        F.unix_millis("timestamp")).first()
    assert event[0] == 86_400_500


def test_the_snippet_of_the_readme(spark, tmp_path):
    files.write_events(raw_frame(spark, [raw(i) for i in range(9)]).drop("arrival_seq"),
                       str(tmp_path / "events.jsonl"))
    events = files.read_events(spark, str(tmp_path / "events.jsonl"))
    stored = stored_events(valid_events(events), Policy())
    assert stored.where("repeatOffender").count() == 4


def test_valid_events(spark):
    df = raw_frame(spark, [raw(0), raw(1, path=" ")])
    assert rows_of(valid_events(df, Policy()), "eventId") == [("e0",)]


def test_copies_are_reduced_before_the_shuffle(spark):
    plan = table.latest(raw_frame(spark, [raw(0)]))._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan
