"""What must not grow with the table: tasks that hold a file, shuffles by a few keys."""
from pyspark.sql import functions as F

from helpers import at, raw, raw_frame, rows_of
from palisade.operators import table
from palisade.plans import catalog
from palisade.policy import Policy
from palisade.session import settings
from palisade.sources import files
from palisade.streaming.processor import STATE_SETTINGS, flag_stream

SF = "/root/testdata/sf0.001"


def written(monkeypatch):
    """The folders that a query reads its events back from."""
    seen, read = [], files.read_events
    monkeypatch.setattr(files, "read_events", lambda spark, path, *a, **k: (
        seen.append(path), read(spark, path, *a, **k))[1])
    return seen


def tasks_of(spark, folder):
    return spark.read.text(folder).select("_metadata.file_path").distinct().count()


def test_files_of_arrays_grow_in_number(spark, monkeypatch):
    seen = written(monkeypatch)
    monkeypatch.setattr(catalog, "FILE_ROWS", 100, raising=False)
    found = catalog.QUERIES["scan_json_array"](spark, SF)
    rows = catalog._events(spark, SF).count()
    assert tasks_of(spark, seen[0]) == -(-rows // 100) > 3
    assert sorted(r[0] for r in found.select("arrival_seq").collect()) == list(range(rows))


def test_records_are_not_dealt_out_by_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"eventId": "x"}, {"eventId": "y"}]')
    plan = files.read_events(spark, str(tmp_path / "a.json"), array=True)._jdf.queryExecution(
        ).executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_state_operator_is_given_few_columns(spark):
    with settings(spark, STATE_SETTINGS):
        flagged = flag_stream(raw_frame(spark, [raw(0)]), Policy(), "None")
        plan = flagged._jdf.queryExecution().optimizedPlan().toString()
    state = next(line for line in plan.splitlines() if "TransformWithState" in line)
    assert "_payload" in state and "userAgent" not in state


def test_events_pass_the_state_operator_unchanged(spark):
    odd = ["", " \t\r\n", 'q"uo\\te', "\u0000\u0001\u007f ", "é🙂", "null", "{}"]
    events = [raw(i, path=text, userAgent=text, configId=2 ** 63 - 1, requestSize=-2 ** 63, geoLocation=geo,
                  timestamp=at("2026-07-10T10:00:00").replace(microsecond=123457),
                  receivedAt=None if i % 2 else at("1601-02-03T04:05:06").replace(microsecond=1))
              for i, (text, geo) in enumerate(
                  (t, g) for t in odd for g in (None, dict(country=None, city=None), dict(country=t, city=None)))]
    events += [raw(900, eventId=None, rule=None), raw(901, clientIp=" ", timestamp=None)]
    df = raw_frame(spark, events).withColumns({"d": F.lit("1.10").cast("decimal(9,4)"), "x": F.lit(0.1) + 0.2})
    with settings(spark, STATE_SETTINGS):
        flagged = flag_stream(df, Policy(), "None").drop("repeatOffender")
    columns = [c for c in df.columns if c != "repeatOffender"]
    assert flagged.columns == columns
    assert flagged.exceptAll(df.select(columns)).count() == 0 and flagged.count() == len(events)


def test_whole_rows_are_ranked_only_where_ids_come_again(spark, monkeypatch):
    unique = table.first_arrival(raw_frame(spark, [raw(i) for i in range(9)]))
    plan = unique._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan and unique.count() == 9
    twice = raw_frame(spark, [raw(i, eventId=f"e{i % 5}", userAgent="x" * i) for i in range(8)] + [
        raw(7, eventId="e2", userAgent="x" * 7), raw(8, eventId=None), raw(9, eventId=None), raw(9, eventId=None),
        raw(10, eventId=" "), raw(11, eventId=" "), raw(12, clientIp=None), raw(13, clientIp=None)])
    for most in (100, 1):
        monkeypatch.setattr(table, "MOST_REPEATED", most)
        first = table.first_arrival(twice)
        assert sorted(rows_of(first, "arrival_seq")) == [(n,) for n in (0, 1, 2, 3, 4, 8, 9, 10, 11, 12, 13)]
        newest = table.compacted(twice)
        assert sorted(rows_of(newest, "arrival_seq")) == sorted(rows_of(table.latest(twice), "arrival_seq"))


def test_files_of_a_feed_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(catalog, "FILE_ROWS", 20, raising=False)
    events = catalog._events(spark, SF)
    feed = catalog._feed(spark, events, 2)
    assert feed.files == -(-events.count() // 40) > catalog.FEED_FILES
    back = spark.read.json(feed.path).selectExpr("arrival_seq", "_metadata.file_path file")
    assert back.select("file").distinct().count() <= 2 * feed.files
    assert back.count() == events.count()


def test_files_of_csv_grow_in_number(spark, monkeypatch):
    seen = written(monkeypatch)
    monkeypatch.setattr(catalog, "FILE_ROWS", 100, raising=False)
    found = catalog.QUERIES["scan_csv_ranges"](spark, SF)
    rows = catalog._events(spark, SF).count()
    assert tasks_of(spark, seen[0]) == -(-rows // 100) > 3
    assert sorted(r[0] for r in found.select("arrival_seq").collect()) == list(range(rows))


def test_rows_of_lone_ids_are_not_ranked_where_many_come_again(spark, monkeypatch):
    """Beyond the list that each task gets, too: the window stands above the rows that share a key."""
    monkeypatch.setattr(table, "MOST_REPEATED", 1)
    events = [raw(i, eventId=f"e{i % 6}") for i in range(9)]
    for one_per in (table.first_arrival, table.compacted):
        found = one_per(raw_frame(spark, events))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftAnti" in plan and "LeftSemi" in plan[plan.index("Window"):]
        assert found.count() == 6


def test_keys_of_one_hash_both_stay(spark, monkeypatch):
    events = [raw(i, eventId=f"e{i % 6}") for i in range(9)] + [raw(9, eventId=None), raw(10, eventId=None)]
    monkeypatch.setattr(F, "xxhash64", lambda *columns: F.lit(7).cast("long"))
    for most in (100, 0):
        monkeypatch.setattr(table, "MOST_REPEATED", most)
        assert sorted(rows_of(table.first_arrival(raw_frame(spark, events)), "arrival_seq")) == [
            (n,) for n in (0, 1, 2, 3, 4, 5, 9, 10)]
        assert sorted(rows_of(table.compacted(raw_frame(spark, events)), "arrival_seq")) == [
            (n,) for n in (3, 4, 5, 6, 7, 8, 9, 10)]
