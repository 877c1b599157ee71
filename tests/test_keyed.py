import random

import pytest
from pyspark.sql import functions as F

from helpers import rows_of, stored_frame
from palisade.sources import keyed


def events(spark, ids, seq, **changes):
    return stored_frame(spark, [dict(eventId=i, **changes) for i in ids]).withColumn(
        "arrival_seq", F.col("arrival_seq") + seq)


def test_lookups_open_the_files_of_one_bucket(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.create(spark, path, 32)
    keyed.upsert(events(spark, [f"e{n}" for n in range(400)], 0, statusCode=200), path)
    assert len(keyed.compact(spark, path)) == 32
    assert len(keyed.lookup(spark, path, "e7").inputFiles()) == 1
    keyed.upsert(events(spark, ["e7"], 1000, statusCode=500), path)
    found = keyed.lookup(spark, path, "e7")
    assert len(found.inputFiles()) == 2
    assert rows_of(found, "statusCode", "arrival_seq") == [(500, 1000)]
    assert len(keyed.lookup(spark, path, "e8").inputFiles()) <= 2
    assert rows_of(keyed.lookup(spark, path, "e8"), "statusCode") == [(200,)]
    assert keyed.lookup(spark, path, "nobody").count() == 0
    assert "EqualTo(eventId,e7)" in found._jdf.queryExecution().toString()


def test_two_compactions_rewrite_only_what_changed(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.create(spark, path, 32)
    keyed.upsert(events(spark, [f"e{n}" for n in range(400)], 0, statusCode=200), path)
    keyed.compact(spark, path)
    before = set(keyed.read(spark, path).inputFiles())
    reader = keyed.read(spark, path)
    keyed.upsert(events(spark, ["e3", "e4"], 1000, statusCode=500), path)
    dirty = keyed.compact(spark, path)
    assert len(dirty) <= 2
    after = set(keyed.read(spark, path).inputFiles())
    assert len(before & after) == 32 - len(dirty)
    assert keyed.compact(spark, path) == [] and set(keyed.read(spark, path).inputFiles()) == after
    # A reader of the older version still finds its files, until they are cleared away.
    assert reader.where("statusCode = 500").count() == 0 and reader.count() == 400
    assert keyed.vacuum(spark, path) == 2 + len(dirty)
    assert keyed.read(spark, path).where("statusCode = 500").count() == 2
    assert keyed.read(spark, path).count() == 400
    assert "Exchange" not in keyed.read(spark, path)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="already exists"):
        keyed.create(spark, path)


def test_random_commits_equal_a_dictionary(spark, tmp_path):
    """Retries, late arrivals, rows without id, copies of one id, compactions in between."""
    rng, path, newest = random.Random(5), str(tmp_path / "t"), {}
    keyed.create(spark, path, 4)
    assert keyed.read(spark, path).count() == 0 and keyed.compact(spark, path) == []
    for step in range(6):
        rows = []
        for n in range(60):
            event_id = rng.choice([None, "hot", "hot", *(f"e{k}" for k in range(30))])
            seq = (step if rng.random() < 0.7 else rng.randrange(-3, step + 1)) * 1000 + n * 7 + step
            rows.append(dict(eventId=event_id, arrival_seq=seq, statusCode=seq % 600))
            key = event_id or seq
            newest[key] = max(newest.get(key, (seq,)), (seq,))
        # The first attempt is half done; the second one counts.
        keyed.upsert(stored_frame(spark, rows[:30]), path, "w", step)
        keyed.upsert(stored_frame(spark, rows), path, "w", step)
        if step in (1, 2, 4):
            keyed.compact(spark, path)
        if step == 4:
            keyed.vacuum(spark, path)
        got = keyed.read(spark, path).collect()
        assert sorted((str(r["eventId"] or r["arrival_seq"]), r["arrival_seq"]) for r in got) == (
            sorted((str(k), v[0]) for k, v in newest.items()))
    assert rows_of(keyed.lookup(spark, path, "hot"), "arrival_seq") == [newest["hot"]]


def test_an_unfinished_commit_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError, match="no table"):
        keyed.read(spark, path)
    keyed.create(spark, path, 2)
    keyed.upsert(events(spark, ["a"], 0), path, "w", 1)
    keyed.upsert(events(spark, ["a", "b"], 5), path, "w", 2)
    (commit,) = (tmp_path / "t" / "delta").glob("w@2@*")
    (commit / "_SUCCESS").rename(commit / "_unfinished")
    assert rows_of(keyed.read(spark, path), "eventId", "arrival_seq") == [("a", 0)]
    keyed.compact(spark, path)
    keyed.upsert(events(spark, ["a", "b"], 5), path, "w", 2)
    assert sorted(rows_of(keyed.read(spark, path), "eventId", "arrival_seq")) == [
        ("a", 5), ("b", 6)]
