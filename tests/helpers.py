"""Builders and the plain-Python reading of the arrival-order window."""
from datetime import datetime, timedelta, timezone

from pyspark.sql import Row
from pyspark.sql import types as T

from palisade.schema import ENRICHED_SCHEMA, EVENT_SCHEMA

RAW_SCHEMA = T.StructType([*EVENT_SCHEMA.fields, T.StructField("arrival_seq", T.LongType())])
STORED_SCHEMA = T.StructType([*ENRICHED_SCHEMA.fields, T.StructField("arrival_seq", T.LongType())])


def at(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def millis(ms):
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=ms)


def raw(seq, **changes):
    """A valid nested event; a ``rule`` or ``geoLocation`` dict updates the nested fields."""
    rule = dict(id="r1", name="rule", message="m", severity="HIGH", category="INJECTION",
                action="DENY")
    event = dict.fromkeys(EVENT_SCHEMA.fieldNames())
    event.update(
        eventId=f"e{seq}", timestamp=at("2026-07-10T10:00:00"), configId=1, clientIp="10.0.0.1",
        hostname="h", path="/api/data", method="GET", statusCode=200, rule=rule,
        geoLocation=dict(country="US", city="New York"), arrival_seq=seq)
    if isinstance(changes.get("rule"), dict):
        changes["rule"] = {**rule, **changes["rule"]}
    event.update(changes)
    return event


def raw_frame(spark, events):
    return spark.createDataFrame(
        [tuple(e[c] for c in RAW_SCHEMA.fieldNames()) for e in events], RAW_SCHEMA)


def stored_frame(spark, rows):
    names = STORED_SCHEMA.fieldNames()
    full = []
    for seq, row in enumerate(rows):
        base = dict.fromkeys(names)
        base.update(arrival_seq=seq, repeatOffender=False)
        base.update(row)
        full.append(tuple(base[c] for c in names))
    return spark.createDataFrame(full, STORED_SCHEMA)


def fold(events, window_ms):
    """Counts per ``(seq)`` by literally keeping one sorted set per client."""
    sets, counts = {}, {}
    for seq, ip, event_id, ms in sorted(events):
        members = sets.setdefault(ip, {})
        for old in [i for i, t in members.items() if t < ms - window_ms]:
            del members[old]
        members[event_id] = ms
        counts[seq] = len(members)
    return counts


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]
