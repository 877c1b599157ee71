"""Request bodies as rows: one JSON object or an array of them.

A body is judged inside its own row, before it is exploded, so the same code runs on a
stream, needs no shuffle, and accepts or refuses a body as a whole.
"""
from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions.instants import parse_iso_offset
from palisade.functions.text import has_text, jtrim
from palisade.operators.validate import errors_of
from palisade.policy import Policy
from palisade.schema import ACTIONS, EVENT_SCHEMA, GEO_SCHEMA, RULE_SCHEMA, SEVERITIES

# Set by the server, never taken from a client.
_SERVER_SIDE = {"receivedAt", "attackType", "threatScore", "repeatOffender"}
_NESTED = {"rule": RULE_SCHEMA, "geoLocation": GEO_SCHEMA}

_CLIENT_FIELDS = [f for f in EVENT_SCHEMA.fields if f.name not in _SERVER_SIDE]
# Everything is read as text first, so that a value of the wrong type can be told from an
# absent one. Keys outside the schema are ignored.
_TEXT_SCHEMA = T.ArrayType(T.StructType(
    [T.StructField(f.name, T.StringType()) for f in _CLIENT_FIELDS]))

# Messages of the service (fixed values).
EMPTY_BODY = "Request body must be a security event object or a non-empty array of them"
MALFORMED_BODY = "Malformed request body"
INVALID_EVENTS = "One or more events failed validation; no events were accepted"


def _typed(field: T.StructField, raw: Column) -> Column:
    if field.name in _NESTED:
        return F.from_json(raw, _NESTED[field.name])
    if isinstance(field.dataType, T.TimestampType):
        # A number is seconds since the epoch.
        seconds = F.when(raw.rlike(r"^-?\d{1,12}(\.\d{1,9})?$"), raw.try_cast("decimal(21,9)"))
        return F.coalesce(parse_iso_offset(raw), F.timestamp_micros(
            F.floor(seconds * 1_000_000).cast("bigint")))
    if isinstance(field.dataType, T.StringType):
        return raw
    text = F.when(has_text(raw), jtrim(raw))
    # A whole number may be written with a fraction of zero or an exponent.
    number = text.try_cast("decimal(38,6)")
    whole = F.when(number == F.floor(number), number.try_cast(field.dataType))
    return F.coalesce(text.try_cast(field.dataType), whole)


def _unreadable(field: T.StructField, raw: Column, typed: Column) -> Column:
    """A value that is present but cannot be bound to its field."""
    if field.name in _NESTED:
        bad = ~F.startswith(jtrim(raw), F.lit("{"))
        if field.name == "rule":
            for name, members in (("severity", SEVERITIES), ("action", ACTIONS)):
                bad = bad | F.coalesce(~typed[name].isin(members), F.lit(False))
        return F.coalesce(bad, F.lit(False))
    return has_text(raw) & typed.isNull()


def _read(element: Column) -> Column:
    """``(event, unreadable)`` of one array element, each value converted once."""
    typed = F.struct(*(_typed(f, element[f.name]).alias(f.name) for f in _CLIENT_FIELDS))
    known = {f.name for f in _CLIENT_FIELDS}

    def judge(t: Column) -> Column:
        event = F.struct(*(
            (t[f.name] if f.name in known else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in EVENT_SCHEMA.fields))
        bad = reduce(or_, (_unreadable(f, element[f.name], t[f.name]) for f in _CLIENT_FIELDS
                           if f.name in _NESTED or not isinstance(f.dataType, T.StringType)))
        return F.struct(
            F.when(element.isNotNull(), event).alias("event"),
            (element.isNotNull() & bad).alias("unreadable"))

    return F.get(F.transform(F.array(typed), judge), F.lit(0))


def parse_payloads(
    df: DataFrame, body: str = "body", policy: Policy = Policy(),
) -> DataFrame:
    """Adds ``events`` (array), ``rejection`` (null when accepted) and ``failures``: the
    ``(index, messages)`` of the invalid events."""
    text = F.col(body)

    def messages(event: Column) -> Column:
        def field(name: str) -> Column:
            value = event
            for part in name.split("."):
                value = value[part]
            return value
        return F.when(event.isNull(), F.array(F.lit("event must not be null"))).otherwise(
            errors_of(field, policy))

    shaped = F.substring(jtrim(text), 1, 1).isin("{", "[")
    parsed = _once(
        df,
        _raw=F.from_json(text, _TEXT_SCHEMA),
        _json=F.expr(f"try_parse_json(`{body}`)").isNotNull(),
    )
    bound = _once(parsed, _read=F.transform("_raw", _read))
    events = _once(
        bound,
        events=F.transform("_read", lambda r: r["event"]),
        _unreadable=F.exists("_read", lambda r: r["unreadable"]))
    judged = _once(events, _failures=F.filter(
        F.transform("events", lambda e, i: F.struct(
            i.cast("bigint").alias("index"), messages(e).alias("messages"))),
        lambda f: F.size(f["messages"]) > 0))
    rejection = (
        F.when(~has_text(text) | ~F.col("_json"), F.lit(MALFORMED_BODY))
        .when(~shaped | (F.size("_raw") == 0), F.lit(EMPTY_BODY))
        .when(F.col("_raw").isNull() | F.col("_unreadable"), F.lit(MALFORMED_BODY))
        .when(F.size("_failures") > 0, F.lit(INVALID_EVENTS)))
    no_failures = F.array().cast("array<struct<index:bigint,messages:array<string>>>")
    return (
        _once(judged, rejection=rejection)
        .withColumn("failures", F.when(
            F.col("rejection") == INVALID_EVENTS, F.col("_failures")).otherwise(no_failures))
        .drop("_raw", "_json", "_read", "_unreadable", "_failures"))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed exactly once per row. The optimizer copies a projected
    expression into every place that mentions it, which multiplies nested parsing; it never
    copies the output of a generator."""
    row = F.struct(*(col.alias(name) for name, col in columns.items()))
    return df.select("*", F.inline(F.array(row)))


def accepted_events(parsed: DataFrame) -> DataFrame:
    """Events of the accepted bodies, one row each with their ``index`` in the body."""
    kept = [c for c in parsed.columns if c not in ("events", "rejection", "failures")]
    return (
        parsed.where(F.col("rejection").isNull())
        .select(*kept, F.posexplode("events").alias("index", "_event"))
        .select(*(c for c in kept if c not in EVENT_SCHEMA.fieldNames()),
                F.col("index").cast("bigint").alias("index"), "_event.*"))


def rejected_bodies(parsed: DataFrame) -> DataFrame:
    """Refused bodies with the reason and the per-event messages."""
    return parsed.where(F.col("rejection").isNotNull()).drop("events")


def rejection_report(parsed: DataFrame, key: str) -> DataFrame:
    """``(key, index, messages)`` of every invalid event in a refused body."""
    return (
        parsed.select(key, F.explode("failures").alias("_f"))
        .select(key, F.col("_f.index").alias("index"), F.col("_f.messages").alias("messages")))
