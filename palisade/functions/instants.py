"""Epoch arithmetic, interval tokens and strict ISO-8601 parsing."""
from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket sizes of the time series (fixed values).
INTERVALS_MS = {"1m": 60_000, "5m": 300_000, "1h": 3_600_000}

# Date, time and an explicit offset; seconds and fraction optional. Spark's own cast also
# takes a bare date or a zone-less time, which an event must not carry.
ISO_OFFSET = (
    r"^[+-]?\d{4,9}-\d{2}-\d{2}[Tt]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?"
    r"([Zz]|[+-]\d{2}:\d{2}(:\d{2})?)$"
)


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def floor_to_step(ms: Column, step: int) -> Column:
    """Floor, not truncation, so instants before 1970 fall into the right bucket."""
    return ms - F.pmod(ms, F.lit(step))


def bucket_start(ts: Column, step: int) -> Column:
    return F.timestamp_millis(floor_to_step(epoch_ms(ts), step))


def interval_ms(token: str) -> int:
    try:
        return INTERVALS_MS[token.strip().lower()]
    except (KeyError, AttributeError):
        raise ValueError(
            f"unsupported interval {token!r}; use one of {', '.join(INTERVALS_MS)}") from None


def parse_iso_offset(text: Column) -> Column:
    """Timestamp of an ISO-8601 offset date-time, null for anything else."""
    # Seconds are optional in the format, but not in Spark's cast.
    full = F.regexp_replace(F.upper(text), r"^([^T]*T\d{2}:\d{2})([Z+-])", "$1:00$2")
    return F.when(text.rlike(ISO_OFFSET), full.try_cast("timestamp"))


def iso_label(ts: Column) -> Column:
    """UTC text; the fraction appears only when it is not zero."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    stem = F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    digits = F.lpad(micros.cast("string"), 6, "0")
    fraction = (
        F.when(micros == 0, F.lit(""))
        .when(micros % 1000 == 0, F.concat(F.lit("."), F.substring(digits, 1, 3)))
        .otherwise(F.concat(F.lit("."), digits))
    )
    return F.concat(stem, fraction, F.lit("Z"))


def parse_instant(name: str, value: str | datetime | None) -> datetime | None:
    """A query bound: blank is absent, anything but an offset date-time is an error."""
    if value is None or (isinstance(value, str) and not value.strip()):
        return None
    if isinstance(value, datetime):
        if value.tzinfo is None:
            raise ValueError(f"'{name}' needs a time zone: {value}")
        return value.astimezone(timezone.utc)
    if re.match(ISO_OFFSET, value) is None:
        raise ValueError(f"'{name}' is not a valid ISO-8601 offset datetime: {value}")
    try:
        return datetime.fromisoformat(value.upper()).astimezone(timezone.utc)
    except ValueError:
        raise ValueError(
            f"'{name}' is not a valid ISO-8601 offset datetime: {value}") from None


def instant_literal(value: datetime) -> Column:
    """Timestamp literal that does not depend on the session or driver time zone."""
    whole = int(value.timestamp() // 1)
    return F.timestamp_micros(F.lit(whole * 1_000_000 + value.microsecond))
