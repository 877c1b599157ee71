"""Query arguments and the predicates they stand for."""
from __future__ import annotations

import ipaddress
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.instants import instant_literal, interval_ms, parse_instant
from palisade.functions.ip import in_cidr, parse_block
from palisade.policy import normalise

DEFAULT_LIMIT = 20
MAX_LIMIT = 100


def _blank_to_none(value: str | None) -> str | None:
    return value.strip() if value is not None and value.strip() else None


def _token(value: str | None) -> str | None:
    return normalise(value) if value is not None and value.strip() else None


def _bounds(start, end) -> tuple[datetime | None, datetime | None]:
    start, end = parse_instant("from", start), parse_instant("to", end)
    if start is not None and end is not None and start > end:
        raise ValueError("'from' must not be after 'to'")
    return start, end


@dataclass(frozen=True)
class StatsQuery:
    """Configuration and inclusive time range of a summary or a time series."""
    config_id: int | None = None
    start: datetime | None = None
    end: datetime | None = None

    @classmethod
    def from_params(cls, configId=None, to=None, **params) -> StatsQuery:
        start, end = _bounds(params.pop("from", params.pop("start", None)), to)
        if params:
            raise TypeError(f"unknown parameters: {sorted(params)}")
        return cls(None if configId is None else int(configId), start, end)

    def predicate(self) -> Column:
        return conjunction([equals("configId", self.config_id), *in_range(self.start, self.end)])


def series_params(configId=None, to=None, interval="1m", **params) -> tuple[StatsQuery, int]:
    """Arguments of a time series: both bounds are required."""
    query = StatsQuery.from_params(configId, to, **params)
    if query.start is None or query.end is None:
        raise ValueError("'from' and 'to' are required for timeseries")
    return query, interval_ms(interval)


@dataclass(frozen=True)
class SampleQuery:
    """Filters and page of a sample listing. ``client_ip`` may be an address or a block."""
    config_id: int | None = None
    client_ip: str | None = None
    start: datetime | None = None
    end: datetime | None = None
    category: str | None = None
    action: str | None = None
    repeat_offender: bool | None = None
    limit: int = DEFAULT_LIMIT
    offset: int = 0

    @classmethod
    def from_params(
        cls, configId=None, clientIp=None, to=None, category=None, action=None,
        repeatOffender=None, limit=DEFAULT_LIMIT, offset=0, **params,
    ) -> SampleQuery:
        """Blank filters are absent, category and action are trimmed and upper-cased, a
        limit above the maximum is clamped, a bad one refused."""
        start, end = _bounds(params.pop("from", params.pop("start", None)), to)
        if params:
            raise TypeError(f"unknown parameters: {sorted(params)}")
        if offset < 0:
            raise ValueError("'offset' must not be negative")
        if limit < 1:
            raise ValueError("'limit' must be at least 1")
        client_ip = _blank_to_none(clientIp)
        if client_ip is not None and "/" in client_ip:
            parse_block(client_ip)
        return cls(
            None if configId is None else int(configId), client_ip, start, end,
            _token(category), _token(action), repeatOffender, min(limit, MAX_LIMIT), offset)

    def predicate(self) -> Column:
        return conjunction([
            equals("configId", self.config_id),
            client_ip(self.client_ip),
            *in_range(self.start, self.end),
            equals("ruleCategory", self.category),
            equals("ruleAction", self.action),
            equals("repeatOffender", self.repeat_offender),
        ])


def equals(column: str, value) -> Column | None:
    return None if value is None else F.col(column) == F.lit(value)


def in_range(start: datetime | None, end: datetime | None) -> list[Column | None]:
    """Inclusive on both sides; a null timestamp fails as soon as a bound is set."""
    ts = F.col("timestamp")
    return [
        None if start is None else ts >= instant_literal(start),
        None if end is None else ts <= instant_literal(end),
    ]


def client_ip(value: str | None) -> Column | None:
    """An address in any of its spellings, or a block. Text that is no address equals itself."""
    if value is None:
        return None
    column = F.col("clientIp")
    if "/" in value:
        return in_cidr(column, value)
    try:
        address = ipaddress.ip_address(value)
    except ValueError:
        return column == F.lit(value)
    return in_cidr(column, f"{address}/{address.max_prefixlen}")


def conjunction(predicates: list[Column | None]) -> Column:
    """Only the predicates that are present; none of them matches everything."""
    return reduce(and_, [p for p in predicates if p is not None], F.lit(True))


def lookup(df: DataFrame, event_id: str) -> DataFrame:
    return df.where(F.col("eventId") == F.lit(event_id))
