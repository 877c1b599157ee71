"""Required-field validation and all-or-nothing batch acceptance."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from palisade.functions.scoring import is_allowed_category
from palisade.functions.text import has_text
from palisade.operators.blocks import block_of, join_null_safe, ordinal, span_of
from palisade.policy import Policy
from palisade.schema import ACTIONS, SEVERITIES

# Required fields in message order; text fields must not be blank.
_REQUIRED = ["eventId", "timestamp", "configId", "clientIp", "hostname", "path", "method",
             "statusCode"]
_PLAIN = {"timestamp", "configId", "statusCode"}


def _missing(name: str, value: Column, text: bool = True) -> Column:
    absent = ~has_text(value) if text else value.isNull()
    return F.when(absent, F.lit(f"{name} is required"))


def _enum(name: str, value: Column, members: list[str]) -> Column:
    return F.when(value.isNull(), F.lit(f"{name} is required")).when(
        ~value.isin(members),
        F.concat(F.lit(f"{name} '"), value, F.lit(f"' is not one of [{', '.join(members)}]")))


def _checks(field: Callable[[str], Column], policy: Policy) -> list[Column]:
    """One Column per rule: its message, or null when the event passes."""
    category = field("rule.category")
    allowed = ", ".join(policy.categories)
    rule_checks = [
        _missing("rule.id", field("rule.id")),
        _missing("rule.name", field("rule.name")),
        _enum("rule.severity", field("rule.severity"), SEVERITIES),
        _enum("rule.action", field("rule.action"), ACTIONS),
        F.when(~has_text(category), F.lit("rule.category is required")).when(
            ~is_allowed_category(category, policy),
            F.concat(
                F.lit("rule.category '"), category,
                F.lit(f"' is not an allowed attack category; allowed: [{allowed}]"))),
    ]
    no_rule = field("rule").isNull()
    return [
        *(_missing(name, field(name), name not in _PLAIN) for name in _REQUIRED),
        F.when(no_rule, F.lit("rule is required")),
        *(F.when(~no_rule, check) for check in rule_checks),
    ]


def errors_of(field: Callable[[str], Column], policy: Policy) -> Column:
    """All messages for one event as an array, empty when it is valid.

    ``field`` maps a dotted name to its Column, so the same rules serve table columns and
    elements of a parsed payload.
    """
    return F.array_compact(F.array(*_checks(field, policy)))


def is_valid(policy: Policy = Policy()) -> Column:
    """The same rules as one predicate, for when the messages are not wanted."""
    return reduce(and_, (check.isNull() for check in _checks(F.col, policy)))


def with_errors(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Adds ``errors``; an event is valid when it is empty."""
    return df.withColumn("errors", errors_of(F.col, policy))


def split_batches(
    df: DataFrame, batch: str = "batch_id", order: str = "arrival_seq",
    span: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)`` events: one event with ``errors`` rejects its whole batch.

    Verdicts are pre-aggregated per ``(batch, arrival block)`` and joined back on both, so a
    batch of any size is judged and split without meeting in one task.
    """
    blocked = df.withColumn("_block", block_of(order, span or span_of(df, order)))
    verdicts = (
        blocked.groupBy(batch, "_block").agg(F.max(F.size("errors") > 0).alias("_bad"))
        .withColumn("_bad", F.max("_bad").over(Window.partitionBy(batch))))
    judged = join_null_safe(blocked, verdicts, [batch, "_block"])
    return tuple(
        judged.where(F.col("_bad") == bad).select(*df.columns) for bad in (False, True))


def batch_errors(
    df: DataFrame, batch: str = "batch_id", order: str = "arrival_seq",
    span: int | None = None,
) -> DataFrame:
    """``(batch, index, messages)`` of every invalid event; the index counts from 0 within
    the batch, valid events included."""
    placed = ordinal(df.select(batch, order, "errors"), [batch], order, "_place", span)
    return placed.where(F.size("errors") > 0).select(
        batch, (F.col("_place") - 1).alias("index"), F.col("errors").alias("messages"))


def ledger(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """One row: events submitted, batches accepted and refused, events accepted."""
    per_batch = df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.size("errors") > 0).alias("_bad"))

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    return per_batch.agg(
        total(F.col("_n")).alias("total_events"),
        total((~F.col("_bad")).cast("int")).alias("batches_sent"),
        total(F.col("_bad").cast("int")).alias("batches_failed"),
        total(F.when(~F.col("_bad"), F.col("_n")).otherwise(0)).alias("accepted"),
    )


def stamp_received(df: DataFrame, received_at: Column | None = None) -> DataFrame:
    """One server instant for all rows of the query or micro-batch, replacing any client
    value."""
    return df.withColumn(
        "receivedAt", F.current_timestamp() if received_at is None else received_at)
