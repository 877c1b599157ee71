"""The batch pipeline: validate, accept by batch, enrich, flatten."""
from __future__ import annotations

from pyspark.sql import DataFrame

from palisade.operators.enrich import enrich
from palisade.operators.table import flatten
from palisade.operators.validate import is_valid, split_batches, with_errors
from palisade.policy import Policy


def valid_events(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    return df.where(is_valid(policy))


def accepted_events(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Events of the batches without a single invalid event."""
    accepted, _ = split_batches(with_errors(df, policy))
    return accepted.drop("errors")


def stored_events(
    df: DataFrame, policy: Policy = Policy(), mode: str = "event_time",
    unique_ids: bool = False,
) -> DataFrame:
    """Enriched events in the stored shape, with ``arrival_seq``."""
    return flatten(enrich(df, policy, mode, unique_ids=unique_ids), ["arrival_seq"])
