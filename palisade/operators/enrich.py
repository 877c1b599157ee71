"""Enrichment: attack type, repeat-offender flag, threat score."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.scoring import attack_type, threat_score
from palisade.operators.replay import replay_flags
from palisade.operators.table import first_arrival
from palisade.operators.window import repeat_offender
from palisade.policy import Policy


def score(df: DataFrame, policy: Policy) -> DataFrame:
    """Sets ``attackType`` and ``threatScore`` of nested events that carry the flag."""
    return df.withColumns({
        "attackType": attack_type(F.col("rule.category"), policy),
        "threatScore": threat_score(
            F.col("rule.severity"), F.col("rule.action"), F.col("path"),
            F.col("repeatOffender"), policy),
    })


def enrich(
    df: DataFrame,
    policy: Policy = Policy(),
    mode: str = "event_time",
    keys: Sequence[str] = ("clientIp",),
    unique_ids: bool = False,
) -> DataFrame:
    """Nested events with ``arrival_seq`` to enriched events, other columns untouched.

    ``event_time`` counts each window in event-time order, keeping the first arrival of a
    repeated id (``unique_ids=True`` skips that step where ids are known to be unique).
    ``arrival`` replays the events in arrival order, as a live service sees them: late
    events and retries count the way they do there. Both agree on in-order input.
    """
    if mode == "arrival":
        flagged = replay_flags(df, policy, keys)
    elif mode == "event_time":
        once = df if unique_ids else first_arrival(df, [*keys, "eventId"])
        flagged = repeat_offender(once, policy, keys)
    else:
        raise ValueError(f"unknown mode {mode!r}; use 'event_time' or 'arrival'")
    return score(flagged, policy)
