"""Policy lookups and the threat score as plain Columns."""
from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import chain
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.text import has_text, normalise
from palisade.policy import Policy, normalised_lookup


def _lookup(entries: Mapping[str, object], key: Column, sql_type: str) -> Column:
    """Left lookup in a literal map: policy-sized, so it stays in the plan, not in a join."""
    pairs = normalised_lookup(entries)
    if not pairs:
        return F.lit(None).cast(sql_type)
    literal = F.create_map(*(F.lit(x) for x in chain.from_iterable(pairs.items())))
    return literal[normalise(key)].cast(sql_type)


def attack_type(category: Column, policy: Policy) -> Column:
    """Display name, else the raw category; null when blank."""
    return F.when(
        has_text(category), F.coalesce(_lookup(policy.categories, category, "string"), category))


def severity_score(severity: Column, policy: Policy) -> Column:
    return F.coalesce(_lookup(policy.severity_scores, severity, "int"), F.lit(0))


def action_score(action: Column, policy: Policy) -> Column:
    return F.coalesce(_lookup(policy.action_scores, action, "int"), F.lit(0))


def base_score(severity: Column, action: Column, policy: Policy) -> Column:
    return severity_score(severity, policy) + action_score(action, policy)


def is_sensitive_path(path: Column, policy: Policy) -> Column:
    lowered = F.lower(path)
    hits = [lowered.contains(p.lower()) for p in policy.sensitive_paths if p and p.strip()]
    return F.coalesce(reduce(or_, hits, F.lit(False)), F.lit(False))


def path_bonus(path: Column, policy: Policy) -> Column:
    return F.when(is_sensitive_path(path, policy), policy.sensitive_path_bonus).otherwise(0)


def threat_score(
    severity: Column, action: Column, path: Column, repeat_offender: Column, policy: Policy,
) -> Column:
    """Base score plus bonuses, held between 0 and the policy's maximum."""
    raw = (
        base_score(severity, action, policy)
        + path_bonus(path, policy)
        + F.when(repeat_offender, policy.repeat_offender_bonus).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(raw, F.lit(policy.max_score))).cast("int")


def is_allowed_category(category: Column, policy: Policy) -> Column:
    keys = list(normalised_lookup(policy.categories))
    if not keys:
        return F.lit(False)
    return F.coalesce(normalise(category).isin(keys), F.lit(False))


def round_tenth(value: Column) -> Column:
    """One decimal, half up; null becomes 0.0."""
    return F.coalesce(F.floor(value * 10 + F.lit(0.5)) / F.lit(10.0), F.lit(0.0))
