"""Scoring and rate-limit policy: plain configuration, turned into Columns elsewhere."""
from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import timedelta

# Shipped policy (fixed values).
DEFAULT_CATEGORIES = {
    "INJECTION": "SQL/Command Injection",
    "XSS": "Cross-Site Scripting",
    "PROTOCOL_VIOLATION": "Protocol Anomaly",
    "DATA_LEAKAGE": "Data Exfiltration",
    "BOT": "Bot Activity",
    "DOS": "Denial of Service",
    "RATE_LIMIT": "Rate Limiting",
}
DEFAULT_SEVERITY_SCORES = {"CRITICAL": 40, "HIGH": 30, "MEDIUM": 20, "LOW": 10}
DEFAULT_ACTION_SCORES = {"DENY": 20, "ALERT": 10, "MONITOR": 0}
DEFAULT_SENSITIVE_PATHS = ("/admin", "/login")

_ASCII_BLANKS = "".join(map(chr, range(33)))
_UNITS = {"ms": "milliseconds", "s": "seconds", "m": "minutes", "h": "hours", "d": "days"}


def normalise(text: str) -> str:
    return text.strip(_ASCII_BLANKS).upper()


def normalised_lookup(entries: Mapping[str, object]) -> dict[str, object]:
    """Upper-cased, trimmed keys; the first of two keys that fall together wins."""
    lookup: dict[str, object] = {}
    for key, value in entries.items():
        if key is not None and key.strip():
            lookup.setdefault(normalise(key), value)
    return lookup


def parse_duration(value: str | int | timedelta) -> timedelta:
    """``"10m"``, ``"30s"``, ``"250ms"`` or a number of milliseconds."""
    if isinstance(value, timedelta):
        return value
    match = re.fullmatch(r"(\d+)\s*(ms|s|m|h|d)?", str(value).strip().lower())
    if match is None:
        raise ValueError(f"not a duration: {value!r}")
    return timedelta(**{_UNITS[match[2] or "ms"]: int(match[1])})


@dataclass(frozen=True)
class Policy:
    categories: Mapping[str, str] = field(default_factory=lambda: dict(DEFAULT_CATEGORIES))
    severity_scores: Mapping[str, int] = field(
        default_factory=lambda: dict(DEFAULT_SEVERITY_SCORES))
    action_scores: Mapping[str, int] = field(default_factory=lambda: dict(DEFAULT_ACTION_SCORES))
    sensitive_path_bonus: int = 15
    repeat_offender_bonus: int = 15
    max_score: int = 100
    sensitive_paths: Sequence[str] = DEFAULT_SENSITIVE_PATHS
    window: timedelta = timedelta(minutes=10)
    threshold: int = 5
    state_ttl: timedelta = timedelta(seconds=7200)

    @property
    def window_ms(self) -> int:
        return self.window // timedelta(milliseconds=1)

    @property
    def state_ttl_ms(self) -> int:
        return self.state_ttl // timedelta(milliseconds=1)

    @classmethod
    def from_mapping(cls, config: Mapping) -> Policy:
        """Build from the nested, dash-keyed form a YAML policy file loads to.

        Absent lookup maps are empty; absent scoring and rate-limit sections keep defaults.
        """
        scoring = config.get("scoring")
        limit = config.get("rate-limit")
        extra = {}
        if scoring is not None:
            extra.update(
                sensitive_path_bonus=int(scoring.get("sensitive-path-bonus", 0)),
                repeat_offender_bonus=int(scoring.get("repeat-offender-bonus", 0)),
                max_score=int(scoring.get("max-score", 0)),
                sensitive_paths=tuple(scoring.get("sensitive-paths") or ()),
            )
        if limit is not None:
            extra.update(
                window=parse_duration(limit.get("window") or timedelta(minutes=10)),
                threshold=int(limit.get("threshold", 0)),
            )
        return cls(
            categories=dict(config.get("categories") or {}),
            severity_scores=dict(config.get("severity-scores") or {}),
            action_scores=dict(config.get("action-scores") or {}),
            **extra,
        )
