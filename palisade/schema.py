"""Declared schemas. Nothing in this package infers a schema."""
from __future__ import annotations

from pyspark.sql import types as T

RULE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("action", T.StringType()),
])

GEO_SCHEMA = T.StructType([
    T.StructField("country", T.StringType()),
    T.StructField("city", T.StringType()),
])

EVENT_SCHEMA = T.StructType([
    T.StructField("eventId", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("configId", T.LongType()),
    T.StructField("policyId", T.StringType()),
    T.StructField("clientIp", T.StringType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("statusCode", T.IntegerType()),
    T.StructField("userAgent", T.StringType()),
    T.StructField("requestSize", T.LongType()),
    T.StructField("responseSize", T.LongType()),
    T.StructField("receivedAt", T.TimestampType()),
    T.StructField("rule", RULE_SCHEMA),
    T.StructField("geoLocation", GEO_SCHEMA),
    T.StructField("attackType", T.StringType()),
    T.StructField("threatScore", T.IntegerType()),
    T.StructField("repeatOffender", T.BooleanType()),
])

# Stored column -> path in the nested event, in stored order.
STORED_PATHS = {
    **{f.name: f.name for f in EVENT_SCHEMA.fields[:13]},
    "ruleId": "rule.id",
    "ruleName": "rule.name",
    "ruleMessage": "rule.message",
    "ruleSeverity": "rule.severity",
    "ruleCategory": "rule.category",
    "ruleAction": "rule.action",
    "geoCountry": "geoLocation.country",
    "geoCity": "geoLocation.city",
    "attackType": "attackType",
    "threatScore": "threatScore",
    "repeatOffender": "repeatOffender",
}


def _field_at(path: str) -> T.StructField:
    field = T.StructField("", EVENT_SCHEMA)
    for part in path.split("."):
        field = field.dataType[part]
    return field


ENRICHED_SCHEMA = T.StructType([
    T.StructField(name, _field_at(path).dataType) for name, path in STORED_PATHS.items()
])

CSV_COLUMNS = [f.name for f in EVENT_SCHEMA.fields[:12]] + [
    f"rule.{f.name}" for f in RULE_SCHEMA.fields
] + [f"geoLocation.{f.name}" for f in GEO_SCHEMA.fields]

SAMPLE_COLUMNS = [
    "eventId", "timestamp", "configId", "policyId", "clientIp", "hostname", "path", "method",
    "statusCode", "ruleCategory", "ruleSeverity", "ruleAction", "attackType", "threatScore",
    "repeatOffender", "geoCountry", "receivedAt",
]

# Closed vocabularies (fixed values).
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
ACTIONS = ["DENY", "ALERT", "MONITOR"]
