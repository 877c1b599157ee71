"""Web-firewall events derived row by row from the ``events`` table of a data folder.

Some blocks of rows become an attack wave: one client, a few seconds apart.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SOURCE_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

# Values the event contract fixes.
METHODS = ["GET", "POST", "PUT", "DELETE"]
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
CATEGORIES = ["INJECTION", "XSS", "PROTOCOL_VIOLATION", "DATA_LEAKAGE", "BOT", "DOS", "RATE_LIMIT"]

# Test data of our own. A guarded path holds one of the policy's sensitive parts.
CONFIG_IDS = [71, 82, 93]
HOSTS = ["edge.harbour.test", "orders.harbour.test", "docs.harbour.test"]
GUARDED = ["/ops/admin/jobs", "/account/login", "/intranet/login/step2", "/admin-panel"]
OPEN = ["/catalogue", "/basket", "/help/contact", "/assets/site.css", "/v2/items", "/feed.xml"]
AGENTS = ["Mozilla/5.0 (X11; Linux)", "probe/0.9"]
COUNTRIES = ["NO", "PT", "KE", "CA", "JP", "CL", "NZ"]
CITIES = ["Bergen", "Porto", "Mombasa", "Halifax", "Sapporo", "Valdivia", "Nelson"]
# An attack wave is a block of rows of one client, some seconds apart.
BLOCK_ROWS = 20
WAVE_OF, WAVES = 7, 2
STEP_SECONDS = 5


def _at(values: list, number: str) -> str:
    listed = ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}L" for v in values)
    return f"get(array({listed}), CAST(({number}) % {len(values)} AS INT))"


_BLOCK = [
    "event_id AS arrival_seq",
    "event_id div 50 AS batch_id",
    f"event_id div {BLOCK_ROWS} AS b",
    f"(event_id div {BLOCK_ROWS}) % {WAVE_OF} < {WAVES} AS wave",
    "ts", "user_id AS u", "event_type", "value", "props",
]

_DERIVED = [
    "arrival_seq", "batch_id",
    "concat('req-', arrival_seq) AS eventId",
    f"""CASE WHEN wave THEN timestamp_seconds(
        1704067200 + (b % 360) * 7200 + (arrival_seq % {BLOCK_ROWS}) * {STEP_SECONDS})
      ELSE CAST(ts AS TIMESTAMP) END AS timestamp""",
    f"{_at(CONFIG_IDS, 'u')} AS configId",
    "concat('pol-', u % 40) AS policyId",
    """CASE WHEN wave
      THEN concat('10.', (b div 65536) % 256, '.', (b div 256) % 256, '.', b % 256)
      ELSE concat('100.', 64 + (u div 65536) % 64, '.', (u div 256) % 256, '.', u % 256)
      END AS clientIp""",
    f"{_at(HOSTS, 'u')} AS hostname",
    f"""CASE WHEN wave THEN {_at(GUARDED, 'b')}
      WHEN arrival_seq % 8 < 3 THEN {_at(GUARDED, 'arrival_seq')}
      ELSE {_at(OPEN, 'arrival_seq')} END AS path""",
    f"{_at(METHODS, 'arrival_seq')} AS method",
    f"CASE WHEN arrival_seq % 13 <> 0 THEN {_at(AGENTS, 'arrival_seq')} END AS userAgent",
    "64 + 8 * CAST(get_json_object(props, '$.k') AS BIGINT) AS requestSize",
    "CAST(floor(value * 10) AS BIGINT) AS responseSize",
    "concat('sig-', arrival_seq % 700) AS rule_id",
    f"""CASE WHEN wave THEN {_at(CATEGORIES, 'b')}
      WHEN arrival_seq % 61 <> 0 THEN {_at(CATEGORIES, 'u')} END AS category""",
    """CASE WHEN event_type = 'error' THEN 'DENY'
      WHEN event_type IN ('purchase', 'signup') THEN 'ALERT' ELSE 'MONITOR' END AS action""",
    f"{_at(SEVERITIES, 'arrival_seq + u')} AS severity",
    f"{_at(COUNTRIES, 'u')} AS country",
    f"{_at(CITIES, 'u')} AS city",
]

_NESTED = [
    "eventId", "timestamp", "configId", "policyId", "clientIp", "hostname", "path", "method",
    "CASE action WHEN 'DENY' THEN 403 WHEN 'ALERT' THEN 401 ELSE 200 END AS statusCode",
    "userAgent", "requestSize", "responseSize",
    "timestamp + INTERVAL 1 SECOND AS receivedAt",
    """struct(rule_id AS id, coalesce(category, 'none') AS name,
      concat(category, ' signature matched') AS message, severity, category, action) AS rule""",
    "struct(country, city) AS geoLocation",
    "arrival_seq", "batch_id",
]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(spark.read.schema(SOURCE_SCHEMA).parquet(f"{sf_dir}/events.parquet"))


def project(source: DataFrame) -> DataFrame:
    """Nested events plus ``arrival_seq`` and ``batch_id``; works on batches and streams."""
    return source.selectExpr(*_BLOCK).selectExpr(*_DERIVED).selectExpr(*_NESTED)
