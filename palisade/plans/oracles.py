"""Plain SQL for each registered query, over the same ``events`` table.

Windows are written as self-joins, the obvious form, so that they check the Spark form
rather than repeat it.
"""
from __future__ import annotations

from palisade.plans import projection as p

def _at(values: list, number: str) -> str:
    return f"{values}[({number}) % {len(values)} + 1]"


_EV = f"""
WITH base AS (
  SELECT event_id AS n, event_id // {p.BLOCK_ROWS} AS b, event_id % {p.BLOCK_ROWS} AS p,
         (event_id // {p.BLOCK_ROWS}) % {p.WAVE_OF} < {p.WAVES} AS wave, ts, user_id AS u,
         event_type, value, props
  FROM events
), ev AS (
  SELECT n AS arrival_seq, n // 50 AS batch_id,
    'req-' || n AS eventId,
    CASE WHEN wave
         THEN TIMESTAMP '2024-01-01' + to_seconds((b % 360) * 7200 + p * {p.STEP_SECONDS})
         ELSE ts END AS "timestamp",
    CAST({_at(p.CONFIG_IDS, 'u')} AS BIGINT) AS configId,
    'pol-' || u % 40 AS policyId,
    CASE WHEN wave THEN '10.' || (b // 65536) % 256 || '.' || (b // 256) % 256 || '.' || b % 256
         ELSE '100.' || 64 + (u // 65536) % 64 || '.' || (u // 256) % 256 || '.' || u % 256
    END AS clientIp,
    {_at(p.HOSTS, 'u')} AS hostname,
    CASE WHEN wave THEN {_at(p.GUARDED, 'b')}
         WHEN n % 8 < 3 THEN {_at(p.GUARDED, 'n')}
         ELSE {_at(p.OPEN, 'n')} END AS path,
    {_at(p.METHODS, 'n')} AS method,
    CAST(CASE WHEN event_type = 'error' THEN 403
              WHEN event_type IN ('purchase', 'signup') THEN 401 ELSE 200 END AS INTEGER)
      AS statusCode,
    CASE WHEN n % 13 <> 0 THEN {_at(p.AGENTS, 'n')} END AS userAgent,
    64 + 8 * CAST(json_extract_string(props, '$.k') AS BIGINT) AS requestSize,
    CAST(floor(value * 10) AS BIGINT) AS responseSize,
    'sig-' || n % 700 AS ruleId,
    CASE WHEN wave THEN {_at(p.CATEGORIES, 'b')}
         WHEN n % 61 <> 0 THEN {_at(p.CATEGORIES, 'u')} END AS ruleCategory,
    {_at(p.SEVERITIES, 'n + u')} AS ruleSeverity,
    CASE WHEN event_type = 'error' THEN 'DENY'
         WHEN event_type IN ('purchase', 'signup') THEN 'ALERT' ELSE 'MONITOR' END AS ruleAction,
    {_at(p.COUNTRIES, 'u')} AS geoCountry,
    {_at(p.CITIES, 'u')} AS geoCity
  FROM base
), flat AS (
  SELECT *, "timestamp" + INTERVAL 1 SECOND AS receivedAt,
    coalesce(ruleCategory, 'none') AS ruleName,
    ruleCategory || ' signature matched' AS ruleMessage,
    epoch_us("timestamp") // 1000 AS ms
  FROM ev
), valid AS (SELECT * FROM flat WHERE ruleCategory IS NOT NULL)
"""

_SEV = "CASE ruleSeverity WHEN 'CRITICAL' THEN 40 WHEN 'HIGH' THEN 30 WHEN 'MEDIUM' THEN 20 WHEN 'LOW' THEN 10 ELSE 0 END"
_ACT = "CASE ruleAction WHEN 'DENY' THEN 20 WHEN 'ALERT' THEN 10 ELSE 0 END"
_BONUS = "CASE WHEN lower(path) LIKE '%/admin%' OR lower(path) LIKE '%/login%' THEN 15 ELSE 0 END"
_DISPLAY = """CASE upper(trim({c}))
  WHEN 'INJECTION' THEN 'SQL/Command Injection' WHEN 'XSS' THEN 'Cross-Site Scripting'
  WHEN 'PROTOCOL_VIOLATION' THEN 'Protocol Anomaly' WHEN 'DATA_LEAKAGE' THEN 'Data Exfiltration'
  WHEN 'BOT' THEN 'Bot Activity' WHEN 'DOS' THEN 'Denial of Service'
  WHEN 'RATE_LIMIT' THEN 'Rate Limiting' ELSE {c} END"""


def _enriched(source: str) -> str:
    """Adds ``counted`` (window counts) and ``en`` (enriched rows) over ``source``."""
    return _EV + f""", counted AS (
  SELECT a.arrival_seq, count(*) AS window_count
  FROM {source} a JOIN {source} b ON a.clientIp = b.clientIp
   AND b.ms >= a.ms - 600000
   AND (b.ms < a.ms OR (b.ms = a.ms AND b.arrival_seq <= a.arrival_seq))
  GROUP BY a.arrival_seq
), en AS (
  SELECT s.*, c.window_count, c.window_count > 5 AS repeatOffender,
    {_DISPLAY.format(c='ruleCategory')} AS attackType,
    CAST(least(100, {_SEV} + {_ACT} + {_BONUS}
      + CASE WHEN c.window_count > 5 THEN 15 ELSE 0 END) AS INTEGER) AS threatScore
  FROM {source} s JOIN counted c USING (arrival_seq)
)
"""


_RAW = """eventId, "timestamp", configId, policyId, clientIp, hostname, path, method, statusCode,
  userAgent, requestSize, responseSize, receivedAt, ruleId, ruleName, ruleMessage, ruleSeverity,
  ruleCategory, ruleAction, geoCountry, geoCity"""
_STORED = _RAW + ", attackType, threatScore, repeatOffender"
_SAMPLE = """eventId, "timestamp", configId, policyId, clientIp, hostname, path, method, statusCode,
  ruleCategory, ruleSeverity, ruleAction, attackType, threatScore, repeatOffender, geoCountry,
  receivedAt"""
_ODD = _RAW.replace("userAgent", """'  "' || userAgent || '",' || chr(10) || ' ' AS userAgent""")
_OCTET = "CAST(split_part(clientIp, '.', {i}) AS INTEGER)"


def _round(value: str) -> str:
    return f"coalesce(floor(({value}) * 10 + 0.5) / 10, 0.0)"


_ALL = _enriched("flat")
_VALID = _enriched("valid")

_BODY_ID = """CASE WHEN batch_id % 5 = 4 THEN 'event-' || arrival_seq
  ELSE 'batch-' || batch_id END"""
_BODIES = _EV + f""", sent AS (
  SELECT *, {_BODY_ID} AS body_id,
    CASE WHEN batch_id % 5 = 4 THEN 0 ELSE arrival_seq % 50 END AS "index"
  FROM flat
), bodies AS (
  SELECT body_id, any_value(batch_id) AS batch_id,
    CAST(count(*) FILTER (ruleCategory IS NULL) AS BIGINT) AS bad,
    bool_or(ruleSeverity = 'CRITICAL') AS has_critical
  FROM sent GROUP BY body_id
)
"""

_ALLOWED = "INJECTION, XSS, PROTOCOL_VIOLATION, DATA_LEAKAGE, BOT, DOS, RATE_LIMIT"

# A member lives until a later arrival is more than the window ahead of it.
_LATE = _EV + """, late AS (
  SELECT eventId, clientIp, ms, arrival_seq - arrival_seq % 500 + 499 - arrival_seq % 500 AS s
  FROM valid
), gone AS (
  SELECT a.eventId, a.clientIp, a.s, min(k.s) AS evicted
  FROM late a LEFT JOIN late k
    ON k.clientIp = a.clientIp AND k.s > a.s AND k.ms > a.ms + 600000
  GROUP BY ALL
)
SELECT i.eventId, count(*) > 5 AS repeatOffender
FROM gone i JOIN gone j
  ON j.clientIp = i.clientIp AND j.s <= i.s AND (j.evicted IS NULL OR j.evicted > i.s)
GROUP BY i.eventId"""


def _summary(config_id: int) -> str:
    return _ALL + f""", hit AS (SELECT * FROM en WHERE configId = {config_id}),
grouped AS (
  SELECT 'category' AS section, coalesce(ruleCategory, 'UNKNOWN') AS key, count(*) AS events,
         avg(threatScore) AS a FROM hit GROUP BY 2
  UNION ALL SELECT 'action', ruleAction, count(*), NULL FROM hit GROUP BY 2
  UNION ALL SELECT 'attacker', clientIp, count(*), avg(threatScore) FROM hit GROUP BY 2
  UNION ALL SELECT 'path', path, count(*), NULL FROM hit GROUP BY 2
  UNION ALL SELECT 'total', NULL, count(*), avg(threatScore) FROM hit
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY section ORDER BY events DESC, key) AS r FROM grouped
)
SELECT section, CAST(r AS INTEGER) AS rank, key, events,
  CASE WHEN section NOT IN ('action', 'path') THEN {_round('a')} END AS avg_threat_score
FROM ranked WHERE r <= 10 OR section IN ('category', 'action')
"""


def _series(start: str, end: str, step: str, where: str, bucket: str) -> str:
    return _EV + f""", axis AS (
  SELECT unnest(generate_series(time_bucket(INTERVAL '{step}', TIMESTAMP '{start}'),
    time_bucket(INTERVAL '{step}', TIMESTAMP '{end}'), INTERVAL '{step}')) AS bucket
), hits AS (
  SELECT time_bucket(INTERVAL '{step}', "timestamp") AS bucket, count(*) AS events FROM flat
  WHERE "timestamp" BETWEEN TIMESTAMP '{start}' AND TIMESTAMP '{end}' AND {where} GROUP BY 1
)
SELECT {bucket} AS bucket, coalesce(events, 0) AS events FROM axis LEFT JOIN hits USING (bucket)
"""


_TAMPERED = """CAST(CASE WHEN arrival_seq % 500 = 0 THEN threatScore + 7
  WHEN arrival_seq % 500 = 1 THEN NULL ELSE threatScore END AS INTEGER)"""

_DAMAGED = _EV + f""", d AS (
  SELECT arrival_seq, arrival_seq % 20 AS k, ruleCategory,
    CASE WHEN arrival_seq % 20 = 13 THEN ' xss' WHEN arrival_seq % 20 = 14 THEN 'FOOBAR'
         WHEN arrival_seq % 20 IN (15, 16) THEN NULL ELSE ruleCategory END AS c
  FROM flat
), e AS (
  SELECT arrival_seq, list_filter([
    CASE WHEN k IN (1, 15) THEN 'eventId is required' END,
    CASE WHEN k IN (2, 15) THEN 'timestamp is required' END,
    CASE WHEN k IN (3, 15) THEN 'configId is required' END,
    CASE WHEN k IN (4, 15) THEN 'clientIp is required' END,
    CASE WHEN k IN (5, 15) THEN 'hostname is required' END,
    CASE WHEN k IN (6, 15) THEN 'path is required' END,
    CASE WHEN k IN (7, 15) THEN 'method is required' END,
    CASE WHEN k IN (8, 15) THEN 'statusCode is required' END,
    CASE WHEN k = 9 THEN 'rule is required' END,
    CASE WHEN k IN (10, 15) THEN 'rule.id is required' END,
    CASE WHEN k = 15 THEN 'rule.name is required' END,
    CASE WHEN k = 15 THEN 'rule.severity is required'
         WHEN k = 11 THEN 'rule.severity ''SEVERE'' is not one of [CRITICAL, HIGH, MEDIUM, LOW]'
    END,
    CASE WHEN k IN (12, 15) THEN 'rule.action is required' END,
    CASE WHEN k = 9 THEN NULL WHEN c IS NULL THEN 'rule.category is required'
         WHEN c = 'FOOBAR' THEN 'rule.category ''FOOBAR'' is not an allowed attack category; allowed: [{_ALLOWED}]'
    END], lambda x: x IS NOT NULL) AS errs
  FROM d
)
SELECT arrival_seq, CAST(len(errs) AS BIGINT) AS error_count,
  coalesce(array_to_string(errs, '; '), '') AS errors FROM e
"""

# Status and arrival after one event in ten, then one in fifty, has come again.
_FED = """CAST(CASE WHEN arrival_seq % 50 = 0 THEN 501 WHEN arrival_seq % 10 = 0 THEN 500
            ELSE statusCode END AS INTEGER) AS statusCode,
          CASE WHEN arrival_seq % 50 = 0 THEN arrival_seq + 2000000000000
            WHEN arrival_seq % 10 = 0 THEN arrival_seq + 1000000000000 ELSE arrival_seq END
            AS arrival_seq"""

ORACLES: dict[str, str] = {
    "filter_config": _EV + """SELECT eventId, configId, clientIp, path FROM flat
        WHERE configId = 71""",
    "filter_time_range": _EV + """SELECT eventId, "timestamp" FROM flat
        WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'""",
    "filter_ip_exact": _EV + """SELECT eventId, clientIp, path FROM flat
        WHERE clientIp = '100.64.0.7'""",
    "filter_ip_cidr": _EV + f"""SELECT eventId, clientIp FROM flat
        WHERE {_OCTET.format(i=1)} = 100 AND {_OCTET.format(i=2)} = 64
          AND {_OCTET.format(i=3)} = 0 AND {_OCTET.format(i=4)} BETWEEN 64 AND 127""",
    "filter_category_action": _EV + """SELECT eventId, ruleCategory, ruleAction FROM flat
        WHERE ruleCategory = 'INJECTION' AND ruleAction = 'DENY'""",
    "filter_repeat_offender": _ALL + """SELECT eventId, clientIp, repeatOffender FROM en
        WHERE repeatOffender""",
    "samples_combined": _ALL + f"""SELECT {_SAMPLE} FROM en
        WHERE configId = 71 AND {_OCTET.format(i=1)} = 10 AND {_OCTET.format(i=2)} = 0
          AND ruleCategory = 'XSS' AND ruleAction = 'ALERT' AND repeatOffender
          AND "timestamp" BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-25'""",
    "samples_page": _ALL + f"""SELECT {_SAMPLE}, CAST(row_number() OVER (
          ORDER BY "timestamp" DESC NULLS LAST, eventId) AS INTEGER) AS rank
        FROM en QUALIFY rank BETWEEN 41 AND 60""",
    "samples_total": _ALL + """SELECT count(*) AS total FROM en
        WHERE NOT repeatOffender AND ruleAction = 'DENY'""",
    "lookup_by_id": _ALL + f"SELECT {_STORED} FROM en WHERE eventId = 'req-42'",
    "flatten_events": _EV + f"""SELECT {_RAW}, CAST(NULL AS VARCHAR) AS attackType,
        CAST(NULL AS INTEGER) AS threatScore, false AS repeatOffender FROM flat""",
    "parse_payload": _BODIES + """SELECT body_id, CAST("index" AS BIGINT) AS "index", eventId,
          "timestamp", configId, clientIp, path, statusCode, userAgent, requestSize,
          ruleSeverity, ruleCategory, geoCity
        FROM sent JOIN bodies USING (body_id) WHERE bad = 0""",
    "reject_malformed": _BODIES + """, judged AS (
          SELECT body_id, CASE
            WHEN batch_id % 6 IN (1, 5) THEN 'Malformed request body'
            WHEN batch_id % 6 IN (2, 3) THEN
              'Request body must be a security event object or a non-empty array of them'
            WHEN batch_id % 6 = 4 AND has_critical THEN 'Malformed request body'
            WHEN bad > 0 THEN 'One or more events failed validation; no events were accepted'
          END AS rejection, bad FROM bodies)
        SELECT body_id, rejection,
          CASE WHEN rejection LIKE 'One or more%' THEN bad ELSE 0 END AS failures
        FROM judged WHERE rejection IS NOT NULL""",
    "scan_json_roundtrip": _EV + f"SELECT {_ODD} FROM flat",
    "scan_csv_roundtrip": _EV + f"SELECT {_ODD.replace('receivedAt, ', '')} FROM flat",
    "scan_json_array": _EV + "SELECT arrival_seq, " + _RAW + " FROM flat",
    "scan_csv_ranges": _EV + "SELECT arrival_seq, " + _ODD.replace("receivedAt, ", "").replace(
        "chr(10)", "chr(10) || chr(10)") + " FROM flat",
    "ingest_file_order": _EV + """SELECT row_number() OVER (ORDER BY arrival_seq) - 1 AS arrival_seq,
          eventId FROM flat""",
    "export_chronological": _EV + """SELECT
          row_number() OVER (ORDER BY "timestamp", flat.arrival_seq) - 1 AS arrival_seq, eventId
        FROM flat""",
    "receive_stamp": _EV + """SELECT eventId,
          TIMESTAMP '2024-01-01' + to_seconds(batch_id) AS receivedAt FROM flat""",
    "store_two_writers": _EV + "SELECT eventId, arrival_seq FROM flat",
    "store_range": _ALL + """SELECT eventId, "timestamp", threatScore FROM en
        WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-05 06:30:00' AND TIMESTAMP '2024-01-09 17:45:30'""",
    "clear_counts": _EV + """SELECT count(*) AS events, count(DISTINCT clientIp) AS clients,
          CAST(0 AS BIGINT) AS left_over FROM valid""",
    "upsert_latest": _EV + """SELECT eventId,
          CAST(CASE WHEN arrival_seq % 10 = 0 THEN 500 ELSE statusCode END AS INTEGER) AS statusCode,
          CASE WHEN arrival_seq % 10 = 0 THEN arrival_seq + 1000000000000 ELSE arrival_seq END
            AS arrival_seq FROM flat""",
    "most_specific_network": _EV + """, a AS (
          SELECT DISTINCT clientIp, CAST(split_part(clientIp, '.', 1) AS BIGINT) * 16777216
            + CAST(split_part(clientIp, '.', 2) AS BIGINT) * 65536
            + CAST(split_part(clientIp, '.', 3) AS BIGINT) * 256
            + CAST(split_part(clientIp, '.', 4) AS BIGINT) AS n FROM flat WHERE clientIp IS NOT NULL),
        s AS (SELECT clientIp, n, len, n // (1 << (32 - len)) AS prefix
          FROM a, (VALUES (16), (24), (26), (29), (32)) AS v(len)),
        b AS (SELECT len, prefix, min(clientIp || '/' || len) AS network FROM s
          WHERE (len = 16 AND (n // 65536) % 2 = 0) OR (len = 24 AND (n // 256) % 2 = 1)
            OR (len = 26 AND n % 4 = 1) OR (len = 29 AND n % 4 = 2) OR (len = 32 AND n % 4 = 3)
          GROUP BY 1, 2),
        m AS (SELECT clientIp, arg_max(network, len) AS network FROM s JOIN b USING (len, prefix)
          GROUP BY 1)
        SELECT eventId, clientIp, network FROM flat LEFT JOIN m USING (clientIp)""",
    "keyed_upserts": _EV + f"SELECT eventId, {_FED} FROM flat",
    "keyed_lookup": _EV + f"""SELECT eventId, clientIp, path, "timestamp", {_FED} FROM flat
        WHERE eventId = 'req-50'""",
    "validate_errors": _DAMAGED,
    "batch_accept": _EV + """SELECT batch_id, eventId FROM flat
        WHERE batch_id NOT IN (SELECT batch_id FROM flat WHERE ruleCategory IS NULL)""",
    "batch_errors": _EV + """SELECT batch_id, arrival_seq % 50 AS "index",
        'rule.category is required' AS messages FROM flat WHERE ruleCategory IS NULL""",
    "batch_ledger": _EV + """, b AS (
          SELECT batch_id, count(*) AS n, bool_or(ruleCategory IS NULL) AS bad FROM flat GROUP BY 1)
        SELECT CAST(sum(n) AS BIGINT) AS total_events,
          CAST(count(*) FILTER (NOT bad) AS BIGINT) AS batches_sent,
          CAST(count(*) FILTER (bad) AS BIGINT) AS batches_failed,
          CAST(coalesce(sum(n) FILTER (NOT bad), 0) AS BIGINT) AS accepted FROM b""",
    "attack_type": _EV + f""", s AS (
          SELECT eventId, CASE arrival_seq % 13 WHEN 0 THEN 'CUSTOM_RULE'
            WHEN 1 THEN ' ' || lower(ruleCategory) WHEN 2 THEN NULL ELSE ruleCategory END AS c
          FROM flat)
        SELECT eventId, {_DISPLAY.format(c='c')} AS attackType FROM s""",
    "base_score": _EV + f"""SELECT eventId, {_SEV} AS severity_score, {_ACT} AS action_score,
        {_SEV} + {_ACT} AS base_score FROM flat""",
    "path_bonus": _EV + f""", s AS (SELECT eventId,
          CASE WHEN arrival_seq % 2 = 1 THEN upper(path) ELSE path END AS path FROM flat)
        SELECT eventId, path, {_BONUS} AS bonus FROM s""",
    "threat_score": _VALID + "SELECT eventId, threatScore FROM en",
    "sliding_count": _VALID + "SELECT eventId, clientIp, window_count FROM en",
    "repeat_offender": _VALID + "SELECT eventId, clientIp, repeatOffender FROM en",
    "replay_flags": _VALID + "SELECT eventId, repeatOffender FROM en",
    "replay_disordered": _LATE,
    "stream_late": _LATE,
    "replay_future_clock": _EV + """, late AS (
          SELECT clientIp, arrival_seq AS s, CASE
            WHEN row_number() OVER (PARTITION BY clientIp ORDER BY arrival_seq) = 1
            THEN epoch_us("timestamp" + INTERVAL 5 YEARS) // 1000 ELSE ms END AS ms
          FROM valid
        ), gone AS (
          SELECT a.clientIp, a.s, min(k.s) AS evicted
          FROM late a LEFT JOIN late k
            ON k.clientIp = a.clientIp AND k.s > a.s AND k.ms > a.ms + 600000
          GROUP BY ALL
        )
        SELECT i.s AS arrival_seq, count(*) AS window_count
        FROM gone i JOIN gone j
          ON j.clientIp = i.clientIp AND j.s <= i.s AND (j.evicted IS NULL OR j.evicted > i.s)
        GROUP BY i.s""",
    "enrich_events": _VALID + f"SELECT {_STORED} FROM en",
    "enrich_retries": _VALID + """SELECT eventId, threatScore, repeatOffender, arrival_seq
        FROM en""",
    "stream_enrich": _VALID + f"SELECT {_STORED} FROM en",
    "stream_multi_batch": _VALID + "SELECT eventId, repeatOffender, threatScore FROM en",
    "stream_tenants": _EV + """SELECT a.eventId, count(*) > 5 AS repeatOffender
        FROM valid a JOIN valid b ON a.clientIp = b.clientIp AND a.configId = b.configId
          AND b.ms >= a.ms - 600000
          AND (b.ms < a.ms OR (b.ms = a.ms AND b.arrival_seq <= a.arrival_seq))
        GROUP BY a.eventId""",
    "stream_restart": _EV + "SELECT eventId, arrival_seq FROM valid",
    "stream_quarantine": _EV + """SELECT arrival_seq, 'rule.category is required' AS errors
        FROM flat WHERE ruleCategory IS NULL""",
    "summary_totals": _ALL + f"""SELECT count(*) AS events,
        {_round('avg(threatScore)')} AS avg_threat_score FROM en""",
    "stats_by_category": _ALL + f"""SELECT coalesce(ruleCategory, 'UNKNOWN') AS category,
        count(*) AS events, {_round('avg(threatScore)')} AS avg_threat_score FROM en GROUP BY 1""",
    "stats_by_action": _EV + """SELECT ruleAction AS action, count(*) AS events FROM flat
        WHERE configId = 82 GROUP BY 1""",
    "top_attackers": _ALL + f"""SELECT clientIp, count(*) AS events,
        {_round('avg(threatScore)')} AS avg_threat_score FROM en GROUP BY 1
        ORDER BY events DESC, clientIp LIMIT 10""",
    "top_paths": _EV + """SELECT path, count(*) AS events FROM flat
        WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'
        GROUP BY 1 ORDER BY events DESC, path LIMIT 10""",
    "summary_grouping_sets": _summary(82),
    "summary_no_match": _summary(1),
    "timeseries_1m": _series(
        "2024-01-03 06:00:30", "2024-01-03 18:00:00", "1 minute", "true",
        "strftime(bucket, '%Y-%m-%dT%H:%M:%SZ')"),
    "timeseries_5m": _EV + """SELECT time_bucket(INTERVAL '5 minutes', "timestamp") AS bucket,
        count(*) AS events FROM flat GROUP BY 1""",
    "timeseries_1h_zerofill": _series(
        "2023-12-31 20:30:00", "2024-02-01 00:00:00", "1 hour", "configId = 93", "bucket"),
    "flagged_count": _VALID + "SELECT count(*) FILTER (repeatOffender) AS flagged FROM en",
    "flag_sequence": _VALID + """, placed AS (
          SELECT clientIp, repeatOffender,
            row_number() OVER (PARTITION BY clientIp ORDER BY arrival_seq) AS place FROM en
        ), firsts AS (
          SELECT clientIp, count(*) AS events, count(*) FILTER (repeatOffender) AS flagged,
            min(place) FILTER (repeatOffender) AS first_flagged FROM placed GROUP BY 1
        )
        SELECT clientIp, any_value(events) AS events, any_value(flagged) AS flagged,
          any_value(first_flagged) AS first_flagged,
          CASE WHEN any_value(first_flagged) IS NOT NULL THEN
            count(*) FILTER (NOT repeatOffender AND place > first_flagged) END AS unflagged_after
        FROM placed JOIN firsts USING (clientIp) GROUP BY clientIp""",
    "burst_profile": _EV + """SELECT clientIp, path, count(*) AS events,
          min("timestamp") AS first_seen, max("timestamp") AS last_seen,
          max(ms) - min(ms) AS span_ms
        FROM flat GROUP BY 1, 2 HAVING count(*) > 5 AND max(ms) - min(ms) <= 600000""",
    "burst_islands": _EV + """, steps AS (
          SELECT clientIp, "timestamp", ms, arrival_seq,
            CASE WHEN ms - lag(ms) OVER (PARTITION BY clientIp ORDER BY ms, arrival_seq) <= 600000
              THEN 0 ELSE 1 END AS far,
            count(*) OVER (PARTITION BY clientIp ORDER BY ms
              RANGE BETWEEN 600000 PRECEDING AND CURRENT ROW) AS density
          FROM flat WHERE clientIp IS NOT NULL AND ms IS NOT NULL),
        islands AS (SELECT *, sum(far) OVER (PARTITION BY clientIp ORDER BY ms, arrival_seq) AS island
          FROM steps)
        SELECT clientIp, count(*) AS events, min("timestamp") AS first_seen,
          max("timestamp") AS last_seen, max(ms) - min(ms) AS span_ms, max(density) AS densest
        FROM islands GROUP BY clientIp, island HAVING max(density) > 5""",
    "score_integrity": _ALL + f"""SELECT eventId, clientIp, path, ruleSeverity, ruleAction,
          {_TAMPERED} AS threatScore, repeatOffender, threatScore AS recomputed
        FROM en WHERE {_TAMPERED} IS DISTINCT FROM en.threatScore""",
    "score_integrity_healthy": _ALL + """SELECT eventId, clientIp, path, ruleSeverity,
          ruleAction, threatScore, repeatOffender, threatScore AS recomputed
        FROM en WHERE false""",
    "snapshot_diff": _ALL + """, n AS (SELECT eventId, arrival_seq % 500 AS k, arrival_seq % 1000 AS k2
          FROM en)
        SELECT eventId, 'changed' AS status,
          CASE WHEN k2 = 0 THEN 'path,threatScore' ELSE 'threatScore' END AS changed
          FROM n WHERE k IN (0, 1)
        UNION ALL SELECT eventId, 'extra', '' FROM n WHERE k IN (2, 3)
        UNION ALL SELECT eventId || '-x', 'missing', '' FROM n WHERE k = 3""",
}
