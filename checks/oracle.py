"""What each query must return, as DuckDB SQL straight from the event ids and times."""

from __future__ import annotations

_HOUR = "strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:00:00Z')"


def _time(ts: str) -> str:
    return f"rtrim(rtrim(strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f'), '0'), '.') || 'Z'"


_LOGS = f"""logs AS (
  SELECT event_id, ts, user_id, value, {_HOUR} AS hour, '/' || event_type AS path,
         'ua-' || (user_id % 7) AS agent
  FROM events)"""


def _counts(source: str, path: str = "path", agent: str = "agent") -> str:
    return f"""SELECT hour, 'path' AS dim, {path} AS key, count(*) AS requests FROM {source} GROUP BY hour, {path}
UNION ALL
SELECT hour, 'userAgent', {agent}, count(*) FROM {source} GROUP BY hour, {agent}"""


_LINES = f"""{_LOGS},
states AS (
  SELECT *,
    CASE WHEN event_id % 50 = 0 THEN 'malformed' WHEN event_id % 77 = 0 THEN 'malformed'
         WHEN event_id % 91 = 0 THEN 'ok' WHEN event_id % 19 = 0 THEN 'blank'
         WHEN event_id % 17 = 0 THEN 'ok' WHEN event_id % 13 = 0 THEN 'ok'
         WHEN event_id % 11 = 0 THEN 'malformed' ELSE 'ok' END AS line_state
  FROM logs),
lines AS (
  SELECT event_id, user_id, hour, line_state,
    CASE WHEN line_state = 'ok' THEN {_time('ts')} END AS "timestamp",
    CASE WHEN line_state <> 'ok' THEN NULL
         WHEN event_id % 91 = 0 OR event_id % 17 = 0 OR event_id % 13 = 0 OR event_id % 7 <> 0 THEN path
         ELSE path || '&"q"' END AS path,
    CASE WHEN line_state <> 'ok' THEN NULL WHEN event_id % 91 = 0 THEN '' ELSE agent END AS "userAgent"
  FROM states),
good AS (SELECT * FROM lines WHERE line_state = 'ok')"""

_GOOD_COUNTS = _counts("good", "path", '"userAgent"')


def _batches(media: str) -> str:
    is_csv = {"json": "false", "csv": "true", "mixed": "batch_id % 2 = 1"}[media]
    return f"""{_LOGS},
members AS (SELECT *, event_id // 10 AS batch_id, event_id % 10 AS position FROM logs),
sizes AS (SELECT batch_id, count(*) AS n, max(ts) AS newest FROM members GROUP BY batch_id),
reasons AS (
  SELECT batch_id, n, newest,
    CASE WHEN batch_id % 23 = 0 THEN 'unsupported content-type: application/xml'
         WHEN batch_id % 43 = 0 THEN 'request body too large'
         WHEN batch_id % 29 = 0 THEN CASE WHEN {is_csv} THEN 'invalid CSV payload' ELSE 'invalid JSON payload' END
         WHEN batch_id % 41 = 0 THEN 'no log records provided'
         WHEN batch_id % 37 = 0 THEN CASE WHEN {is_csv} THEN 'row 4 has invalid timestamp' ELSE 'invalid JSON payload' END
         WHEN batch_id % 31 = 0 THEN 'record 3 missing path'
         ELSE '' END AS reason
  FROM sizes),
outcomes AS (
  SELECT batch_id, reason, newest,
    CASE WHEN batch_id % 23 = 0 THEN 415 WHEN batch_id % 43 = 0 THEN 413
         WHEN reason = '' THEN 202 ELSE 400 END::BIGINT AS status,
    CASE WHEN reason = '' THEN n ELSE 0 END AS n_records
  FROM reasons),
records AS (
  SELECT batch_id, position, {_time('ts')} AS "timestamp",
         path || CASE WHEN event_id % 3 = 0 THEN ',"q"' ELSE '' END AS path, agent AS "userAgent"
  FROM members JOIN outcomes USING (batch_id) WHERE status = 202)"""


_RECORD_ROWS = 'SELECT batch_id, position, "timestamp", path, "userAgent" FROM records'

_OBJECTS = f"""{_LOGS},
placed AS (
  SELECT *, hour AS object_hour,
    CASE WHEN user_id % 4 = 3 THEN 'logs/' || strftime(ts, '%Y-%m-%d/%H') || '.log.json'
         WHEN user_id % 11 = 10 THEN 'logs/' || strftime(ts, '%Y-%m-%d') || '/notes.txt'
         ELSE 'logs/' || strftime(ts, '%Y-%m-%d/%H') || '/pod-' || (user_id % 4) || '-' || extract(hour FROM ts)
              || '.log.json' END AS key
  FROM logs),
listing AS (
  SELECT key, any_value(object_hour) AS hour, max(ts) AS modified, sum(length(path))::BIGINT AS bytes
  FROM placed WHERE key LIKE '%.log.json' GROUP BY key),
hours AS (
  SELECT hour, count(*) AS objects, sum(bytes)::BIGINT AS bytes, max(modified) AS latest
  FROM listing GROUP BY hour),
stale AS (
  SELECT hour, latest FROM hours
  WHERE extract(hour FROM latest) % 5 = 0 OR extract(hour FROM latest) % 3 = 0)"""

_REASONS = """['dial tcp 10.0.0.1:9092: connect: Connection Refused', 'disk write failed',
  'producer queue full', 'Leader Not Available', 'record too large']"""


def _reason(column: str) -> str:
    return f"({_REASONS})[({column} % 5) + 1]"


ORACLE: dict[str, str] = {
    "requests_per_path": f"WITH {_LOGS} SELECT hour, path, count(*) AS requests FROM logs GROUP BY hour, path",
    "requests_per_user_agent": f"""WITH {_LOGS}
SELECT hour, agent AS "userAgent", count(*) AS requests FROM logs GROUP BY hour, agent""",
    "hourly_counts": f"WITH {_LOGS} {_counts('logs')}",
    "hourly_summary_json": f"""WITH {_LOGS}, counts AS ({_counts('logs')})
SELECT hour, 0::BIGINT AS part, 1::BIGINT AS parts,
  '{{"hour":"' || hour || '","requestsPerPath":{{'
  || string_agg('"' || key || '":' || requests, ',' ORDER BY key) FILTER (WHERE dim = 'path')
  || '}},"requestsPerUserAgent":{{'
  || string_agg('"' || key || '":' || requests, ',' ORDER BY key) FILTER (WHERE dim = 'userAgent')
  || '}}}}' AS document
FROM counts GROUP BY hour""",
    "aggregate_hour": f"""WITH {_LOGS},
chosen AS (SELECT * FROM logs WHERE date_trunc('hour', ts) = TIMESTAMP '2024-01-15 10:00:00')
{_counts('chosen')}""",
    "utc_hour_bucket": f"""SELECT event_id, {_HOUR} AS hour, strftime(ts, '%Y-%m-%d') AS date_token,
  strftime(ts, '%H') AS hour_token, 'logs/' || strftime(ts, '%Y-%m-%d/%H') || '.log.json' AS flat_key,
  'logs/' || strftime(ts, '%Y-%m-%d/%H') AS shard_prefix
FROM events""",
    "summary_paths": f"""SELECT DISTINCT {_HOUR} AS hour,
  'analytics/' || strftime(ts, '%Y-%m-%d') || '/summary_' || strftime(ts, '%H') || '.json' AS path
FROM events""",
    "tumbling_hour_counts": f"""WITH {_LOGS}
SELECT hour AS window_start, strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%Y-%m-%dT%H:00:00Z') AS window_end,
  path, count(*) AS requests
FROM logs GROUP BY ALL""",
    "windowed_stream_counts": f"""WITH {_LOGS}
SELECT hour AS window_start, strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%Y-%m-%dT%H:00:00Z') AS window_end,
  path, count(*) AS requests
FROM logs GROUP BY ALL""",
    "batch_hour_groups": f"""SELECT event_id // 10 AS batch_id, {_HOUR} AS hour, count(*) AS records
FROM events GROUP BY ALL""",
    "ndjson_encode": f"""WITH {_LOGS}
SELECT event_id, '{{"timestamp":"' || {_time('ts')} || '","path":"' || path || '","userAgent":"' || agent || '"}}' AS value
FROM logs""",
    "ndjson_decode": f"""WITH {_LINES}
SELECT event_id, line_state, "timestamp", path, "userAgent" FROM lines""",
    "ndjson_hourly_counts": f"""WITH {_LINES} {_GOOD_COUNTS}
UNION ALL
SELECT hour, 'malformed', '', count(*) FROM lines WHERE line_state = 'malformed' GROUP BY hour""",
    "decode_json_batches": f"WITH {_batches('json')} {_RECORD_ROWS}",
    "decode_csv_batches": f"WITH {_batches('csv')} {_RECORD_ROWS}",
    "validated_records": f"WITH {_batches('mixed')} {_RECORD_ROWS}",
    "batch_outcomes": f"WITH {_batches('mixed')} SELECT batch_id, status, reason, n_records FROM outcomes",
    "rejected_batches": f"WITH {_batches('mixed')} SELECT batch_id, status, reason FROM outcomes WHERE status <> 202",
    "ingest_counters": f"""WITH {_batches('mixed')}
SELECT 'log_batches_received_total' AS metric, count(*) FILTER (WHERE status = 202 AND batch_id % 53 <> 0) AS value
FROM outcomes
UNION ALL
SELECT 'invalid_requests_total', count(*) FILTER (WHERE status <> 202) FROM outcomes
UNION ALL
SELECT 'logs_ingested_total', coalesce(sum(n_records) FILTER (WHERE batch_id % 53 <> 0), 0)::BIGINT FROM outcomes
UNION ALL
SELECT 'ingest_errors_total', count(*) FILTER (WHERE status = 202 AND batch_id % 53 = 0) FROM outcomes""",
    "normalize_records": f"""WITH {_LOGS}
SELECT event_id,
  CASE WHEN event_id % 5 <> 0 AND event_id % 3 <> 0 AND event_id % 2 <> 0 AND event_id % 11 = 0 THEN NULL
       ELSE {_time('ts')} END AS "timestamp",
  path || ' x' AS path, agent AS "userAgent"
FROM logs""",
    "parse_hour_from_key": f"""SELECT event_id,
  CASE event_id % 6
    WHEN 0 THEN 'logs/' || strftime(ts, '%Y-%m-%d/%H') || '.log.json'
    WHEN 1 THEN 'logs/' || strftime(ts, '%Y-%m-%d/%H') || '/pod-' || (user_id % 3) || '-' || event_id || '.log.json'
    WHEN 2 THEN 'x/date=' || strftime(ts, '%Y-%m-%d/hour=%H') || '/part-0.txt'
    WHEN 3 THEN 'logs/' || strftime(ts, '%Y-%m-%d/') || (extract(hour FROM ts) + 24) || '.log.json'
    WHEN 4 THEN '/logs/' || strftime(ts, '%Y-%m-%d/') || extract(hour FROM ts) || '.log.json '
    ELSE 'logs/' || strftime(ts, '%Y-%m-%d/%H') || '/notes.txt' END AS key,
  CASE WHEN event_id % 6 IN (0, 1, 2, 4) THEN {_HOUR} ELSE '' END AS hour
FROM events""",
    "list_log_objects": f"""WITH {_OBJECTS}
SELECT key, hour, {_time('modified')} AS modified, bytes FROM listing ORDER BY key""",
    "objects_per_hour": f"WITH {_OBJECTS} SELECT hour, objects, bytes FROM hours ORDER BY hour",
    "latest_object_per_hour": f"WITH {_OBJECTS} SELECT hour, {_time('latest')} AS latest FROM hours",
    "merge_shards": f"""WITH {_OBJECTS}, merged AS (SELECT * FROM placed WHERE key LIKE '%.log.json')
{_counts('merged')}""",
    "stale_hours": f"WITH {_OBJECTS} SELECT hour, {_time('latest')} AS latest FROM stale",
    "incremental_refresh": f"""WITH {_OBJECTS}, again AS (SELECT * FROM logs WHERE hour IN (SELECT hour FROM stale))
{_counts('again')}""",
    "oversized_hours": f"""WITH {_LOGS},
padded AS (
  SELECT hour, '{{"path":"' || path || '","userAgent":"' || repeat('x', floor(value)::BIGINT) || '"}}' AS line FROM logs)
SELECT hour, count(*) AS oversized_lines FROM padded WHERE strlen(line) >= 400 GROUP BY hour""",
    "sanitize_writer_id": """SELECT event_id,
  trim(regexp_replace('-' || event_type || ' /é_' || user_id || '.x*', '[^A-Za-z0-9_.-]', '-', 'g'), '-') AS writer_id
FROM events""",
    "dlq_consumer_rows": f"""WITH {_LINES}
SELECT event_id % 3 AS "partition", event_id AS "offset", "timestamp", path, "userAgent",
  {_reason('event_id')} AS reason
FROM good""",
    "dlq_producer_rows": f"""WITH {_batches('mixed')}
SELECT batch_id, n_records, {_reason('batch_id')} AS reason, {_time('newest')} AS time
FROM outcomes WHERE status = 202""",
    "dlq_triage": f"""WITH {_LINES}
SELECT CASE WHEN event_id % 5 IN (0, 2, 3) THEN 'transient' ELSE 'permanent' END AS class, count(*) AS letters
FROM good GROUP BY ALL""",
    "stored_hourly_counts": f"WITH {_LOGS} {_counts('logs')}",
    "streamed_hourly_counts": f"WITH {_LINES} {_GOOD_COUNTS}",
    "oddly_named_counts": f"WITH {_LOGS} {_counts('logs')}",
    "flat_refresh_counts": f"WITH {_LOGS}, even AS (SELECT * FROM logs WHERE event_id % 2 = 0) {_counts('even')}",
    "twice_written_counts": f"WITH {_LOGS} {_counts('logs')}",
    "compacted_hourly_counts": f"WITH {_LOGS} {_counts('logs')}",
    "current_hour_counts": f"""WITH {_LOGS}, running AS (
  SELECT * FROM logs WHERE ts >= TIMESTAMP '2024-01-15 10:00:00' AND ts < TIMESTAMP '2024-01-15 11:00:00')
{_counts('running')}""",
    "arriving_batch_outcomes": f"""WITH {_batches('mixed')}
SELECT batch_id, status, CASE WHEN status = 415 THEN replace(reason, 'xml', 'octet-stream') ELSE reason END AS reason,
  n_records FROM outcomes""",
    "replayed_hourly_counts": f"""WITH {_LINES}, transient AS (SELECT * FROM good WHERE event_id % 5 IN (0, 2, 3))
{_counts('transient', 'path', '"userAgent"')}""",
    "stream_totals": f"""WITH {_LINES}
SELECT 'messages_total' AS metric, count(*) AS value FROM lines
UNION ALL
SELECT 'malformed_messages_total', count(*) FROM lines WHERE line_state <> 'ok'
UNION ALL
SELECT 'logs_ingested_total', count(*) FROM good WHERE event_id % 2 = 0
UNION ALL
SELECT 'ingest_errors_total', count(*) FROM good WHERE event_id % 2 = 1""",
    "compressed_hourly_counts": f"WITH {_LOGS} {_counts('logs')}",
    "pipeline_counters": f"""WITH {_batches('mixed')}
SELECT 'log_batches_received_total' AS metric, count(*) FILTER (WHERE status = 202) AS value FROM outcomes
UNION ALL
SELECT 'invalid_requests_total', count(*) FILTER (WHERE status <> 202) FROM outcomes
UNION ALL
SELECT 'logs_ingested_total', coalesce(sum(n_records), 0)::BIGINT FROM outcomes
UNION ALL
SELECT 'ingest_errors_total', 0
UNION ALL
SELECT 'aggregation_runs_total', 1""",
}
