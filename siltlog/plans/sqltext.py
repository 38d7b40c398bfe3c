"""Common table expressions of the oracle SQL: the derived log and its snapshots."""

from __future__ import annotations

LOG = """log AS (SELECT event_id // 1000 AS file_id, event_id % 1000 AS pos, 'b' || CAST(user_id % 4 AS VARCHAR) AS bucket,
  'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, props AS value, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS flag,
  CASE WHEN event_id % 4 = 3 AND (event_id // 4) % 7 <> 0 THEN 1 ELSE 0 END AS status, 0 AS ds,
  CASE WHEN event_type = 'signup' THEN 86400 ELSE 0 END AS ttl, epoch_us(ts) // 1000000 AS ts, event_id // 4 AS tx_id, event_id FROM events)"""
COMMITTED = """committed AS (SELECT DISTINCT tx_id FROM log WHERE status = 1),
clog AS (SELECT * FROM log SEMI JOIN committed USING (tx_id))"""
INDEX = """idx AS (SELECT * FROM clog QUALIFY row_number() OVER (PARTITION BY bucket, key ORDER BY file_id DESC, pos DESC) = 1)"""
LIVE = """live AS (SELECT * FROM idx WHERE flag <> 0 AND (ttl = 0 OR ts + ttl > 1706745600))"""
SIZED = """sized AS (SELECT *, 42 + strlen(bucket) + strlen(key) + CASE WHEN flag = 0 THEN 0 ELSE strlen(value) END AS size FROM log)"""
SIZED_LIVE = """sized_live AS (SELECT *, 42 + strlen(bucket) + strlen(key) + strlen(value) AS size FROM live)"""
SEGMENTS = """hot AS (SELECT idx.file_id, count(*) AS reads FROM events e JOIN idx ON idx.bucket = 'b' || CAST(e.user_id % 4 AS VARCHAR) AND idx.key = 'u' || lpad(CAST(e.user_id AS VARCHAR), 6, '0')
  WHERE e.event_type IN ('click', 'view') GROUP BY 1),
seg AS (SELECT s.file_id, CAST(s.size AS BIGINT) AS size, CAST(coalesce(l.live_bytes, 0) AS BIGINT) AS live_bytes, coalesce(hot.reads, 0) AS read_count
  FROM (SELECT file_id, sum(size) AS size FROM sized GROUP BY 1) s
  LEFT JOIN (SELECT file_id, sum(size) AS live_bytes FROM sized_live GROUP BY 1) l USING (file_id) LEFT JOIN hot USING (file_id)),
ratios AS (SELECT *, CASE WHEN size > 0 THEN CAST(size - live_bytes AS DOUBLE) / CAST(size AS DOUBLE) ELSE 0.0 END AS garbage_ratio FROM seg)"""
#: Operations derived from events: clicks and views read, the others write; a transaction is four operations.
OPS = """ops AS (SELECT event_id + 1 AS seq, CASE WHEN event_type IN ('click', 'view') THEN 'get' ELSE 'put' END AS kind,
  'b' || CAST(user_id % 4 AS VARCHAR) AS bucket, 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') || ':' || CAST(event_id % 13 AS VARCHAR) AS key,
  CAST(floor(value * 1000) AS BIGINT) AS size, event_id // 4 AS tx, CASE WHEN event_id % 4 = 3 THEN CAST(floor(value * 500000) AS BIGINT) END AS latency,
  user_id, event_id, event_type FROM events)"""
OVERWRITES = """marked AS (SELECT *, kind = 'put' AND min(CASE WHEN kind = 'put' THEN tx END) OVER (PARTITION BY bucket, key) < tx AS overwrite FROM ops)"""
WINDOWS = """wins AS (SELECT (seq - 1) // 100 AS win, count(*) FILTER (kind = 'get') AS reads, count(*) FILTER (kind = 'put') AS writes,
  count(*) FILTER (overwrite) AS overwrites, count(*) FILTER (kind = 'put' AND size >= 16384) AS large_writes,
  CAST(coalesce(sum(latency) // nullif(count(latency), 0), 0) AS BIGINT) AS sync_latency FROM marked GROUP BY 1)"""
RATED = """rated AS (SELECT *, reads + writes AS ops, CASE WHEN reads + writes > 0 THEN CAST(writes AS DOUBLE) / CAST(reads + writes AS DOUBLE) ELSE 0.0 END AS wr,
  CASE WHEN reads + writes > 0 THEN CAST(reads AS DOUBLE) / CAST(reads + writes AS DOUBLE) ELSE 0.0 END AS rr,
  CASE WHEN writes > 0 THEN CAST(overwrites AS DOUBLE) / CAST(writes AS DOUBLE) ELSE 0.0 END AS ovr,
  CASE WHEN writes > 0 THEN CAST(large_writes AS DOUBLE) / CAST(writes AS DOUBLE) ELSE 0.0 END AS lr FROM wins),
ruled AS (SELECT *, CASE WHEN ops < 100 THEN 0 WHEN writes > 0 AND sync_latency >= 5000000 AND wr >= 0.5 THEN 1 WHEN writes > 0 AND ovr >= 0.5 THEN 2
  WHEN writes > 0 AND lr >= 0.5 THEN 3 WHEN wr >= 0.7 THEN 4 WHEN rr >= 0.7 THEN 5 ELSE 6 END AS rule FROM rated),
analyzed AS (SELECT win, reads, writes, overwrites, large_writes, sync_latency,
  ['unknown', 'sync-latency-sensitive', 'overwrite-heavy', 'large-value-heavy', 'write-heavy', 'read-heavy', 'mixed'][rule + 1] AS phase,
  CASE rule WHEN 0 THEN 0.0 WHEN 1 THEN least(1.0, CAST(sync_latency AS DOUBLE) / 10000000.0) WHEN 2 THEN ovr WHEN 3 THEN lr WHEN 4 THEN wr WHEN 5 THEN rr ELSE 1 - abs(wr - rr) END AS confidence,
  ['insufficient operations', 'sync latency exceeds threshold', 'overwrites dominate writes', 'large values dominate writes', 'writes dominate operations',
   'reads dominate operations', 'no operation class dominates'][rule + 1] AS reason FROM ruled)"""
#: The value log over documents: three documents share a key, texts of 1024 bytes and more are separated, a log per source.
DOCS = """docs AS (SELECT doc_id, source, doc_id // 3 AS key, coalesce(text, '') AS value, strlen(coalesce(text, '')) AS size FROM documents),
big AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM docs WHERE size >= 1024)"""
VLOG = """placed AS (SELECT source, doc_id, rn, size, 0 AS segment, 0 AS "offset", size AS used FROM big WHERE rn = 1
  UNION ALL SELECT b.source, b.doc_id, b.rn, b.size, CASE WHEN p.used + b.size > 65536 AND p.used > 0 THEN p.segment + 1 ELSE p.segment END,
    CASE WHEN p.used + b.size > 65536 AND p.used > 0 THEN 0 ELSE p.used END, CASE WHEN p.used + b.size > 65536 AND p.used > 0 THEN b.size ELSE p.used + b.size END
  FROM placed p JOIN big b ON b.source = p.source AND b.rn = p.rn + 1),
last_doc AS (SELECT max(doc_id) AS doc_id FROM docs GROUP BY key),
pointers AS (SELECT p.* FROM placed p SEMI JOIN last_doc USING (doc_id)),
vstats AS (SELECT t.source, t.segment, CAST(t.total_bytes AS BIGINT) AS total_bytes, CAST(coalesce(l.live_bytes, 0) AS BIGINT) AS live_bytes,
  CAST(greatest(0, t.total_bytes - coalesce(l.live_bytes, 0)) AS BIGINT) AS stale_bytes, t.segment = max(t.segment) OVER (PARTITION BY t.source) AS active
  FROM (SELECT source, segment, sum(size) AS total_bytes FROM placed GROUP BY ALL) t
  LEFT JOIN (SELECT source, segment, sum(size) AS live_bytes FROM pointers GROUP BY ALL) l USING (source, segment)),
candidates AS (SELECT source, segment, CAST(stale_bytes AS DOUBLE) / CAST(total_bytes AS DOUBLE) AS stale_ratio FROM vstats
  WHERE NOT active AND CAST(stale_bytes AS DOUBLE) / CAST(total_bytes AS DOUBLE) >= 0.3
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY CAST(stale_bytes AS DOUBLE) / CAST(total_bytes AS DOUBLE) DESC, segment) = 1)"""


def over_log(body: str, *more: str) -> str:
    return f"WITH {', '.join([LOG, COMMITTED, INDEX, LIVE, *more])}\n{body}"


def over_segments(body: str, *more: str) -> str:
    return over_log(body, SIZED, SIZED_LIVE, SEGMENTS, *more)


def over_ops(body: str, *more: str) -> str:
    return f"WITH {', '.join([OPS, OVERWRITES, *more])}\n{body}"


def over_windows(body: str, *more: str) -> str:
    return f"WITH RECURSIVE {', '.join([OPS, OVERWRITES, WINDOWS, RATED, *more])}\n{body}"


def over_values(body: str, *more: str) -> str:
    return f"WITH RECURSIVE {', '.join([DOCS, VLOG, *more])}\n{body}"
