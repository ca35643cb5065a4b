"""The adapters of ``adapters.py`` as SQL common table expressions for the checks."""

SEC = """sec AS (
  SELECT e.event_id AS seq, 'EVT-' || e.event_id AS event_id, epoch_us(e.ts) AS ts_us,
    '10.0.0.' || e.user_id AS src, '10.1.0.' || (e.event_id % 7) AS dst,
    CAST(50000 + e.event_id % 1000 AS VARCHAR) AS src_port,
    regexp_extract(e.props, '([0-9]+)', 1) AS dst_port,
    CASE WHEN e.event_id % 3 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol,
    CASE e.event_type WHEN 'view' THEN 'BENIGN' WHEN 'click' THEN 'PORT_SCAN'
      WHEN 'error' THEN 'BRUTE_FORCE' WHEN 'purchase' THEN 'DOS'
      ELSE 'UNKNOWN_BEHAVIOR' END AS type,
    CASE WHEN e.event_type = 'signup' THEN NULL
      ELSE (e.event_id % 1000) / 1000.0::DOUBLE END AS confidence,
    CASE WHEN e.event_type <> 'signup' AND e.event_id % 1000 >= 900 THEN 'HIGH'
      ELSE 'MEDIUM' END AS severity,
    CASE WHEN e.event_type = 'signup' THEN 'P-' || (e.event_id % 20) END AS pattern_id,
    CASE WHEN e.event_type = 'signup' THEN e.event_id % 50 END AS observations
  FROM events e)"""

# First reconnaissance window of each source, six hours long.
RECON = """s AS (SELECT *, TRY_CAST(dst_port AS BIGINT) AS port FROM sec
    WHERE type NOT IN ('BENIGN', 'UNKNOWN_BEHAVIOR')),
w AS (SELECT src, ts_us, count(*) OVER r AS n, count(DISTINCT port) OVER r AS np,
    count(DISTINCT dst) OVER r AS nd FROM s
  WINDOW r AS (PARTITION BY src ORDER BY ts_us
    RANGE BETWEEN CURRENT ROW AND 21600000000 FOLLOWING)),
st AS (SELECT src, min(ts_us) AS t0 FROM w WHERE n >= 3 AND (np >= 5 OR nd >= 3) GROUP BY src),
rm AS (SELECT 'INC-RECON-' || replace(s.src, '.', '-') AS incident_id, s.* FROM s
  JOIN st ON s.src = st.src AND s.ts_us BETWEEN st.t0 AND st.t0 + 21600000000)"""

RECON_INC = """ri AS (SELECT incident_id, src AS source, 'RECONNAISSANCE' AS type,
    'HIGH' AS severity, count(*) AS event_count, count(DISTINCT port) AS unique_ports,
    count(DISTINCT dst) AS unique_destinations, min(ts_us) AS first_us, max(ts_us) AS last_us
  FROM rm GROUP BY incident_id, src)"""

# First window with two behaviours seen twice; the windows of the replay variant.
CHAIN = """c AS (SELECT * FROM sec WHERE type <> 'BENIGN'),
p AS (SELECT a.src, a.ts_us AS t0, b.type, count(*) AS n
  FROM (SELECT DISTINCT src, ts_us FROM c) a
  JOIN c b ON a.src = b.src AND b.ts_us BETWEEN a.ts_us AND a.ts_us + 86400000000
  GROUP BY ALL),
q AS (SELECT src, t0 FROM p WHERE n >= 2 GROUP BY src, t0 HAVING count(*) >= 2),
f AS (SELECT src, min(t0) AS t0 FROM q GROUP BY src),
cm AS (SELECT 'INC-' || replace(c.src, '.', '-') || '-CHAIN' AS incident_id, c.* FROM c
  JOIN f ON c.src = f.src AND c.ts_us BETWEEN f.t0 AND f.t0 + 86400000000),
ct AS (SELECT incident_id, src, type, count(*) AS n, min(ts_us) AS t1, arg_min(seq, ts_us) AS s1,
    max(ts_us) AS t2 FROM cm GROUP BY ALL)"""

HISTORY = """hb AS (SELECT src, type, count(*) AS n, min(ts_us) AS t1, max(ts_us) AS t2 FROM sec
    WHERE type NOT IN ('BENIGN', 'UNKNOWN_BEHAVIOR') GROUP BY ALL HAVING count(*) >= 2),
hi AS (SELECT 'INC-MULTI-' || replace(src, '.', '-') AS incident_id, src AS source,
    'MULTI_STAGE_ACTIVITY' AS type, 'HIGH' AS severity, CAST(sum(n) AS BIGINT) AS event_count,
    list_sort(list(type)) AS behaviors, min(t1) AS first_us, max(t2) AS last_us
  FROM hb GROUP BY src HAVING count(*) >= 2)"""

UNKNOWN = """ui AS (SELECT 'INC-UNKNOWN-' || pattern_id AS incident_id, src AS source, type, severity,
    1::BIGINT AS event_count, pattern_id, observations, 'NEW' AS status, ts_us AS first_us,
    ts_us AS last_us, seq FROM sec WHERE type = 'UNKNOWN_BEHAVIOR'),
ud AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, pattern_id
    ORDER BY seq DESC) AS rk FROM ui) WHERE rk = 1)"""

# All incidents after deduplication, and their events.
INCIDENTS = f"""{SEC}, {RECON}, {RECON_INC}, {HISTORY}, {UNKNOWN},
inc AS (
  SELECT incident_id, type, source, severity, event_count, unique_ports, unique_destinations,
    NULL::VARCHAR AS behaviors, NULL::VARCHAR AS pattern_id, NULL::BIGINT AS observations,
    NULL::VARCHAR AS status, first_us, last_us FROM ri
  UNION ALL SELECT incident_id, type, source, severity, event_count, NULL, NULL, NULL, pattern_id,
    observations, status, first_us, last_us FROM ud
  UNION ALL SELECT incident_id, type, source, severity, event_count, NULL, NULL,
    array_to_string(behaviors, ','), NULL, NULL, NULL, first_us, last_us FROM hi),
mem AS (
  SELECT incident_id, src AS source, seq FROM rm
  UNION ALL SELECT incident_id, source, seq FROM ud
  UNION ALL SELECT 'INC-MULTI-' || replace(s.src, '.', '-'), s.src, s.seq FROM s
    JOIN hb ON s.src = hb.src AND s.type = hb.type
    WHERE s.src IN (SELECT source FROM hi)),
tl AS (SELECT m.incident_id, m.source AS incident_source, e.* FROM mem m JOIN sec e USING (seq))"""
