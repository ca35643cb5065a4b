"""Graph and dashboard queries."""

from pyspark.sql import functions as F

from sentrel.functions import fixed
from sentrel.operators import graph, marts
from sentrel.operators import incidents as inc
from sentrel.plans.adapters import EVENT_WINDOW_SECONDS as SPAN
from sentrel.plans.adapters import sec_events
from sentrel.plans.registry import query
from sentrel.plans.sql_parts import INCIDENTS, SEC

# 2024-01-15T00:00:00Z, the middle of the event period.
AT_US = 1_705_276_800_000_000

NODES = """ends AS (SELECT src AS id, 'SOURCE' AS type, seq, 0 AS slot FROM sec
  UNION ALL SELECT dst, 'DESTINATION', seq, 1 FROM sec),
nodes AS (SELECT id, type FROM ends
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq, slot) = 1)"""
EDGE_ENDS = """deg AS (SELECT id, count(*) AS degree FROM ends GROUP BY id)"""
TIMELINE = """tl AS (SELECT ts_us, event_id, seq, src AS source, dst AS destination,
  dst_port AS port, type, confidence, severity FROM sec WHERE type <> 'BENIGN')"""


def _graph(spark, sf_dir):
    events = sec_events(spark, sf_dir)
    return graph.graph_nodes(events), graph.graph_edges(events)


def _timeline(spark, sf_dir):
    return marts.timeline(sec_events(spark, sf_dir))


@query("graph_nodes", f"WITH {SEC}, {NODES} SELECT * FROM nodes")
def graph_nodes(spark, sf_dir):
    return graph.graph_nodes(sec_events(spark, sf_dir))


@query(
    "graph_edges",
    f"""WITH {SEC} SELECT src AS source, dst AS target, type, type AS behavior, confidence,
      ts_us, seq FROM sec""",
)
def graph_edges(spark, sf_dir):
    return graph.graph_edges(sec_events(spark, sf_dir))


@query(
    "graph_host_variant",
    f"""WITH {SEC}, {NODES}, v AS (SELECT id, CASE type WHEN 'SOURCE' THEN 'HOST' ELSE type END
        AS type FROM nodes)
    SELECT v.type, count(*) AS nodes, (SELECT round(sum(coalesce(confidence, 0)), 6) FROM sec)
      AS total_confidence FROM v GROUP BY ALL""",
)
def graph_host_variant(spark, sf_dir):
    events = sec_events(spark, sf_dir)
    total = graph.graph_edges(events, hosts_only=True).agg(F.round(F.sum("confidence"), 6)).scalar()
    nodes = graph.graph_nodes(events, hosts_only=True)
    return nodes.groupBy("type").agg(F.count("*").alias("nodes")).withColumn(
        "total_confidence", total
    )


@query("graph_degree", f"WITH {SEC}, {NODES}, {EDGE_ENDS} SELECT * FROM deg")
def graph_degree(spark, sf_dir):
    return graph.degrees(_graph(spark, sf_dir)[1])


@query(
    "graph_neighbors",
    f"""WITH {SEC} SELECT DISTINCT src AS id, dst AS neighbor FROM sec
    UNION SELECT dst, src FROM sec""",
)
def graph_neighbors(spark, sf_dir):
    return graph.neighbour_pairs(_graph(spark, sf_dir)[1])


SHOWN = f"""{SEC}, {NODES}, shown AS (SELECT * FROM sec WHERE ts_us <= {AT_US}),
vis AS (SELECT * FROM nodes WHERE id IN (SELECT src FROM shown UNION SELECT dst FROM shown))"""


@query("graph_as_of_nodes", f"WITH {SHOWN} SELECT * FROM vis WHERE type <> 'SOURCE'")
def graph_as_of_nodes(spark, sf_dir):
    return graph.as_of_view(*_graph(spark, sf_dir), AT_US, ("SOURCE",))[0]


@query(
    "graph_as_of",
    f"""WITH {SHOWN} SELECT src AS source, dst AS target, type, seq FROM shown
    WHERE src IN (SELECT id FROM vis) AND dst IN (SELECT id FROM vis)""",
)
def graph_as_of(spark, sf_dir):
    links = graph.as_of_view(*_graph(spark, sf_dir), AT_US)[1]
    return links.select("source", "target", "type", "seq")


@query("graph_types", f"WITH {SEC}, {NODES} SELECT DISTINCT type FROM nodes")
def graph_types(spark, sf_dir):
    return graph.node_types(_graph(spark, sf_dir)[0])


@query("graph_search", f"WITH {SEC}, {NODES} SELECT * FROM nodes WHERE id LIKE '%.0.1%'")
def graph_search(spark, sf_dir):
    return graph.search_nodes(_graph(spark, sf_dir)[0], ".0.1")


@query(
    "node_category",
    f"""WITH {SEC}, {NODES}, {EDGE_ENDS} SELECT n.id, n.type, coalesce(degree, 0) AS degree,
      round(greatest(8.0::DOUBLE, log2(coalesce(degree, 0) + 2) * 5), 6) AS weight,
      CASE WHEN length(n.id) > 18 THEN left(n.id, 18) || '...' ELSE n.id END AS label,
      '#808080' AS colour,
      CASE n.type WHEN 'SOURCE' THEN '#ef4444' ELSE '#10b981' END AS view_colour
    FROM nodes n LEFT JOIN deg USING (id)""",
)
def node_category(spark, sf_dir):
    return graph.node_styles(*_graph(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query(
    "edge_display",
    f"""WITH {SEC} SELECT src AS "Source", dst AS "Target", type AS "Behavior",
      confidence AS "Confidence", ts_us AS "Timestamp" FROM sec""",
)
def edge_display(spark, sf_dir):
    return graph.edge_display(_graph(spark, sf_dir)[1])


@query("event_distribution", f"WITH {SEC} SELECT type, count(*) AS n FROM sec GROUP BY type")
def event_distribution(spark, sf_dir):
    return marts.event_distribution(sec_events(spark, sf_dir))


@query(
    "threat_counts",
    f"WITH {SEC} SELECT type, count(*) AS n FROM sec WHERE type <> 'BENIGN' GROUP BY type",
)
def threat_counts(spark, sf_dir):
    return marts.threat_counts(sec_events(spark, sf_dir))


@query(
    "severity_counts", f"WITH {SEC} SELECT severity, count(*) AS n FROM sec GROUP BY severity"
)
def severity_counts(spark, sf_dir):
    return marts.severity_counts(sec_events(spark, sf_dir))


SUMMARY = f"""{INCIDENTS}, total AS (SELECT count(*) AS total_events,
  count(*) FILTER (type <> 'BENIGN') AS suspicious_events,
  (SELECT count(*) FROM inc) AS incidents FROM sec)"""


def _summary(spark, sf_dir):
    events = sec_events(spark, sf_dir)
    return marts.summary(events, inc.correlate(events, SPAN)[0])


@query("dashboard_summary", f"WITH {SUMMARY} SELECT * FROM total")
def dashboard_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


@query(
    "security_score",
    f"""WITH {SUMMARY} SELECT greatest(0, 100 - incidents * 15 - suspicious_events * 2)::BIGINT
      AS score FROM total""",
)
def security_score(spark, sf_dir):
    return marts.security_score(_summary(spark, sf_dir))


@query(
    "highest_severity",
    f"""WITH {SEC}, s AS (SELECT DISTINCT severity AS v, CASE severity WHEN 'CRITICAL' THEN 4
        WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END AS w FROM sec)
    SELECT arg_max(v, w) AS highest, CASE WHEN max(w) = 4 THEN 'CRITICAL'
      WHEN bool_or(w = 3) THEN 'HIGH' ELSE 'NORMAL' END AS highest_short FROM s""",
)
def highest_severity(spark, sf_dir):
    return marts.highest_severity(sec_events(spark, sf_dir))


@query(
    "mean_confidence",
    f"""WITH {SEC} SELECT round(avg(confidence) * 100, 6) AS mean_confidence FROM sec
    WHERE type <> 'BENIGN'""",
)
def mean_confidence(spark, sf_dir):
    return marts.mean_confidence(sec_events(spark, sf_dir)).select(
        F.round("mean_confidence", 6).alias("mean_confidence")
    )


@query(
    "threat_share",
    f"""WITH {SEC}, t AS (SELECT type, count(*) AS n FROM sec WHERE type <> 'BENIGN' GROUP BY 1)
    SELECT type, CASE type WHEN 'DOS' THEN 'Dos' WHEN 'PORT_SCAN' THEN 'Port Scan'
        WHEN 'BRUTE_FORCE' THEN 'Brute Force' ELSE 'Unknown Behavior' END AS label, n,
      round(greatest(3.0::DOUBLE, n * 100.0::DOUBLE / (SELECT count(*) FROM sec)), 6) AS share
    FROM t""",
)
def threat_share(spark, sf_dir):
    shares = marts.threat_share(sec_events(spark, sf_dir))
    return shares.withColumn("share", F.round("share", 6))


@query("dashboard_timeline", f"WITH {SEC}, {TIMELINE} SELECT * FROM tl")
def dashboard_timeline(spark, sf_dir):
    return _timeline(spark, sf_dir)


@query(
    "timeline_display",
    f"""WITH {SEC}, {TIMELINE} SELECT ts_us AS "Time", source AS "Source",
      destination AS "Destination", port AS "Port", type AS "Type",
      confidence AS "Confidence", severity AS "Severity" FROM tl""",
)
def timeline_display(spark, sf_dir):
    return marts.timeline_display(_timeline(spark, sf_dir))


@query(
    "timeline_recent",
    f"""WITH {SEC}, {TIMELINE} SELECT ts_us, event_id, type, severity,
      CASE WHEN type = 'UNKNOWN_BEHAVIOR'
        THEN 'Anomalous pattern detected originating from ' || source
        ELSE 'Potential ' || replace(type, '_', ' ') || ' detected targeting ' || destination
        END AS description,
      CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 0 END AS score,
      CASE type WHEN 'DOS' THEN 'Dos' WHEN 'PORT_SCAN' THEN 'Port Scan'
        WHEN 'BRUTE_FORCE' THEN 'Brute Force' ELSE 'Unknown Behavior' END AS label
    FROM tl WHERE severity = 'MEDIUM' AND ts_us >= (SELECT max(ts_us) FROM tl) - 604800000000
    ORDER BY ts_us DESC, seq DESC LIMIT 200""",
)
def timeline_recent(spark, sf_dir):
    rows = marts.recent(
        _timeline(spark, sf_dir), fixed.TIMELINE_LIMIT, severity="medium", span="7D"
    )
    return marts.describe_events(rows).select(
        "ts_us", "event_id", "type", "severity", "description", "score", "label"
    )


@query(
    "timeline_burst",
    f"""WITH {SEC}, {TIMELINE} SELECT count(*) AS n, min(ts_us) AS start_us,
      max(ts_us) AS end_us FROM tl WHERE type = 'PORT_SCAN'""",
)
def timeline_burst(spark, sf_dir):
    return marts.burst(_timeline(spark, sf_dir))


@query(
    "timeline_key_events",
    f"WITH {SEC}, {TIMELINE} SELECT * FROM tl WHERE type <> 'PORT_SCAN'",
)
def timeline_key_events(spark, sf_dir):
    return marts.key_events(_timeline(spark, sf_dir))


@query(
    "timeline_axis",
    f"""WITH {SEC}, {TIMELINE},
    r AS (SELECT min(ts_us) // 1000 AS lo, max(ts_us) // 1000 AS hi FROM tl),
    b AS (SELECT lo - (hi - lo) * 0.05::DOUBLE AS a, hi + (hi - lo) * 0.05::DOUBLE AS z FROM r)
    SELECT i * 25.0::DOUBLE AS pct, round(a + (z - a) * i / 4.0::DOUBLE, 1) AS at_ms
    FROM b, range(5) g(i)""",
)
def timeline_axis(spark, sf_dir):
    return marts.axis_markers(_timeline(spark, sf_dir)).withColumn("at_ms", F.round("at_ms", 1))


@query(
    "timeline_clusters",
    f"""WITH RECURSIVE {SEC}, {TIMELINE},
    l AS (SELECT ts_us // 1000 AS ms, seq, event_id, severity, CASE severity WHEN 'CRITICAL' THEN 4
        WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END AS w
      FROM tl ORDER BY ts_us DESC, seq DESC LIMIT 200),
    r AS (SELECT *, row_number() OVER (ORDER BY ms, seq) AS rn FROM l),
    p AS (SELECT min(ms) AS lo, max(ms) - min(ms) AS len,
      CASE WHEN max(ms) = min(ms) THEN 300000.0::DOUBLE
        ELSE (max(ms) - min(ms)) * 0.05::DOUBLE END AS pad FROM l),
    b AS (SELECT lo - pad AS m, len + 2 * pad AS d FROM p),
    f AS (SELECT rn, 0 AS g, event_id AS id, 1 AS n, ms::DOUBLE AS total,
        (ms - m) / d * 100 AS pct, severity AS sev, w FROM r CROSS JOIN b WHERE rn = 1
      UNION ALL SELECT r.rn, CASE WHEN near THEN f.g ELSE f.g + 1 END,
        CASE WHEN near THEN f.id ELSE r.event_id END, CASE WHEN near THEN f.n + 1 ELSE 1 END,
        CASE WHEN near THEN f.total + r.ms ELSE r.ms END,
        CASE WHEN near THEN ((f.total + r.ms) / (f.n + 1) - m) / d * 100
          ELSE (r.ms - m) / d * 100 END,
        CASE WHEN near AND f.w >= r.w THEN f.sev ELSE r.severity END,
        CASE WHEN near THEN greatest(f.w, r.w) ELSE r.w END
      FROM f JOIN r ON r.rn = f.rn + 1 CROSS JOIN b,
        LATERAL (SELECT (r.ms - m) / d * 100 - f.pct < 4 AS near))
    SELECT CAST(g AS INT) AS position, arg_max(id, rn) AS id, max(n) AS n,
      round(arg_max(pct, rn), 6) AS pct, arg_max(sev, rn) AS max_severity FROM f GROUP BY g""",
)
def timeline_clusters(spark, sf_dir):
    groups = marts.timeline_groups(_timeline(spark, sf_dir), fixed.TIMELINE_LIMIT)
    return groups.withColumn("pct", F.round("pct", 6))


@query(
    "replay_progress",
    f"""WITH {SEC}, {TIMELINE}, r AS (SELECT min(ts_us) AS a, max(ts_us) AS z FROM tl)
    SELECT a AS start_us, z AS end_us,
      round(greatest(0, least(100, ({AT_US} - a) * 100.0::DOUBLE / (z - a))), 6) AS progress,
      round(greatest((z - a) / 100.0::DOUBLE, 1000000), 1) AS step_us FROM r""",
)
def replay_progress(spark, sf_dir):
    return marts.replay_progress(_timeline(spark, sf_dir), AT_US).withColumns(
        {"progress": F.round("progress", 6), "step_us": F.round("step_us", 1)}
    )
