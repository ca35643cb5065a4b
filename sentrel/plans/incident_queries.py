"""Correlation, incident and report queries."""

from pyspark.sql import functions as F

from sentrel.operators import incidents as inc
from sentrel.operators import marts, reports
from sentrel.plans.adapters import EVENT_WINDOW_SECONDS as SPAN
from sentrel.plans.adapters import sec_events
from sentrel.plans.registry import query
from sentrel.sources import events as events_source
from sentrel.plans.sql_parts import CHAIN, HISTORY, INCIDENTS, RECON, RECON_INC, SEC, UNKNOWN

RECON_COLS = [
    "incident_id", "source", "type", "severity", "event_count", "unique_ports",
    "unique_destinations", "first_us", "last_us",
]
INC_COLS = [
    "incident_id", "type", "source", "severity", "event_count", "unique_ports",
    "unique_destinations", "behaviors", "pattern_id", "observations", "status",
    "first_us", "last_us",
]
CHAIN_SPAN = 86_400


def _flat(df):
    return df.withColumn("behaviors", F.array_join("behaviors", ","))


def _everything(spark, sf_dir):
    events = sec_events(spark, sf_dir)
    found, members = inc.correlate(events, SPAN)
    timeline = reports.incident_timeline(members, events)
    return events, found, timeline


@query("recon_windowed", f"WITH {SEC}, {RECON}, {RECON_INC} SELECT * FROM ri")
def recon_windowed(spark, sf_dir):
    found = inc.recon_incidents(sec_events(spark, sf_dir), window_seconds=SPAN)
    return found.select(*RECON_COLS)


@query(
    "recon_entities",
    f"""WITH {SEC}, {RECON}
    SELECT DISTINCT incident_id, 'port' AS kind, CAST(port AS VARCHAR) AS entity FROM rm
      WHERE port IS NOT NULL
    UNION ALL SELECT DISTINCT incident_id, 'destination', dst FROM rm""",
)
def recon_entities(spark, sf_dir):
    return inc.recon_entities(inc.recon_members(sec_events(spark, sf_dir), window_seconds=SPAN))


REPLAY = (
    RECON.replace("type NOT IN ('BENIGN', 'UNKNOWN_BEHAVIOR')", "type <> 'BENIGN'")
    .replace("TRY_CAST(dst_port AS BIGINT)", "dst_port")
    .replace("INC-RECON-", "INC-")
)


@query("recon_replay_variant", f"WITH {SEC}, {REPLAY}, {RECON_INC} SELECT * FROM ri")
def recon_replay_variant(spark, sf_dir):
    found = inc.recon_incidents_replay(sec_events(spark, sf_dir), window_seconds=SPAN)
    return found.select(*RECON_COLS)


@query(
    "multistage_windowed",
    f"""WITH {SEC}, {CHAIN}
    SELECT incident_id, src AS source, 'MULTI_STAGE_ACTIVITY' AS type, 'CRITICAL' AS severity,
      CAST(sum(n) FILTER (n >= 2) AS BIGINT) AS event_count,
      string_agg(type, ' → ' ORDER BY t1, s1) FILTER (n >= 2) AS attack_chain,
      string_agg(type || '=' || n, ',' ORDER BY type) AS behavior_counts,
      min(t1) AS first_us, max(t2) AS last_us
    FROM ct GROUP BY incident_id, src""",
)
def multistage_windowed(spark, sf_dir):
    found = inc.chain_incidents(sec_events(spark, sf_dir), window_seconds=CHAIN_SPAN)
    pairs = F.transform(
        F.sort_array(F.map_entries("behavior_counts")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return found.select(
        "incident_id", "source", "type", "severity", "event_count",
        F.array_join("attack_chain", " → ").alias("attack_chain"),
        F.array_join(pairs, ",").alias("behavior_counts"),
        "first_us", "last_us",
    )


@query(
    "multistage_members",
    f"""WITH {SEC}, {CHAIN} SELECT cm.incident_id, cm.seq, cm.type FROM cm
    JOIN ct ON cm.incident_id = ct.incident_id AND cm.type = ct.type WHERE ct.n >= 2""",
)
def multistage_members(spark, sf_dir):
    found = inc.chain_members(sec_events(spark, sf_dir), window_seconds=CHAIN_SPAN)
    return found.select("incident_id", "seq", "type")


@query(
    "multistage_history",
    f"""WITH {SEC}, {HISTORY} SELECT incident_id, source, type, severity, event_count,
      array_to_string(behaviors, ',') AS behaviors, first_us, last_us FROM hi""",
)
def multistage_history(spark, sf_dir):
    return _flat(inc.history_incidents(sec_events(spark, sf_dir))).select(
        "incident_id", "source", "type", "severity", "event_count", "behaviors",
        "first_us", "last_us",
    )


@query("unknown_incidents", f"WITH {SEC}, {UNKNOWN} SELECT * FROM ui")
def unknown_incidents(spark, sf_dir):
    found = inc.unknown_incidents(sec_events(spark, sf_dir))
    return found.withColumnRenamed("emit_seq", "seq").drop("event_id", "detection_method", "evidence")


@query("incident_dedup", f"WITH {INCIDENTS} SELECT * FROM inc")
def incident_dedup(spark, sf_dir):
    return _flat(inc.correlate(sec_events(spark, sf_dir), SPAN)[0]).select(*INC_COLS)


@query("incident_members", f"WITH {INCIDENTS} SELECT * FROM mem")
def incident_members(spark, sf_dir):
    return inc.correlate(sec_events(spark, sf_dir), SPAN)[1]


@query(
    "incident_timeline",
    f"""WITH {INCIDENTS} SELECT incident_id, incident_source, ts_us, event_id, type,
      src AS source, dst AS destination, src_port, dst_port, protocol, confidence, severity,
      pattern_id FROM tl""",
)
def incident_timeline(spark, sf_dir):
    return _everything(spark, sf_dir)[2]


@query(
    "behavior_summary",
    f"""WITH {INCIDENTS} SELECT incident_id, incident_source, type, count(*) AS n FROM tl
    GROUP BY ALL""",
)
def behavior_summary(spark, sf_dir):
    return reports.behaviour_counts(_everything(spark, sf_dir)[2])


@query(
    "incident_first_last",
    f"""WITH {INCIDENTS} SELECT incident_id, incident_source, min(ts_us) AS first_seen_us,
      max(ts_us) AS last_seen_us FROM tl GROUP BY ALL""",
)
def incident_first_last(spark, sf_dir):
    return reports.first_last_seen(_everything(spark, sf_dir)[2])


@query(
    "incident_ranking",
    f"""WITH {INCIDENTS} SELECT incident_id, source, severity, last_us,
      CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2
        WHEN 'LOW' THEN 1 ELSE 0 END AS weight FROM inc""",
)
def incident_ranking(spark, sf_dir):
    found = inc.correlate(sec_events(spark, sf_dir), SPAN)[0]
    return marts.rank_incidents(found).select(
        "incident_id", "source", "severity", "last_us", "weight"
    )


@query(
    "incident_reports",
    f"""WITH {INCIDENTS},
    bs AS (SELECT incident_id, incident_source, string_agg(type || '=' || n, ',' ORDER BY type)
        AS behavior_summary, sum(n) AS len
      FROM (SELECT incident_id, incident_source, type, count(*) AS n FROM tl GROUP BY ALL)
      GROUP BY ALL)
    SELECT i.incident_id, i.type, i.source, 'UNKNOWN' AS destination, i.severity, i.event_count,
      b.behavior_summary, i.type AS classification,
      CASE i.type
        WHEN 'RECONNAISSANCE' THEN 'Source host ' || i.source || ' generated ' || i.event_count
          || ' suspicious network observations involving ' || i.unique_ports
          || ' unique ports and ' || i.unique_destinations
          || ' unique destination(s) within the correlation window.'
        WHEN 'UNKNOWN_BEHAVIOR' THEN 'Pattern ' || i.pattern_id || ' contains '
          || i.observations
          || ' anomalous observations grouped into a recurring behavioral pattern.'
        ELSE 'Source host ' || i.source || ' generated multiple suspicious behavioral stages '
          || 'that were correlated as a possible multi-stage incident.' END AS summary,
      CASE i.type
        WHEN 'RECONNAISSANCE' THEN i.event_count
          || ' suspicious network observations were correlated.|' || i.unique_ports
          || ' unique destination ports were observed.|' || i.unique_destinations
          || ' unique destination(s) were observed.'
        WHEN 'UNKNOWN_BEHAVIOR' THEN i.observations
          || ' anomalous observations contributed to the discovered behavioral pattern.|Pattern '
          || i.pattern_id || ' was created using IsolationForest + DBSCAN.|Pattern status is '
          || i.status || '.'
        ELSE CAST(b.len AS BIGINT)
          || ' suspicious network observations were correlated.|Observed behaviors: ['''
          || replace(i.behaviors, ',', ''', ''') || ''']' END AS observations
    FROM inc i JOIN bs b ON i.incident_id = b.incident_id AND i.source = b.incident_source""",
)
def incident_reports(spark, sf_dir):
    _, found, timeline = _everything(spark, sf_dir)
    entries = F.transform(
        F.sort_array(F.map_entries("behavior_summary")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return (
        reports.build_reports(found, timeline)
        .drop("inference", "limitation")
        .withColumn("behavior_summary", F.array_join(entries, ","))
        .withColumn("observations", F.array_join("observations", "|"))
    )


@query(
    "incident_cards",
    f"""WITH {INCIDENTS},
    fl AS (SELECT incident_id, incident_source, min(ts_us) AS first_seen_us,
        max(ts_us) AS last_seen_us FROM tl GROUP BY ALL),
    fd AS (SELECT incident_id, incident_source, dst FROM tl QUALIFY row_number() OVER (
        PARTITION BY incident_id, incident_source ORDER BY ts_us, event_id) = 1)
    SELECT i.incident_id, i.source, i.type, i.severity, fd.dst AS destination,
      i.type || '=' || i.event_count AS pairs,
      coalesce(i.observations, i.event_count) AS observations,
      'Temporal correlation' AS default_method, fl.first_seen_us, fl.last_seen_us
    FROM inc i
    LEFT JOIN fl ON i.incident_id = fl.incident_id AND i.source = fl.incident_source
    LEFT JOIN fd ON i.incident_id = fd.incident_id AND i.source = fd.incident_source""",
)
def incident_cards(spark, sf_dir):
    _, found, timeline = _everything(spark, sf_dir)
    entries = F.transform(
        F.map_entries("pairs"),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return marts.incident_cards(found, timeline).withColumn("pairs", F.array_join(entries, ","))


@query(
    "incident_selected",
    f"""WITH {INCIDENTS} SELECT incident_id, source, type, severity, 0 AS origin FROM inc
    WHERE incident_id = 'INC-MULTI-10-0-0-7'""",
)
def incident_selected(spark, sf_dir):
    _, found, timeline = _everything(spark, sf_dir)
    return marts.select_incident(
        reports.build_reports(found, timeline), found, "INC-MULTI-10-0-0-7"
    )


# Events as JSON lines: some lines blank, some cut off, some with a time that does not parse.
def _lines(spark, sf_dir):
    e = sec_events(spark, sf_dir)
    whole = F.to_json(
        F.struct(
            "event_id",
            F.when(F.col("seq") % 43 == 0, "yesterday")
            .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
            .alias("timestamp"),
            "src", "dst", "src_port",
            F.col("dst_port").cast("int").alias("dst_port"),
            "protocol", "type", "confidence", "severity", "pattern_id",
        )
    )
    line = (
        F.when(F.col("seq") % 47 == 0, "  ")
        .when(F.col("seq") % 41 == 0, F.substring(whole, 1, 40))
        .otherwise(whole)
    )
    return e.select(F.col("seq").alias("line_no"), line.alias("value"))


@query(
    "event_base",
    f"""WITH {SEC} SELECT seq AS line_no, event_id,
      CASE WHEN seq % 43 = 0 THEN NULL ELSE ts_us END AS ts_us, src, dst, src_port, dst_port,
      protocol, type, confidence, severity, pattern_id
    FROM sec WHERE seq % 47 <> 0 AND seq % 41 <> 0""",
)
def event_base(spark, sf_dir):
    return events_source.good_events(events_source.parse_events(_lines(spark, sf_dir))).select(
        "line_no", "event_id", "ts_us", "src", "dst", "src_port", "dst_port", "protocol", "type",
        "confidence", "severity", "pattern_id",
    )


@query(
    "event_quarantine",
    f"""WITH {SEC} SELECT seq AS line_no, 'MALFORMED_JSON' AS reason FROM sec
    WHERE seq % 47 <> 0 AND seq % 41 = 0""",
)
def event_quarantine(spark, sf_dir):
    parsed = events_source.parse_events(_lines(spark, sf_dir))
    return events_source.malformed_events(parsed).drop("value")
