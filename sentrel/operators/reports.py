"""Incident reports: timeline rows, behaviour counts and narratives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions.fixed import PATTERN_METHOD, REPORT_TEXTS


def _or(name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def incident_timeline(members: DataFrame, events: DataFrame) -> DataFrame:
    """Events of each incident with defaults for missing fields.

    One row per incident and event. Order by ``incident_id, ts_us, event_id`` at the sink.
    """
    keys = members.select("incident_id", F.col("source").alias("incident_source"), "seq")
    return keys.join(events, "seq").select(
        "incident_id",
        "incident_source",
        "ts_us",
        "event_id",
        _or("type", "UNKNOWN").alias("type"),
        _or("src", "UNKNOWN").alias("source"),
        _or("dst", "UNKNOWN").alias("destination"),
        _or("src_port", "0").alias("src_port"),
        _or("dst_port", "0").alias("dst_port"),
        _or("protocol", "UNKNOWN").alias("protocol"),
        "confidence",
        _or("severity", "MEDIUM").alias("severity"),
        "pattern_id",
    )


def behaviour_counts(timeline: DataFrame) -> DataFrame:
    """Events per incident and behaviour."""
    return timeline.groupBy("incident_id", "incident_source", "type").agg(
        F.count("*").alias("n")
    )


def behaviour_summary(timeline: DataFrame) -> DataFrame:
    """The same as one map per incident; it has one entry per behaviour class."""
    entries = F.sort_array(F.collect_list(F.struct("type", "n")))
    return (
        behaviour_counts(timeline)
        .groupBy("incident_id", "incident_source")
        .agg(
            F.map_from_entries(entries).alias("behavior_summary"),
            F.sum("n").alias("timeline_length"),
        )
    )


def first_last_seen(timeline: DataFrame) -> DataFrame:
    return timeline.groupBy("incident_id", "incident_source").agg(
        F.min("ts_us").alias("first_seen_us"), F.max("ts_us").alias("last_seen_us")
    )


def _text(kind: str, part: str) -> Column:
    return F.lit(REPORT_TEXTS[kind][part])


def narratives(incidents: DataFrame) -> DataFrame:
    """Add the reconstruction columns; ``timeline_length`` counts the incident's events."""
    source = _or("source", "UNKNOWN")
    length = F.coalesce("timeline_length", F.lit(0))
    n = F.coalesce(F.col("event_count"), length)
    ports, hosts = _or("unique_ports", 0), _or("unique_destinations", 0)
    pattern = _or("pattern_id", "UNKNOWN")
    seen, status = _or("observations", 0), _or("status", "NEW")
    if "detection_method" in incidents.columns:
        method = _or("detection_method", PATTERN_METHOD)
    else:
        method = F.lit(PATTERN_METHOD)
    shown = F.coalesce(
        F.concat(F.lit("['"), F.array_join("behaviors", "', '"), F.lit("']")), F.lit("{}")
    )
    kind = _or("type", "UNKNOWN")
    recon = kind == "RECONNAISSANCE"
    unknown = kind == "UNKNOWN_BEHAVIOR"
    multi = kind == "MULTI_STAGE_ACTIVITY"

    def pick(a, b, c, d):
        return F.when(recon, a).when(unknown, b).when(multi, c).otherwise(d)

    def fixed_text(part):
        return pick(
            _text("RECONNAISSANCE", part),
            _text("UNKNOWN_BEHAVIOR", part),
            _text("MULTI_STAGE_ACTIVITY", part),
            _text("OTHER", part),
        )

    summary = pick(
        F.format_string(
            "Source host %s generated %d suspicious network observations involving "
            "%d unique ports and %d unique destination(s) within the correlation window.",
            source, n, ports, hosts,
        ),
        F.format_string(
            "Pattern %s contains %d anomalous observations grouped into a recurring "
            "behavioral pattern.",
            pattern, seen,
        ),
        F.format_string(
            "Source host %s generated multiple suspicious behavioral stages that were "
            "correlated as a possible multi-stage incident.",
            source,
        ),
        F.format_string(
            "Incident classified as %s based on correlated network evidence.", kind
        ),
    )
    observations = pick(
        F.array(
            F.format_string("%d suspicious network observations were correlated.", n),
            F.format_string("%d unique destination ports were observed.", ports),
            F.format_string("%d unique destination(s) were observed.", hosts),
        ),
        F.array(
            F.format_string(
                "%d anomalous observations contributed to the discovered behavioral pattern.",
                seen,
            ),
            F.format_string("Pattern %s was created using %s.", pattern, method),
            F.format_string("Pattern status is %s.", status),
        ),
        F.array(
            F.format_string("%d suspicious network observations were correlated.", length),
            F.format_string("Observed behaviors: %s", shown),
        ),
        F.array(F.format_string("%d event(s) associated with the incident.", length)),
    )
    return incidents.select(
        "*",
        kind.alias("classification"),
        summary.alias("summary"),
        observations.alias("observation_texts"),
        fixed_text("inference").alias("inference"),
        fixed_text("limitation").alias("limitation"),
    )


def build_reports(incidents: DataFrame, timeline: DataFrame) -> DataFrame:
    """One report per incident; its timeline stays a table of its own."""
    counts = behaviour_summary(timeline).withColumnRenamed("incident_source", "source")
    named = narratives(incidents.join(counts, ["incident_id", "source"], "left"))
    return named.select(
        "incident_id",
        "type",
        "source",
        F.lit("UNKNOWN").alias("destination"),
        F.coalesce("severity", F.lit("MEDIUM")).alias("severity"),
        F.coalesce("event_count", "timeline_length").alias("event_count"),
        "behavior_summary",
        "classification",
        "summary",
        F.col("observation_texts").alias("observations"),
        "inference",
        "limitation",
    )
