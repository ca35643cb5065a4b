"""The operators strung together: packets to events, flows to patterns, events to reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions import fixed
from sentrel.functions.staging import materialise
from sentrel.operators import flows, forest, incidents, isolation, marts, patterns, reports
from sentrel.sources import events as event_source
from sentrel.sources import packets as packet_source


def packets_to_events(
    lines: DataFrame,
    model: PipelineModel,
    window_seconds: int = fixed.FLOW_WINDOW_SECONDS,
    lateness: str | None = None,
) -> DataFrame:
    """Packet text (``frame_no, value``) to classified security events, batch or stream."""
    packets = packet_source.accepted(packet_source.parse_packets(lines))
    if lateness:
        packets = packets.withWatermark("ts", lateness)
    found = flows.flow_features(packets, window_seconds)
    return flows.flow_events(forest.classify(found, model))


def flows_to_patterns(
    labelled: DataFrame,
    row_id: str,
    model: PipelineModel,
    anomalies: isolation.IsolationModel,
    store: DataFrame,
    features: Sequence[str] = fixed.FLOW_FEATURES,
    detected_at: Column | None = None,
) -> DataFrame:
    """Pattern store after looking for unknown behaviour in all the flows given.

    A caller who wants a scan of the first rows only passes ``quality.head_rows`` of them.
    """
    scored = isolation.flag_anomalies(forest.classify(labelled, model, features), anomalies)
    candidates = materialise(patterns.unknown_candidates(scored))
    labels = patterns.cluster_candidates(candidates, row_id, features)
    found = patterns.cluster_signatures(candidates, labels, row_id)
    return patterns.extend_store(found, store, detected_at)


def events_to_dashboard(
    events: DataFrame, window_seconds: int = fixed.CORRELATION_WINDOW_SECONDS
) -> dict[str, DataFrame]:
    """Incidents, their events, reports and timelines, and the dashboard tables."""
    found, members = incidents.correlate(events, window_seconds)
    timeline = reports.incident_timeline(members, events)
    return {
        **marts.dashboard(events, found),
        "incident_events": members,
        "incident_timeline": timeline,
        "reports": reports.build_reports(found, timeline),
    }


def write_dashboard(tables: dict[str, DataFrame], folder: str) -> None:
    """One JSON folder per table."""
    for name, df in tables.items():
        maps = [f.name for f in df.schema.fields if f.dataType.typeName() == "map"]
        event_source.write_documents(
            df.withColumns({c: F.to_json(c) for c in maps}), f"{folder}/{name}"
        )
