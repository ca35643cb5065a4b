"""Dashboard tables: counts, scores, timelines, rankings and cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrel.functions import fixed
from sentrel.functions.scalars import severity_weight, title_case
from sentrel.operators import graph

def _benign():
    return F.col("type").eqNullSafe("BENIGN")


def event_distribution(events: DataFrame) -> DataFrame:
    kinds = events.groupBy(F.coalesce("type", F.lit("UNKNOWN")).alias("type"))
    return kinds.agg(F.count("*").alias("n")).orderBy("type")


def threat_counts(events: DataFrame) -> DataFrame:
    return (
        events.where(~_benign())
        .groupBy(F.coalesce("type", F.lit("UNKNOWN")).alias("type"))
        .agg(F.count("*").alias("n"))
    )


def severity_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.coalesce("severity", F.lit("UNKNOWN")).alias("severity")).agg(
        F.count("*").alias("n")
    )


def summary(events: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row: total and suspicious events, incidents."""
    zero = F.lit(0).cast("bigint")
    of_events = events.agg(
        F.count("*").alias("total_events"),
        F.count_if(~_benign()).alias("suspicious_events"),
        zero.alias("incidents"),
    )
    of_incidents = incidents.agg(F.count("*").alias("incidents")).select(
        zero.alias("total_events"), zero.alias("suspicious_events"), "incidents"
    )
    both = of_events.union(of_incidents)
    return both.agg(*[F.sum(c).alias(c) for c in both.columns])


def security_score(totals: DataFrame) -> DataFrame:
    loss = F.col("incidents") * 15 + F.col("suspicious_events") * 2
    return totals.select(F.greatest(F.lit(0), 100 - loss).cast("bigint").alias("score"))


def highest_severity(events: DataFrame) -> DataFrame:
    """By weight over all names, and by the short scale NORMAL < HIGH < CRITICAL."""
    counts = severity_counts(events)
    short = F.when(F.max(F.col("severity") == "CRITICAL"), "CRITICAL").when(
        F.max(F.col("severity") == "HIGH"), "HIGH"
    )
    return counts.agg(
        F.coalesce(
            F.max_by("severity", F.struct(severity_weight("severity"), "severity")),
            F.lit("NORMAL"),
        ).alias("highest"),
        F.coalesce(short, F.lit("NORMAL")).alias("highest_short"),
    )


def mean_confidence(events: DataFrame) -> DataFrame:
    """Mean confidence of the timeline in percent; missing values do not count."""
    known = events.where(~_benign() & F.col("confidence").isNotNull())
    return known.agg((F.avg("confidence") * 100).alias("mean_confidence"))


def threat_share(events: DataFrame) -> DataFrame:
    """Share of all events per threat in percent, shown as 3 at least."""
    total = events.agg(F.greatest(F.count("*"), F.lit(1)).alias("total")).scalar()
    share = F.greatest(F.lit(3.0), F.col("n") * 100.0 / total)
    return threat_counts(events).select(
        "type", title_case("type").alias("label"), "n", share.alias("share")
    )


def timeline(events: DataFrame, evidence_only: bool = False) -> DataFrame:
    """Dashboard timeline of everything but benign; sort by ``ts_us, event_id`` at the sink."""
    fields = {f.name: f.dataType for f in events.schema.fields}
    port = F.lit(None).cast("string") if evidence_only else F.col("dst_port").cast("string")
    if "evidence" in fields and "dst_port" in getattr(fields["evidence"], "names", []):
        inner = F.col("evidence.dst_port").cast("string")
        port = inner if evidence_only else F.coalesce(inner, port)
    return events.where(~_benign()).select(
        "ts_us",
        "event_id",
        "seq",
        F.coalesce("src", F.lit("")).alias("source"),
        F.coalesce("dst", F.lit("")).alias("destination"),
        port.alias("port"),
        F.coalesce("type", F.lit("UNKNOWN")).alias("type"),
        "confidence",
        F.coalesce("severity", F.lit("UNKNOWN")).alias("severity"),
    )


def timeline_display(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("ts_us").alias("Time"),
        F.col("source").alias("Source"),
        F.col("destination").alias("Destination"),
        F.col("port").alias("Port"),
        F.col("type").alias("Type"),
        F.col("confidence").alias("Confidence"),
        F.col("severity").alias("Severity"),
    )


def describe_events(rows: DataFrame) -> DataFrame:
    """Add the description line, severity score and type label of each event."""
    text = F.when(
        F.col("type") == "UNKNOWN_BEHAVIOR",
        F.concat(F.lit("Anomalous pattern detected originating from "), "source"),
    ).otherwise(
        F.concat(
            F.lit("Potential "),
            F.translate("type", "_", " "),
            F.lit(" detected targeting "),
            "destination",
        )
    )
    return rows.withColumns(
        {
            "description": text,
            "score": severity_weight("severity"),
            "label": title_case("type"),
        }
    )


def recent(
    rows: DataFrame,
    limit: int,
    severity: str | None = None,
    span: str | None = None,
) -> DataFrame:
    """Last rows in time after the severity and relative time filters; newest first."""
    out = rows
    if severity:
        out = out.where(F.upper("severity") == severity.upper())
    if span:
        newest = rows.agg(F.max("ts_us")).scalar()
        out = out.where(F.col("ts_us") >= newest - fixed.TIME_FILTERS[span] * 1_000_000)
    return out.orderBy(F.col("ts_us").desc(), F.col("seq").desc()).limit(limit)


def padded_range(rows: DataFrame) -> DataFrame:
    """Time range in ms, padded by 5 percent, or by 5 minutes when it has no length."""
    ms = F.floor(F.col("ts_us") / 1000)
    span = F.col("hi") - F.col("lo")
    pad = F.when(span == 0, 300_000.0).otherwise(span * 0.05)
    return (
        rows.agg(F.min(ms).alias("lo"), F.max(ms).alias("hi"))
        .where(F.col("lo").isNotNull())
        .select((F.col("lo") - pad).alias("min_ms"), (F.col("hi") + pad).alias("max_ms"))
        .withColumn("span_ms", F.col("max_ms") - F.col("min_ms"))
    )


def axis_markers(rows: DataFrame, n: int = 5) -> DataFrame:
    """Evenly spaced markers over the padded range."""
    pct = F.col("i") * (100.0 / (n - 1))
    return (
        padded_range(rows)
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
        .select(
            pct.alias("pct"),
            (F.col("min_ms") + F.col("span_ms") * (pct / 100)).alias("at_ms"),
        )
    )


def timeline_groups(
    rows: DataFrame,
    limit: int,
    percent: float = fixed.TIMELINE_GROUP_PERCENT,
) -> DataFrame:
    """Walk the last ``limit`` events; join a group while its centre is near, else open one.

    The fold depends on order, and its input is at most ``limit`` rows by definition.
    """
    last = recent(rows, limit).withColumn("ms", F.floor(F.col("ts_us") / 1000))
    item = F.struct("ms", "seq", "event_id", "severity", severity_weight("severity").alias("w"))
    packed = last.agg(
        F.sort_array(F.collect_list(item)).alias("xs"),
        F.min("ms").alias("lo"),
        F.max("ms").alias("hi"),
    ).where(F.size("xs") > 0)
    pad = F.when(F.col("hi") == F.col("lo"), 300_000.0).otherwise(
        (F.col("hi") - F.col("lo")) * 0.05
    )
    packed = packed.withColumn("m", F.col("lo") - pad).withColumn(
        "d", F.col("hi") - F.col("lo") + 2 * pad
    )
    group = "struct<id:string,n:int,total:double,pct:double,sev:string,w:int>"
    fold = f"""
    aggregate(xs,
      named_struct('done', cast(array() as array<{group}>), 'g', cast(null as {group})),
      (a, x) -> if(a.g is not null and (x.ms - m) / d * 100 - a.g.pct < {percent},
        named_struct('done', a.done, 'g', named_struct(
          'id', a.g.id, 'n', a.g.n + 1, 'total', a.g.total + x.ms,
          'pct', ((a.g.total + x.ms) / (a.g.n + 1) - m) / d * 100,
          'sev', if(x.w > a.g.w, x.severity, a.g.sev), 'w', greatest(x.w, a.g.w))),
        named_struct(
          'done', if(a.g is null, a.done, concat(a.done, array(a.g))),
          'g', named_struct('id', x.event_id, 'n', 1, 'total', cast(x.ms as double),
            'pct', cast((x.ms - m) / d * 100 as double), 'sev', x.severity, 'w', x.w))),
      a -> concat(a.done, array(a.g)))"""
    return packed.select(F.posexplode(F.expr(fold)).alias("position", "g")).select(
        "position",
        F.col("g.id").alias("id"),
        F.col("g.n").cast("bigint").alias("n"),
        F.col("g.pct").alias("pct"),
        F.col("g.sev").alias("max_severity"),
    )


def replay_progress(rows: DataFrame, at_us: int) -> DataFrame:
    """Progress percent at an instant and the length of one replay step."""
    lo, span = F.col("start_us"), F.col("end_us") - F.col("start_us")
    progress = F.when(span == 0, 100.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.lit(at_us) - lo) * 100.0 / span))
    )
    return rows.agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us")).select(
        "start_us",
        "end_us",
        progress.alias("progress"),
        F.greatest(span / 100.0, F.lit(1_000_000.0)).alias("step_us"),
    )


def burst(rows: DataFrame, kind: str = "PORT_SCAN") -> DataFrame:
    """The repetitive behaviour as one count with start and end."""
    hit = F.col("type") == kind
    return rows.agg(
        F.count_if(hit).alias("n"),
        F.min(F.when(hit, F.col("ts_us"))).alias("start_us"),
        F.max(F.when(hit, F.col("ts_us"))).alias("end_us"),
    )


def key_events(rows: DataFrame, kind: str = "PORT_SCAN") -> DataFrame:
    """Everything else, newest first."""
    return rows.where(F.col("type") != kind).orderBy(F.col("ts_us").desc(), F.col("seq").desc())


def rank_incidents(incidents: DataFrame) -> DataFrame:
    """Severity first, then the latest activity."""
    weight = F.coalesce(severity_weight("severity"), F.lit(0))
    return incidents.withColumn("weight", weight).orderBy(
        F.col("weight").desc(), F.col("last_us").desc_nulls_last()
    )


def incident_cards(incidents: DataFrame, timeline_rows: DataFrame, reports: DataFrame | None = None):
    """Card of each incident; what a report lacks falls back to the incident itself."""
    first = timeline_rows.groupBy("incident_id", F.col("incident_source").alias("source")).agg(
        F.min_by("destination", F.struct("ts_us", "event_id")).alias("first_destination"),
        F.min("ts_us").alias("first_seen_us"),
        F.max("ts_us").alias("last_seen_us"),
    )
    cards = incidents.join(first, ["incident_id", "source"], "left")
    if reports is None:
        cards = cards.withColumn("r_summary", F.lit(None).cast("map<string,bigint>"))
        destination = F.coalesce("first_destination", F.lit("UNKNOWN"))
    else:
        cards = cards.join(
            reports.select(
                "incident_id",
                "source",
                F.col("destination").alias("r_destination"),
                F.col("behavior_summary").alias("r_summary"),
            ),
            ["incident_id", "source"],
            "left",
        )
        destination = F.coalesce("r_destination", "first_destination", F.lit("UNKNOWN"))
    n = F.coalesce("event_count", F.lit(1))
    fallback = F.create_map(F.coalesce("type", F.lit("UNKNOWN")), n)
    return cards.select(
        "incident_id",
        F.coalesce("source", F.lit("UNKNOWN")).alias("source"),
        "type",
        "severity",
        destination.alias("destination"),
        F.when(F.size("r_summary") > 0, F.col("r_summary")).otherwise(fallback).alias("pairs"),
        F.coalesce("observations", "event_count", F.lit(0)).alias("observations"),
        F.lit("Temporal correlation").alias("default_method"),
        "first_seen_us",
        "last_seen_us",
    )


def select_incident(reports: DataFrame, incidents: DataFrame, wanted: str) -> DataFrame:
    """The wanted report, else the wanted incident, else the first report, else incident."""
    cols = ["incident_id", "source", "type", "severity"]
    both = reports.select(*cols, F.lit(0).alias("origin")).union(
        incidents.select(*cols, F.lit(1).alias("origin"))
    )
    miss = (F.col("incident_id") != wanted).cast("int")
    return both.orderBy(miss, "origin", "incident_id", "source").limit(1)


def dashboard(events: DataFrame, incidents: DataFrame) -> dict[str, DataFrame]:
    """The dashboard as tables: totals, counts, incidents, timeline and graph."""
    return {
        "summary": summary(events, incidents),
        "threat_types": threat_counts(events),
        "severity": severity_counts(events),
        "incidents": incidents,
        "timeline": timeline(events).orderBy("ts_us", "event_id"),
        "nodes": graph.graph_nodes(events),
        "edges": graph.graph_edges(events),
    }
