"""Correlation rules: reconnaissance, multi-stage, unknown patterns; incidents and members.

An incident is a row; its events are rows of a bridge table keyed by incident, never an
array, since one incident may hold a large share of all events.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions import fixed
from sentrel.functions.scalars import host_id
from sentrel.functions.staging import materialise
from sentrel.operators.windows import Criterion, first_window_events

INCIDENT_COLUMNS = [
    "incident_id",
    "type",
    "source",
    "severity",
    "event_count",
    "unique_ports",
    "unique_destinations",
    "behaviors",
    "pattern_id",
    "observations",
    "status",
    "detection_method",
    "evidence",
    "first_us",
    "last_us",
    "rule",
    "emit_seq",
]


def suspicious(events: DataFrame) -> DataFrame:
    """Neither benign nor unknown behaviour, known source; a missing type is kept."""
    kept = ~F.coalesce(F.col("type").isin("BENIGN", "UNKNOWN_BEHAVIOR"), F.lit(False))
    return events.where(kept & F.col("src").isNotNull() & (F.col("src") != "UNKNOWN"))


def suspicious_or_unknown(events: DataFrame) -> DataFrame:
    """Anything but benign from a non-empty source."""
    return events.where(~F.col("type").eqNullSafe("BENIGN") & (F.col("src") != ""))


def port_number(c: Column | str = "dst_port") -> Column:
    """Destination port as a number, null when it is none."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("bigint")


def evidence_port(events: DataFrame) -> Column:
    """Port text, from the evidence first, else from the event itself."""
    fields = {f.name: f.dataType for f in events.schema.fields}
    evidence = fields.get("evidence")
    if evidence is not None and "dst_port" in getattr(evidence, "names", []):
        return F.coalesce(
            F.col("evidence.dst_port").cast("string"), F.col("dst_port").cast("string")
        )
    return F.col("dst_port").cast("string")


def _recon(rows, window_seconds, min_ports, min_destinations):
    """Member rows of the first qualifying window of each source.

    Three events are asked for too; that many are implied as every event carries one
    port and one destination.
    """
    rules = [Criterion("port", min_ports), Criterion("destination", min_destinations)]
    return first_window_events(rows, ["src"], "ts_us", window_seconds * 1_000_000, rules)


def recon_members(
    events: DataFrame,
    window_seconds: int = fixed.CORRELATION_WINDOW_SECONDS,
    min_ports: int = fixed.MIN_PORTS,
    min_destinations: int = fixed.MIN_DESTINATIONS,
) -> DataFrame:
    """Events of each source's first reconnaissance window, with ``incident_id``."""
    rows = suspicious(events).select(
        "src",
        "ts_us",
        "seq",
        "event_id",
        "type",
        port_number().alias("port"),
        F.when(~F.col("dst").isin("", "UNKNOWN"), F.col("dst")).alias("destination"),
    )
    members = _recon(rows, window_seconds, min_ports, min_destinations)
    return members.withColumn("incident_id", host_id("INC-RECON-", "src"))


def recon_incidents(events: DataFrame, **params) -> DataFrame:
    """One HIGH incident per source: at least 5 ports or 3 destinations within 60 s."""
    return summarise_recon(recon_members(events, **params))


def summarise_recon(members: DataFrame) -> DataFrame:
    return (
        members.groupBy("incident_id", F.col("src").alias("source"))
        .agg(
            F.count("*").alias("event_count"),
            F.countDistinct("port").alias("unique_ports"),
            F.countDistinct("destination").alias("unique_destinations"),
            F.min("ts_us").alias("first_us"),
            F.max("ts_us").alias("last_us"),
            F.min("seq").alias("emit_seq"),
        )
        .withColumn("type", F.lit("RECONNAISSANCE"))
        .withColumn("severity", F.lit("HIGH"))
        .withColumn("detection_method", F.lit(fixed.RECON_METHOD))
    )


def recon_entities(members: DataFrame) -> DataFrame:
    """The distinct ports and destinations of each reconnaissance incident, one per row."""
    both = F.array(
        F.struct(F.lit("port").alias("kind"), F.col("port").cast("string").alias("entity")),
        F.struct(F.lit("destination").alias("kind"), F.col("destination").alias("entity")),
    )
    return (
        members.select("incident_id", F.explode(both).alias("e"))
        .select("incident_id", "e.kind", "e.entity")
        .where(F.col("entity").isNotNull())
        .distinct()
    )


def recon_members_replay(
    events: DataFrame,
    window_seconds: int = fixed.CORRELATION_WINDOW_SECONDS,
    min_ports: int = fixed.MIN_PORTS,
    min_destinations: int = fixed.MIN_DESTINATIONS,
) -> DataFrame:
    """Replay variant: unknown behaviour counts too, ports are text, evidence port first."""
    port = evidence_port(events)
    rows = suspicious_or_unknown(events).select(
        "src",
        "ts_us",
        "seq",
        "event_id",
        "type",
        port.alias("port"),
        F.when(F.col("dst") != "", F.col("dst")).alias("destination"),
    )
    members = _recon(rows, window_seconds, min_ports, min_destinations)
    return members.withColumn("incident_id", host_id("INC-", "src"))


def recon_incidents_replay(events: DataFrame, **params) -> DataFrame:
    found = summarise_recon(recon_members_replay(events, **params))
    return found.withColumn("detection_method", F.lit(fixed.RECON_REASON))


def chain_window(
    events: DataFrame,
    window_seconds: int = fixed.CORRELATION_WINDOW_SECONDS,
    min_behaviours: int = fixed.MIN_BEHAVIOURS,
    min_repeats: int = fixed.MIN_REPEATS,
) -> DataFrame:
    """Events of each source's first window with two behaviours seen twice each or more."""
    rows = suspicious_or_unknown(events).select("src", "ts_us", "seq", "event_id", "type")
    width = window_seconds * 1_000_000
    rule = Criterion("type", min_behaviours, min_repeats, small_domain=True)
    members = first_window_events(rows, ["src"], "ts_us", width, [rule])
    return members.withColumn("incident_id", host_id("INC-", "src", "-CHAIN"))


def chain_behaviours(
    window_events: DataFrame, min_repeats: int = fixed.MIN_REPEATS
) -> DataFrame:
    """Behaviour counts of each window, with first appearance and the repeated flag."""
    return (
        window_events.groupBy("incident_id", "src", "type")
        .agg(
            F.count("*").alias("n"),
            F.min(F.struct("ts_us", "seq")).alias("first"),
            F.max("ts_us").alias("last_us"),
        )
        .withColumn("repeated", F.col("type").isNotNull() & (F.col("n") >= min_repeats))
    )


def chain_incidents(
    events: DataFrame, min_repeats: int = fixed.MIN_REPEATS, **params
) -> DataFrame:
    """One CRITICAL incident per source, behaviours in order of first appearance."""
    per_type = chain_behaviours(chain_window(events, min_repeats=min_repeats, **params), min_repeats)
    # Arrays below hold one element per behaviour class.
    chain = F.transform(
        F.sort_array(
            F.collect_list(F.when(F.col("repeated"), F.struct("first.ts_us", "first.seq", "type")))
        ),
        lambda s: s["type"],
    )
    counts = F.collect_list(F.when(F.col("type").isNotNull(), F.struct("type", "n")))
    return per_type.groupBy("incident_id", F.col("src").alias("source")).agg(
        F.lit("MULTI_STAGE_ACTIVITY").alias("type"),
        F.lit("CRITICAL").alias("severity"),
        F.sum(F.when(F.col("repeated"), F.col("n"))).alias("event_count"),
        chain.alias("attack_chain"),
        F.map_from_entries(F.sort_array(counts)).alias("behavior_counts"),
        F.min("first.ts_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.min("first.seq").alias("emit_seq"),
    )


def chain_members(events: DataFrame, min_repeats: int = fixed.MIN_REPEATS, **params) -> DataFrame:
    """Window events limited to the repeated behaviours."""
    inside = chain_window(events, min_repeats=min_repeats, **params)
    repeated = chain_behaviours(inside, min_repeats).where("repeated").select("incident_id", "type")
    return inside.join(materialise(repeated), ["incident_id", "type"], "left_semi")


def repeated_behaviours(events: DataFrame, min_repeats: int = fixed.MIN_REPEATS) -> DataFrame:
    """Suspicious behaviours seen at least twice by a source over all time."""
    return (
        suspicious(events)
        .withColumn("type", F.coalesce("type", F.lit("UNKNOWN")))
        .groupBy("src", "type")
        .agg(
            F.count("*").alias("n"),
            F.min("ts_us").alias("first_us"),
            F.max("ts_us").alias("last_us"),
            F.min("seq").alias("first_seq"),
        )
        .where(F.col("n") >= min_repeats)
    )


def history_incidents(
    events: DataFrame,
    min_behaviours: int = fixed.MIN_BEHAVIOURS,
    min_repeats: int = fixed.MIN_REPEATS,
) -> DataFrame:
    """Whole-history multi-stage rule, without a time bound; severity HIGH."""
    return (
        repeated_behaviours(events, min_repeats)
        .groupBy(F.col("src").alias("source"))
        .agg(
            F.sum("n").alias("event_count"),
            F.sort_array(F.collect_set("type")).alias("behaviors"),
            F.min("first_us").alias("first_us"),
            F.max("last_us").alias("last_us"),
            F.min("first_seq").alias("emit_seq"),
        )
        .where(F.size("behaviors") >= min_behaviours)
        .withColumn("incident_id", host_id("INC-MULTI-", "source"))
        .withColumn("type", F.lit("MULTI_STAGE_ACTIVITY"))
        .withColumn("severity", F.lit("HIGH"))
        .withColumn("detection_method", F.lit(fixed.MULTI_METHOD))
    )


def history_members(
    events: DataFrame,
    min_behaviours: int = fixed.MIN_BEHAVIOURS,
    min_repeats: int = fixed.MIN_REPEATS,
) -> DataFrame:
    found = materialise(history_incidents(events, min_behaviours, min_repeats))
    return members_of_history(events, found)


def members_of_history(events: DataFrame, found: DataFrame) -> DataFrame:
    """Events behind given whole-history incidents."""
    pairs = found.select(
        "incident_id", F.col("source").alias("src"), F.explode("behaviors").alias("kind")
    )
    rows = suspicious(events).withColumn("kind", F.coalesce("type", F.lit("UNKNOWN")))
    return rows.join(pairs, ["src", "kind"]).select(
        "incident_id", "src", "ts_us", "seq", "event_id", "type"
    )


def _evidence(events: DataFrame) -> tuple[Column, Column]:
    """Evidence of an event as JSON text, and the detection method it names; null without them."""
    fields = {f.name: f.dataType for f in events.schema.fields}
    kept = fields.get("evidence")
    named = "detection_method" in getattr(kept, "names", [])
    method = F.col("evidence.detection_method") if named else F.lit(None).cast("string")
    if kept is None:
        return F.lit(None).cast("string"), method
    return (F.to_json("evidence") if hasattr(kept, "names") else F.col("evidence").cast("string")), method


def unknown_incidents(events: DataFrame) -> DataFrame:
    """Each unknown-behaviour event is an incident of its pattern."""
    evidence, method = _evidence(events)
    return events.where(F.col("type") == "UNKNOWN_BEHAVIOR").select(
        F.concat(F.lit("INC-UNKNOWN-"), F.coalesce("pattern_id", F.lit("UNKNOWN"))).alias(
            "incident_id"
        ),
        "type",
        F.coalesce("src", F.lit("UNKNOWN")).alias("source"),
        F.coalesce("severity", F.lit("MEDIUM")).alias("severity"),
        F.lit(1).cast("bigint").alias("event_count"),
        F.coalesce("pattern_id", F.lit("UNKNOWN")).alias("pattern_id"),
        F.coalesce("observations", F.lit(0)).cast("bigint").alias("observations"),
        F.coalesce("pattern_status", F.lit("NEW")).alias("status"),
        method.alias("detection_method"),
        evidence.alias("evidence"),
        F.col("ts_us").alias("first_us"),
        F.col("ts_us").alias("last_us"),
        F.col("seq").alias("emit_seq"),
        "event_id",
    )


def combine(*parts: DataFrame) -> DataFrame:
    """Incidents of all rules, in rule order."""
    tagged = [p.withColumn("rule", F.lit(n)) for n, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def deduplicate(incidents: DataFrame) -> DataFrame:
    """One incident per (type, source, pattern); the last wins, the first place is kept."""
    keys = ["type", "source", "pattern_id"]
    order = F.struct("rule", "emit_seq")
    rest = [c for c in incidents.columns if c not in keys]
    return (
        incidents.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), order).alias("w"), F.min(order).alias("position"))
        .select(*keys, "w.*", "position")
    )


def correlate(
    events: DataFrame, window_seconds: int = fixed.CORRELATION_WINDOW_SECONDS
) -> tuple[DataFrame, DataFrame]:
    """Deduplicated incidents of the three rules, and the bridge table of their events."""
    recon = materialise(recon_members(events, window_seconds=window_seconds))
    history = materialise(history_incidents(events))
    unknown = unknown_incidents(events)
    found = combine(summarise_recon(recon), unknown, history)
    # Of a pattern's events from one source, deduplication keeps the last.
    last = deduplicate(combine(unknown))
    cols = ["incident_id", F.col("src").alias("source"), "seq"]
    members = (
        recon.select(*cols)
        .union(last.select("incident_id", "source", F.col("emit_seq").alias("seq")))
        .union(members_of_history(events, history).select(*cols))
    )
    return deduplicate(found).select(*INCIDENT_COLUMNS), members
