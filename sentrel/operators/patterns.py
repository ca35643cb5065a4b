"""Unknown behaviour: candidates, clusters, pattern store, events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions import fixed
from sentrel.functions.staging import materialise
from sentrel.operators.clusters import components, dbscan, fit_scaler, scale
from sentrel.operators.nearest import nearest_within, scaled_signature, within

# Signature field -> flow feature, taken from the first member of a cluster.
SIGNATURE = {
    "flow_duration": "Flow Duration",
    "packet_rate": "Flow Packets/s",
    "byte_rate": "Flow Bytes/s",
    "packet_size_mean": "Packet Length Mean",
    "packet_size_std": "Packet Length Std",
    "syn_count": "SYN Flag Count",
    "ack_count": "ACK Flag Count",
}
# Signature field -> flow feature, averaged over a cluster.
MEAN_SIGNATURE = {
    "avg_flow_duration": "Flow Duration",
    "avg_forward_packets": "Total Fwd Packets",
    "avg_backward_packets": "Total Backward Packets",
    "avg_forward_bytes": "Total Length of Fwd Packets",
    "avg_backward_bytes": "Total Length of Bwd Packets",
    "avg_packet_rate": "Flow Packets/s",
    "avg_byte_rate": "Flow Bytes/s",
    "avg_packet_size": "Packet Length Mean",
    "avg_packet_size_std": "Packet Length Std",
    "avg_flow_iat": "Flow IAT Mean",
}
STORE_SCHEMA = (
    "pattern_id string, cluster_size bigint, status string, first_detected timestamp, "
    "source string, behavioral_signature map<string,double>, store_order bigint"
)


def unknown_candidates(
    scored: DataFrame, threshold: float = fixed.KNOWN_THREAT_CONFIDENCE
) -> DataFrame:
    """Anomalous rows that are no confidently known threat."""
    known = (F.col("prediction") != "BENIGN") & (F.col("confidence") >= threshold)
    return scored.where(~known & (F.col("anomaly") == -1))


def cluster_candidates(
    candidates: DataFrame,
    row_id: str,
    features: Sequence[str],
    eps: float = fixed.DBSCAN_EPS,
    min_samples: int = fixed.DBSCAN_MIN_SAMPLES,
) -> DataFrame:
    """Scale the candidates by their own mean and deviation, then cluster them."""
    scaler = fit_scaler(candidates, features)
    return dbscan(scale(candidates, scaler), row_id, features, eps, min_samples)


def _members(candidates: DataFrame, labels: DataFrame, row_id: str) -> DataFrame:
    return candidates.join(labels.where(F.col("cluster") != -1), row_id)


def _map(fields: dict[str, str], value) -> Column:
    return F.create_map(*[c for name, f in fields.items() for c in (F.lit(name), value(f))])


def cluster_signatures(
    candidates: DataFrame,
    labels: DataFrame,
    row_id: str,
    signature: dict[str, str] | None = None,
    min_samples: int = fixed.DBSCAN_MIN_SAMPLES,
) -> DataFrame:
    """Size and first member's features of every cluster."""
    signature = signature or SIGNATURE
    fields = sorted(set(signature.values()))
    # Min over a struct led by the row id: the first member, combined on the map side.
    names = {f: f"v{i}" for i, f in enumerate(fields)}
    head = F.struct(row_id, *[F.col(f"`{f}`").cast("double").alias(n) for f, n in names.items()])
    found = (
        _members(candidates, labels, row_id)
        .groupBy("cluster")
        .agg(F.count("*").alias("cluster_size"), F.min(head).alias("h"))
        .where(F.col("cluster_size") >= min_samples)
    )
    values = _map(signature, lambda f: F.col(f"h.{names[f]}"))
    return found.select("cluster", "cluster_size", values.alias("behavioral_signature"))


def cluster_means(
    candidates: DataFrame,
    labels: DataFrame,
    row_id: str,
    signature: dict[str, str] | None = None,
    min_samples: int = fixed.DBSCAN_MIN_SAMPLES,
) -> DataFrame:
    """Size and mean features of every cluster."""
    signature = signature or MEAN_SIGNATURE
    fields = sorted(set(signature.values()))
    names = {f: f"v{i}" for i, f in enumerate(fields)}
    found = (
        _members(candidates, labels, row_id)
        .groupBy("cluster")
        .agg(
            F.count("*").alias("cluster_size"),
            *[F.avg(F.col(f"`{f}`").cast("double")).alias(n) for f, n in names.items()],
        )
        .where(F.col("cluster_size") >= min_samples)
    )
    return found.select(
        "cluster",
        "cluster_size",
        F.lit("UNKNOWN_BEHAVIOR").alias("classification"),
        F.col("cluster_size").alias("observations"),
        _map(signature, lambda f: F.col(names[f])).alias("behavioral_signature"),
    )


def match_patterns(signatures: DataFrame, store: DataFrame) -> DataFrame:
    """First stored pattern of the same cluster size, as ``matched_id``; null if none.

    Only the store is looked at; ``extend_store`` lets several new clusters of one size make one
    pattern.
    """
    first = store.groupBy("cluster_size").agg(
        F.min_by("pattern_id", "store_order").alias("matched_id")
    )
    return signatures.join(first, "cluster_size", "left")


def match_by_distance(
    signatures: DataFrame,
    store: DataFrame,
    scales: dict[str, tuple[float, float]],
    threshold: float,
    version: str = "signature-1",
) -> DataFrame:
    """Signatures with the stored pattern they are nearest to, if one lies within ``threshold``.

    In place of ``match_patterns``, which calls clusters of equal size the same. Adds ``matched_id``,
    ``match_distance``, ``n_within`` and ``signature_version``. Distances are Euclidean over the
    features of ``scales`` (name: centre, spread), which go with the version. A signature that lacks a
    feature matches nothing. Ties go to the smaller pattern id.
    """
    v = scaled_signature("behavioral_signature", scales).alias("v")
    found = nearest_within(
        signatures.select(F.col("cluster").alias("id"), v), store.select(F.col("pattern_id").alias("id"), v), threshold
    ).select(F.col("query_id").alias("cluster"), "matched_id", F.col("distance").alias("match_distance"), "n_within")
    return signatures.join(found, "cluster", "left").select(
        "*", F.lit(version).alias("signature_version")
    ).fillna(0, "n_within")


def extend_store_by_distance(
    signatures: DataFrame,
    store: DataFrame,
    scales: dict[str, tuple[float, float]],
    threshold: float,
    detected_at: Column | None = None,
    version: str = "signature-1",
) -> DataFrame:
    """Store, with all its columns, plus one pattern for each group of signatures that match none.

    New signatures within ``threshold`` of one another, directly or through others, are one pattern;
    the smallest cluster number gives its signature and size. A signature that lacks a feature makes
    a pattern of its own.
    """
    when = F.current_timestamp() if detected_at is None else detected_at
    fresh = materialise(
        match_by_distance(signatures, store, scales, threshold, version).where(F.col("matched_id").isNull())
    )
    rows = fresh.select(F.col("cluster").alias("id"), scaled_signature("behavioral_signature", scales).alias("v"))
    links = within(rows, rows.toDF("id", "v"), threshold).where(F.col("query_id") < F.col("stored_id"))
    later = components(links.select(F.col("query_id").alias("a"), F.col("stored_id").alias("b"))).select(
        F.col("id").alias("cluster")
    )
    last = store.agg(F.coalesce(F.max("store_order"), F.lit(-1))).scalar()
    new = fresh.join(later, "cluster", "left_anti").select(
        signature_id(F.col("behavioral_signature"), F.col("cluster_size")).alias("pattern_id"),
        "cluster_size",
        F.lit("NEW").alias("status"),
        when.alias("first_detected"),
        F.lit(fixed.PATTERN_METHOD).alias("source"),
        "behavioral_signature",
        (last + 1 + F.col("cluster")).cast("bigint").alias("store_order"),
        F.lit(version).alias("signature_version"),
    )
    return store.unionByName(new, allowMissingColumns=True)


def signature_id(signature: Column, cluster_size: Column) -> Column:
    """Pattern id from the content of its signature and the size of its cluster (64 bits)."""
    text = F.to_json(F.map_from_entries(F.sort_array(F.map_entries(signature))))
    whole = F.concat_ws("|", cluster_size.cast("string"), text)
    return F.concat(F.lit("P-"), F.upper(F.substring(F.sha2(whole, 256), 1, 16)))


def extend_store(
    signatures: DataFrame, store: DataFrame, detected_at: Column | None = None
) -> DataFrame:
    """Store, with all its columns, plus the new patterns.

    Of several new clusters of one size only the first makes a pattern, because the later ones
    match it.
    """
    when = F.current_timestamp() if detected_at is None else detected_at
    # A two-level rank is not needed: per size, only the first new cluster is kept.
    fresh = (
        match_patterns(signatures, store)
        .where(F.col("matched_id").isNull())
        .groupBy("cluster_size")
        .agg(F.min(F.struct("cluster")).alias("c"), F.min_by("behavioral_signature", "cluster").alias("s"))
    )
    last = store.agg(F.coalesce(F.max("store_order"), F.lit(-1))).scalar()
    new = fresh.select(
        signature_id(F.col("s"), F.col("cluster_size")).alias("pattern_id"),
        "cluster_size",
        F.lit("NEW").alias("status"),
        when.alias("first_detected"),
        F.lit(fixed.PATTERN_METHOD).alias("source"),
        F.col("s").alias("behavioral_signature"),
        (last + 1 + F.col("c.cluster")).cast("bigint").alias("store_order"),
    )
    return store.unionByName(new, allowMissingColumns=True)


def pattern_events(store: DataFrame, at: Column | None = None) -> DataFrame:
    """New patterns as unknown-behaviour events."""
    at = F.current_timestamp() if at is None else at
    seen = F.col("observations") if "observations" in store.columns else F.lit(None)
    observed = F.coalesce(seen, F.col("cluster_size"), F.lit(0)).cast("bigint")
    pattern = F.coalesce("pattern_id", F.lit("UNKNOWN"))
    return store.where(F.col("status") == "NEW").select(
        F.concat(F.lit("EVT-UNKNOWN-"), F.replace(pattern, F.lit("P-"), F.lit(""))).alias("event_id"),
        at.alias("ts"),
        F.lit("UNKNOWN").alias("src"),
        F.lit("UNKNOWN").alias("dst"),
        F.lit(0).alias("src_port"),
        F.lit(0).alias("dst_port"),
        F.lit("UNKNOWN").alias("protocol"),
        F.lit("UNKNOWN_BEHAVIOR").alias("type"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit("MEDIUM").alias("severity"),
        pattern.alias("pattern_id"),
        F.struct(
            F.lit("UNKNOWN_BEHAVIOR").alias("classification"),
            F.col("status").alias("pattern_status"),
            observed.alias("observation_count"),
            F.lit(fixed.PATTERN_METHOD).alias("detection_method"),
            "behavioral_signature",
        ).alias("evidence"),
    )
