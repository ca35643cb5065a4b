"""Packets to bidirectional flows with 22 features, and flows to events.

One code path for batch and streams: two chained window aggregations. The first groups by
(flow, window, time slice), so a flood inside one flow window is spread over many groups and
each group keeps sums and its distinct instants only. The second joins at most ``slices``
rows per flow window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions import fixed

KEYS = ["a_ip", "a_port", "b_ip", "b_port", "protocol"]


def flow_key(packets: DataFrame) -> DataFrame:
    """Add the two ends of the flow in lexicographic order, so both directions share a key."""
    src, dst = F.struct("src", "src_port"), F.struct("dst", "dst_port")
    forward = src <= dst
    return packets.withColumns(
        {
            "a_ip": F.when(forward, F.col("src")).otherwise(F.col("dst")),
            "a_port": F.when(forward, F.col("src_port")).otherwise(F.col("dst_port")),
            "b_ip": F.when(forward, F.col("dst")).otherwise(F.col("src")),
            "b_port": F.when(forward, F.col("dst_port")).otherwise(F.col("src_port")),
        }
    )


def _square_gaps(times: Column) -> Column:
    """Sum of squared differences of neighbours in a sorted array of micros, exact."""
    return F.aggregate(
        F.zip_with(
            F.slice(times, F.lit(2), F.greatest(F.size(times) - 1, F.lit(0))),
            F.slice(times, F.lit(1), F.greatest(F.size(times) - 1, F.lit(0))),
            lambda x, y: (x - y).cast("decimal(18,0)"),
        ),
        F.lit(0).cast("decimal(38,0)"),
        lambda acc, d: (acc + d * d).cast("decimal(38,0)"),
    )


def _pop_std(n: Column, total: Column, squares: Column) -> Column:
    """Population deviation from exact integer sums, without cancellation."""
    n, total = n.cast("decimal(18,0)"), total.cast("decimal(18,0)")
    spread = (n * squares).cast("decimal(38,0)") - (total * total).cast("decimal(38,0)")
    return F.sqrt(F.greatest(spread.cast("double"), F.lit(0.0))) / n.cast("double")


def flow_features(
    packets: DataFrame,
    window_seconds: int = fixed.FLOW_WINDOW_SECONDS,
    min_packets: int = 2,
    slices: int = 256,
    micros_per_unit: int = 1_000_000,
) -> DataFrame:
    """One row per flow and tumbling window: ends of the first packet and the 22 features.

    ``packets`` needs ``ts, frame_no`` and the parsed packet columns. ``micros_per_unit``
    sets the time unit of the features: seconds by default, 1 for microseconds.
    """
    width = max(1, window_seconds * 1_000_000 // slices)
    side_a = F.col("src") == F.col("a_ip")
    us = F.unix_micros("ts")

    def per_side(name, value):
        return [
            F.sum(F.when(side_a, value).otherwise(0)).alias(f"a_{name}"),
            F.sum(F.when(side_a, 0).otherwise(value)).alias(f"b_{name}"),
        ]

    size = F.col("size").cast("bigint")
    sliced = (
        flow_key(packets)
        .withColumn("us", us)
        .groupBy(
            F.window("ts", f"{window_seconds} seconds").alias("w"),
            *KEYS,
            F.expr(f"us div {width}").alias("slice"),
        )
        .agg(
            *per_side("n", F.lit(1)),
            *per_side("size", size),
            *per_side("push", F.col("push").cast("bigint")),
            *per_side("header", F.col("header_length").cast("bigint")),
            F.min(F.when(side_a, F.col("us"))).alias("a_first"),
            F.max(F.when(side_a, F.col("us"))).alias("a_last"),
            F.min(F.when(~side_a, F.col("us"))).alias("b_first"),
            F.max(F.when(~side_a, F.col("us"))).alias("b_last"),
            F.sum((size * size).cast("decimal(20,0)")).alias("squares"),
            F.sum("syn").alias("syn"),
            F.sum("ack").alias("ack"),
            F.min(F.struct("us", "frame_no", "src", "dst", "src_port", "dst_port")).alias("head"),
            F.sort_array(F.collect_set("us")).alias("times"),
        )
        .withColumn("gaps", _square_gaps(F.col("times")))
        .withColumn(
            "edge",
            F.struct(
                F.element_at("times", 1).alias("first"),
                F.element_at("times", -1).alias("last"),
            ),
        )
    )
    sums = [
        c
        for side in ("a", "b")
        for c in (f"{side}_n", f"{side}_size", f"{side}_push", f"{side}_header")
    ]
    flows = sliced.groupBy("w", *KEYS).agg(
        *[F.sum(c).alias(c) for c in [*sums, "squares", "syn", "ack", "gaps"]],
        *[F.min(c).alias(c) for c in ("a_first", "b_first", "head")],
        *[F.max(c).alias(c) for c in ("a_last", "b_last")],
        # At most ``slices`` + 1 edges; the gaps between slices come from them.
        F.sort_array(F.collect_list("edge")).alias("edges"),
    )
    between = F.aggregate(
        F.zip_with(
            F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 1, F.lit(0))),
            F.slice("edges", F.lit(1), F.greatest(F.size("edges") - 1, F.lit(0))),
            lambda nxt, prev: (nxt["first"] - prev["last"]).cast("decimal(18,0)"),
        ),
        F.lit(0).cast("decimal(38,0)"),
        lambda acc, d: (acc + d * d).cast("decimal(38,0)"),
    )
    # Orientation: forward is the direction of the first packet, compared by address only.
    forward_a = F.col("head.src") == F.col("a_ip")
    unit = float(micros_per_unit)

    def fwd(name):
        return F.when(forward_a, F.col(f"a_{name}")).otherwise(F.col(f"b_{name}"))

    def bwd(name):
        return F.when(forward_a, F.col(f"b_{name}")).otherwise(F.col(f"a_{name}"))

    shaped = flows.select(
        "w",
        "protocol",
        "head",
        "squares",
        "syn",
        "ack",
        (F.col("gaps") + between).cast("decimal(38,0)").alias("gaps"),
        *[fwd(c).alias(f"f_{c}") for c in ("n", "size", "push", "header", "first", "last")],
        *[bwd(c).alias(f"r_{c}") for c in ("n", "size", "push", "header", "first", "last")],
    ).where(F.col("f_n") + F.col("r_n") >= min_packets)
    n = F.col("f_n") + F.col("r_n")
    total = F.col("f_size") + F.col("r_size")
    span = F.greatest("f_last", "r_last") - F.least("f_first", "r_first")
    # The floor of the duration is 0.001 in the unit of the features.
    duration = F.when(span <= 0, 0.001).otherwise(span / F.lit(unit))

    def mean(value, count):
        return F.when(count > 0, value / count).otherwise(0.0)

    def gap_mean(side):
        count = F.col(f"{side}_n") - 1
        length = F.col(f"{side}_last") - F.col(f"{side}_first")
        return F.when(count > 0, length / F.lit(unit) / count).otherwise(0.0)

    values = [
        duration,
        F.col("f_n"),
        F.col("r_n"),
        F.col("f_size"),
        F.col("r_size"),
        mean(F.col("f_size"), F.col("f_n")),
        mean(F.col("r_size"), F.col("r_n")),
        total / duration,
        n / duration,
        F.when(n > 1, span / F.lit(unit) / (n - 1)).otherwise(0.0),
        F.when(n > 1, _pop_std(n - 1, span, F.col("gaps")) / F.lit(unit)).otherwise(0.0),
        gap_mean("f"),
        gap_mean("r"),
        F.col("f_push"),
        F.col("r_push"),
        F.col("f_header"),
        F.col("r_header"),
        total / n,
        _pop_std(n, total, F.col("squares")),
        F.col("syn"),
        F.col("ack"),
        mean(F.col("r_n"), F.col("f_n")),
    ]
    return shaped.select(
        "w",
        F.unix_micros("w.start").alias("window_us"),
        F.col("head.src").alias("src"),
        F.col("head.dst").alias("dst"),
        F.col("head.src_port").alias("src_port"),
        F.col("head.dst_port").alias("dst_port"),
        "protocol",
        n.alias("packet_count"),
        *[v.cast("double").alias(name) for v, name in zip(values, fixed.FLOW_FEATURES)],
    )


def flow_events(classified: DataFrame, at: Column | None = None) -> DataFrame:
    """Classified flows (``prediction, confidence``) to security events with evidence.

    The id is a digest of flow and window, so a repeated run writes the same ids. ``at`` is
    the event time, the end of the flow's window by default.
    """
    at = F.col("w.end") if at is None else at
    f = {n: F.col(f"`{n}`") for n in fixed.FLOW_FEATURES}
    identity = F.concat_ws(
        "|", "window_us", "src", "src_port", "dst", "dst_port", "protocol"
    )
    rounded = {
        "flow_duration": f["Flow Duration"],
        "packet_rate": f["Flow Packets/s"],
        "byte_rate": f["Flow Bytes/s"],
        "packet_size_mean": f["Packet Length Mean"],
        "packet_size_std": f["Packet Length Std"],
    }
    evidence = F.struct(
        F.col("packet_count"),
        (f["Total Length of Fwd Packets"] + f["Total Length of Bwd Packets"])
        .cast("bigint")
        .alias("total_bytes"),
        *[F.round(c, 4).alias(name) for name, c in rounded.items()],
        f["SYN Flag Count"].cast("bigint").alias("syn_count"),
        f["ACK Flag Count"].cast("bigint").alias("ack_count"),
    )
    return classified.select(
        F.concat(F.lit("EVT-"), F.substring(F.sha2(identity, 256), 1, 16)).alias("event_id"),
        F.unix_micros(at).alias("ts_us"),
        "src",
        "dst",
        "src_port",
        "dst_port",
        "protocol",
        F.col("prediction").alias("type"),
        F.round("confidence", 4).alias("confidence"),
        F.when(F.col("confidence") >= fixed.HIGH_CONFIDENCE, "HIGH")
        .otherwise("MEDIUM")
        .alias("severity"),
        evidence.alias("evidence"),
    )
