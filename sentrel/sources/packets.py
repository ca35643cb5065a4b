"""Packet text to typed rows; lines that do not parse go to a quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions import fixed
from sentrel.functions.scalars import evaluated_once


def _flag(c: Column, strict: bool) -> Column:
    return F.lower(c).isin(*(["true"] if strict else ["true", "1"])).cast("int")


def parse_packets(lines: DataFrame, strict_flags: bool = False) -> DataFrame:
    """14 pipe-separated fields per line (column ``value``) to packets.

    Adds ``valid``; split with :func:`accepted` and :func:`quarantined`. Other input columns
    pass through. Works on streams.
    """
    raw = lines.withColumn("__f", F.split(F.btrim("value", F.lit(" \t\r\n")), r"\|", -1))
    f = {n: F.get("__f", F.lit(i)) for i, n in enumerate(fixed.PACKET_FIELDS_14)}
    tcp, udp = f["ip.proto"] == "6", f["ip.proto"] == "17"
    seconds = f["frame.time_epoch"].try_cast("double")
    size = f["frame.len"].try_cast("bigint")
    us = F.round(seconds * 1_000_000).try_cast("bigint")
    valid = (
        (F.size("__f") == len(fixed.PACKET_FIELDS_14))
        & us.isNotNull()
        & size.isNotNull()
        & (f["ip.src"] != "")
        & (f["ip.dst"] != "")
        & (tcp | udp)
    )
    ip_header = F.coalesce(f["ip.hdr_len"].try_cast("int"), F.lit(20))
    tcp_header = F.coalesce(f["tcp.hdr_len"].try_cast("int"), F.lit(0))
    parsed = {
        "valid": F.coalesce(valid, F.lit(False)),
        "ts_us": us,
        "src": f["ip.src"],
        "dst": f["ip.dst"],
        "src_port": F.when(tcp, f["tcp.srcport"]).otherwise(f["udp.srcport"]),
        "dst_port": F.when(tcp, f["tcp.dstport"]).otherwise(f["udp.dstport"]),
        "protocol": F.when(tcp, "TCP").when(udp, "UDP"),
        "size": size,
        "syn": F.coalesce(_flag(f["tcp.flags.syn"], strict_flags), F.lit(0)),
        "ack": F.coalesce(_flag(f["tcp.flags.ack"], strict_flags), F.lit(0)),
        "push": F.coalesce(_flag(f["tcp.flags.push"], strict_flags), F.lit(0)),
        "header_length": ip_header + tcp_header,
    }
    return evaluated_once(raw, lines.columns, parsed).withColumn("ts", F.timestamp_micros("ts_us"))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where("valid").drop("valid", "value")


def quarantined(parsed: DataFrame, columns: list[str]) -> DataFrame:
    """Lines that are no packets, as they came."""
    return parsed.where(~F.col("valid")).select(*columns)


def parse_packet_fields(lines: DataFrame) -> DataFrame:
    """Nine-field variant: no arity check, missing fields are null; blank lines are dropped."""
    raw = lines.withColumn("__t", F.btrim("value", F.lit(" \t\r\n"))).where(F.col("__t") != "")
    parts = F.split("__t", r"\|", -1)
    return raw.select(
        *[c for c in lines.columns if c != "value"],
        *[
            F.get(parts, F.lit(i)).alias(n.replace(".", "_"))
            for i, n in enumerate(fixed.PACKET_FIELDS_9)
        ],
    )


def parse_packet_summaries(lines: DataFrame) -> DataFrame:
    """Eight tab-separated fields; the wrong number of fields drops the line."""
    raw = lines.withColumn("__f", F.split(F.translate("value", "\r\n", ""), "\t", -1))
    raw = raw.where(F.size("__f") == len(fixed.PACKET_FIELDS_8))
    f = {n: F.get("__f", F.lit(i)) for i, n in enumerate(fixed.PACKET_FIELDS_8)}

    def address(side):
        return F.coalesce(
            F.nullif(f[f"ip.{side}"], F.lit("")), F.nullif(f[f"ipv6.{side}"], F.lit("")), F.lit("?")
        )

    return raw.select(
        *[c for c in lines.columns if c != "value"],
        f["frame.time_epoch"].alias("stamp"),
        address("src").alias("src"),
        address("dst").alias("dst"),
        f["tcp.srcport"].alias("src_port"),
        f["tcp.dstport"].alias("dst_port"),
        f["frame.len"].alias("size"),
    )


def capture_status(summaries: DataFrame) -> DataFrame:
    """Packets observed and the time of the last one."""
    return summaries.agg(
        F.count("*").alias("packets_observed"),
        F.max_by("stamp", F.col("stamp").try_cast("double")).alias("last_packet_at"),
    )


def packet_rate(packets: DataFrame, seconds: int) -> DataFrame:
    """Packets per second in tumbling windows; works on streams with a watermark."""
    return packets.groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(
        F.count("*").alias("packets")
    ).select(
        F.unix_micros("w.start").alias("start_us"),
        "packets",
        (F.col("packets") / F.lit(float(seconds))).alias("rate"),
    )
