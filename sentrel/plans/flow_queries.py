"""Packet and flow queries."""

from pyspark.sql import functions as F

from sentrel.functions.fixed import FLOW_FEATURES
from sentrel.operators import flows
from sentrel.plans.adapters import FLOW_WINDOW_SECONDS, packet_lines, packets
from sentrel.plans.registry import query
from sentrel.sources import packets as source

LINES = """ln AS (SELECT e.event_id AS frame_no, e.event_id % 3 <> 0 AS tcp,
    epoch_us(e.ts) AS us, 60 + CAST(floor(e.value) AS BIGINT) AS size FROM events e),
good AS (SELECT frame_no, us AS ts_us, '10.0.0.' || (frame_no % 50) AS src,
    '10.1.0.' || (frame_no % 7) AS dst, CAST(40000 + frame_no % 100 AS VARCHAR) AS src_port,
    CAST(frame_no % 1024 AS VARCHAR) AS dst_port,
    CASE WHEN tcp THEN 'TCP' ELSE 'UDP' END AS protocol, size,
    CASE WHEN tcp AND frame_no % 10 = 0 THEN 1 ELSE 0 END AS syn,
    CASE WHEN tcp AND frame_no % 2 = 0 THEN 1 ELSE 0 END AS ack,
    CASE WHEN tcp AND frame_no % 4 = 0 THEN 1 ELSE 0 END AS push,
    20 + CASE WHEN NOT tcp OR frame_no % 17 = 0 THEN 0 ELSE 32 END AS header_length
  FROM ln WHERE frame_no % 37 <> 0 AND frame_no % 29 <> 0 AND frame_no % 31 <> 0
    AND frame_no % 23 <> 0)"""


@query("packet_parse", f"WITH {LINES} SELECT * FROM good")
def packet_parse(spark, sf_dir):
    return source.accepted(source.parse_packets(packet_lines(spark, sf_dir))).drop("ts")


@query(
    "packet_quarantine",
    f"""WITH {LINES} SELECT frame_no FROM ln
    WHERE frame_no NOT IN (SELECT frame_no FROM good)""",
)
def packet_quarantine(spark, sf_dir):
    parsed = source.parse_packets(packet_lines(spark, sf_dir))
    return source.quarantined(parsed, ["frame_no"])


@query(
    "packet_rate",
    f"""WITH {LINES} SELECT ts_us // 3600000000 * 3600000000 AS start_us, count(*) AS packets,
      round(count(*) / 3600.0::DOUBLE, 9) AS rate FROM good GROUP BY 1""",
)
def packet_rate(spark, sf_dir):
    good = source.accepted(source.parse_packets(packet_lines(spark, sf_dir)))
    return source.packet_rate(good, 3600).withColumn("rate", F.round("rate", 9))


@query(
    "packet_fields",
    """SELECT event_id AS frame_no, CASE WHEN event_id % 31 = 0 THEN ''
        ELSE '10.0.0.' || (event_id % 50) END AS ip_src,
      '10.1.0.' || (event_id % 7) AS ip_dst,
      CAST(60 + CAST(floor(value) AS BIGINT) AS VARCHAR) AS frame_len FROM events""",
)
def packet_fields(spark, sf_dir):
    fields = source.parse_packet_fields(packet_lines(spark, sf_dir))
    return fields.select("frame_no", "ip_src", "ip_dst", "frame_len")


def _summary_lines(spark, sf_dir):
    p = packets(spark, sf_dir)
    v6 = F.col("frame_no") % 3 == 0
    empty = F.lit("")
    line = F.concat_ws(
        "\t",
        F.col("ts_us").cast("string"),
        F.when(v6, empty).otherwise(F.col("src")),
        F.when(v6 & (F.col("frame_no") % 2 == 0), "fe80::1").otherwise(empty),
        F.col("dst"),
        empty,
        "src_port",
        "dst_port",
        F.col("size").cast("string"),
    )
    broken = F.when(F.col("frame_no") % 41 == 0, "x").otherwise(line)
    return p.select("frame_no", broken.alias("value"))


@query(
    "packet_summaries",
    """SELECT event_id AS frame_no, CASE WHEN event_id % 6 = 0 THEN 'fe80::1'
        WHEN event_id % 3 = 0 THEN '?' ELSE '10.0.0.' || (user_id % 5) END AS src,
      CAST(epoch_us(ts) AS VARCHAR) AS stamp,
      CAST(60 + CAST(floor(value) AS BIGINT) AS VARCHAR) AS size
    FROM events WHERE event_id % 41 <> 0""",
)
def packet_summaries(spark, sf_dir):
    rows = source.parse_packet_summaries(_summary_lines(spark, sf_dir))
    return rows.select("frame_no", "src", "stamp", "size")


@query(
    "capture_status",
    """SELECT count(*) AS packets_observed, CAST(max(epoch_us(ts)) AS VARCHAR) AS last_packet_at
    FROM events WHERE event_id % 41 <> 0""",
)
def capture_status(spark, sf_dir):
    return source.capture_status(source.parse_packet_summaries(_summary_lines(spark, sf_dir)))


FLOWS = """pk AS (SELECT e.event_id AS frame_no, epoch_us(e.ts) AS us,
    epoch_us(e.ts) // 86400000000 * 86400000000 AS window_us,
    '10.0.0.' || (e.user_id % 5) AS src,
    '10.0.0.' || ((e.user_id % 5 + 1 + e.event_id % 4) % 5) AS dst,
    CAST(40000 + e.user_id % 5 AS VARCHAR) AS src_port,
    CAST(40000 + (e.user_id % 5 + 1 + e.event_id % 4) % 5 AS VARCHAR) AS dst_port,
    60 + CAST(floor(e.value) AS BIGINT) AS size, CASE WHEN e.event_id % 10 = 0 THEN 1 ELSE 0 END
    AS syn, CASE WHEN e.event_id % 4 = 0 THEN 1 ELSE 0 END AS push FROM events e),
kd AS (SELECT *, least(src, dst) AS a, greatest(src, dst) AS b FROM pk),
o AS (SELECT *, first_value(src) OVER w AS fs, first_value(dst) OVER w AS fd,
    first_value(src_port) OVER w AS fsp, first_value(dst_port) OVER w AS fdp,
    us - lag(us) OVER w AS gap FROM kd
  WINDOW w AS (PARTITION BY window_us, a, b ORDER BY us, frame_no)),
g AS (SELECT window_us, fs AS src, fd AS dst, fsp AS src_port, fdp AS dst_port, 'TCP' AS protocol,
    count(*) AS n, greatest((max(us) - min(us)) / 1e6, 0.001) AS dur,
    count(*) FILTER (src = fs) AS fn, count(*) FILTER (src <> fs) AS bn,
    coalesce(sum(size) FILTER (src = fs), 0) AS fl, coalesce(sum(size) FILTER (src <> fs), 0) AS bl,
    coalesce((max(us) FILTER (src = fs) - min(us) FILTER (src = fs)) / 1e6
      / nullif(count(*) FILTER (src = fs) - 1, 0), 0) AS fi,
    coalesce((max(us) FILTER (src <> fs) - min(us) FILTER (src <> fs)) / 1e6
      / nullif(count(*) FILTER (src <> fs) - 1, 0), 0) AS bi,
    coalesce(avg(gap) / 1e6, 0) AS im, coalesce(stddev_pop(gap) / 1e6, 0) AS istd,
    coalesce(sum(push) FILTER (src = fs), 0) AS fp, coalesce(sum(push) FILTER (src <> fs), 0) AS bp,
    avg(size) AS pm, stddev_pop(size) AS ps, sum(syn) AS syn
  FROM o GROUP BY window_us, a, b, fs, fd, fsp, fdp HAVING count(*) >= 2)"""
FEATURE_SQL = [
    "dur", "fn", "bn", "fl", "bl", "coalesce(fl / nullif(fn, 0), 0)",
    "coalesce(bl / nullif(bn, 0), 0)", "(fl + bl) / dur", "n / dur", "im", "istd", "fi", "bi",
    "fp", "bp", "40 * fn", "40 * bn", "pm", "ps", "syn", "n", "coalesce(bn / nullif(fn, 0), 0)",
]


def _short(name):
    return name.lower().replace("/", "_per_").replace(" ", "_")


@query(
    "flow_features",
    f"WITH {FLOWS} SELECT window_us, src, dst, src_port, dst_port, protocol, n AS packet_count, "
    + ", ".join(
        f"round(CAST({x} AS DOUBLE), 3) AS {_short(n)}"
        for x, n in zip(FEATURE_SQL, FLOW_FEATURES)
    )
    + " FROM g",
)
def flow_features(spark, sf_dir):
    return short_features(flows.flow_features(packets(spark, sf_dir), FLOW_WINDOW_SECONDS))


def short_features(found):
    return found.select(
        "window_us", "src", "dst", "src_port", "dst_port", "protocol", "packet_count",
        *[F.round(f"`{n}`", 3).alias(_short(n)) for n in FLOW_FEATURES],
    )


@query(
    "flow_events",
    f"""WITH {FLOWS}, h AS (SELECT *, sha256(window_us || '|' || src || '|' || src_port || '|'
        || dst || '|' || dst_port || '|' || protocol) AS digest FROM g)
    SELECT 'EVT-' || left(digest, 16) AS event_id, window_us + 86400000000 AS ts_us, src, dst,
      src_port, dst_port, protocol, CASE WHEN bn > fn THEN 'DOS' ELSE 'BENIGN' END AS type,
      round(greatest(bn, fn) / n, 4) AS confidence,
      CASE WHEN greatest(bn, fn) / n >= 0.9 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
      n AS packet_count, CAST(fl + bl AS BIGINT) AS total_bytes,
      round(n / dur, 4) AS packet_rate, round(ps, 4) AS packet_size_std,
      CAST(syn AS BIGINT) AS syn_count FROM h""",
)
def flow_events(spark, sf_dir):
    """A rule on directions stands in for the model, so that SQL can repeat it."""
    found = flows.flow_features(packets(spark, sf_dir), FLOW_WINDOW_SECONDS)
    back, ahead = F.col("Total Backward Packets"), F.col("Total Fwd Packets")
    classified = found.withColumns(
        {
            "prediction": F.when(back > ahead, "DOS").otherwise("BENIGN"),
            "confidence": F.greatest(back, ahead) / F.col("packet_count"),
        }
    )
    keep = ["packet_count", "total_bytes", "packet_rate", "packet_size_std", "syn_count"]
    return flows.flow_events(classified).select(
        "event_id", "ts_us", "src", "dst", "src_port", "dst_port", "protocol", "type",
        "confidence", "severity", *[f"evidence.{c}" for c in keep],
    )
