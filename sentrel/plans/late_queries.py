"""Late evidence and correlated findings, in batch and as streams over files."""

from pyspark.sql import functions as F

from sentrel.functions.staging import scratch as _folder
from sentrel.operators import lateness
from sentrel.plans.adapters import table
from sentrel.plans.registry import query
from sentrel.streaming import late

HOUR = 3_600_000_000
WINDOW_US, LATENESS_US, LEAST = 24 * HOUR, 6 * HOUR, 3
PARTS = 12

# Events come in twelve batches by number; every fifth is held back for some batches.
ARRIVALS = f"""ar AS (SELECT event_id, '10.0.0.' || (user_id % 40) AS src, epoch_us(ts) AS ts_us,
    least({PARTS - 1}, event_id * {PARTS} // (SELECT count(*) FROM events)
      + CASE WHEN event_id % 5 = 0 THEN event_id % 4 ELSE 0 END) AS batch FROM events)"""
# Watermarks and closing batches from their definition, by plain joins.
MARKS = f"""mx AS (SELECT batch, max(max(ts_us)) OVER (ORDER BY batch) - {LATENESS_US} AS after FROM ar GROUP BY batch),
mk AS (SELECT *, lag(after) OVER (ORDER BY batch) AS before FROM mx),
ev AS (SELECT ar.*, w, w + {WINDOW_US} <= before AS late FROM
    (SELECT *, ts_us // {WINDOW_US} * {WINDOW_US} AS w FROM ar) ar JOIN mk USING (batch))"""
VERSIONS = f"""WITH {ARRIVALS}, {MARKS},
cl AS (SELECT w, min(mk.batch) AS closing FROM (SELECT DISTINCT w FROM ev) JOIN mk ON after >= w + {WINDOW_US} GROUP BY w),
st AS (SELECT src, w, CASE WHEN late THEN batch ELSE closing END AS step, count(*) AS n,
    count(*) FILTER (late) AS nl, min(ts_us) AS f, max(ts_us) AS l FROM ev JOIN cl USING (w) GROUP BY ALL),
su AS (SELECT src, w, step, sum(n) OVER o AS ne, sum(nl) OVER o AS nlate, n, min(f) OVER o AS f, max(l) OVER o AS l
  FROM st WINDOW o AS (PARTITION BY src, w ORDER BY step)),
vs AS (SELECT *, row_number() OVER (PARTITION BY src, w ORDER BY step) AS v FROM su WHERE ne >= {LEAST})
SELECT src, w AS window_us, v::INT AS version, step::BIGINT AS batch_id,
  CASE WHEN v > 1 THEN 'AMENDED' WHEN nlate > 0 THEN 'OPENED_LATE' ELSE 'FINAL' END AS status,
  ne::BIGINT AS n_events, nlate::BIGINT AS n_late, n AS n_added, f AS first_us, l AS last_us FROM vs"""


def _arrivals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    held = F.when(i % 5 == 0, i % 4).otherwise(0)
    batch = F.least(F.lit(PARTS - 1), F.floor(i * PARTS / F.lit(e.count())) + held)
    return e.select(
        "event_id",
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 40).cast("string")).alias("src"),
        F.unix_micros("ts").alias("ts_us"),
        batch.cast("bigint").alias("batch"),
    )


@query("incident_versions", VERSIONS)
def incident_versions(spark, sf_dir):
    return lateness.incident_versions(
        _arrivals(spark, sf_dir), ["src"], "ts_us", "batch", WINDOW_US, LATENESS_US, LEAST
    )


@query(
    "lateness_counts",
    f"""WITH {ARRIVALS}, {MARKS} SELECT batch::BIGINT AS batch_id, count(*) AS n_events,
  count(*) FILTER (late) AS n_late, 0::BIGINT AS n_undated FROM ev GROUP BY batch""",
)
def lateness_counts(spark, sf_dir):
    return lateness.lateness_counts(_arrivals(spark, sf_dir), "ts_us", "batch", WINDOW_US, LATENESS_US)


@query("stream_incident_versions", VERSIONS)
def stream_incident_versions(spark, sf_dir):
    """The same versions from a stream, one file and micro-batch for each arrival batch."""
    source, out = _folder(spark, "arrivals"), _folder(spark, "versions")
    arrivals = _arrivals(spark, sf_dir)
    for batch in range(PARTS):
        arrivals.where(F.col("batch") == batch).coalesce(1).write.mode("append").parquet(source)
    events = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", 1).parquet(source)
    writer = late.version_incidents(events, f"{out}/tables", ["src"], "ts_us", WINDOW_US, LATENESS_US, LEAST)
    writer.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/tables/versions").withColumn("batch_id", F.col("batch_id").cast("bigint"))


WITHIN = 1800
FINDINGS = """ev AS (SELECT 'dev-' || (user_id % 30) AS device_id, event_id AS finding_id, ts, event_type FROM events),
sf AS (SELECT * FROM ev WHERE event_type = 'signup'), nf AS (SELECT * FROM ev WHERE event_type = 'click')"""
PAIRS = f"""WITH {FINDINGS} SELECT sf.device_id, sf.finding_id AS sensor_id, nf.finding_id AS network_id,
  epoch_us(sf.ts) AS sensor_us, epoch_us(nf.ts) AS network_us, 'sensor-network-1' AS rule, 'POSSIBLE' AS association
FROM sf JOIN nf ON sf.device_id = nf.device_id
  AND nf.ts BETWEEN sf.ts - INTERVAL {WITHIN} SECOND AND sf.ts + INTERVAL {WITHIN} SECOND"""


def _findings(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("dev-"), (F.col("user_id") % 30).cast("string")).alias("device_id"),
        F.col("event_id").alias("finding_id"),
        "ts",
        "event_type",
    )


def _flat(pairs):
    return pairs.select(
        "device_id", "sensor_id", "network_id", F.unix_micros("sensor_ts").alias("sensor_us"),
        F.unix_micros("network_ts").alias("network_us"), "rule", "association",
    )


@query("findings_nearby", PAIRS)
def findings_nearby(spark, sf_dir):
    found = _findings(spark, sf_dir)
    sensor, network = (found.where(F.col("event_type") == kind) for kind in ("signup", "click"))
    return _flat(lateness.nearby_findings(sensor, network, "device_id", WITHIN))


@query(
    "findings_correlated",
    f"""WITH p AS ({PAIRS}) SELECT device_id, sensor_id, sensor_us, rule, count(DISTINCT network_id) AS n_network,
  min(network_us) AS first_network_us, max(network_us) AS last_network_us FROM p GROUP BY ALL""",
)
def findings_correlated(spark, sf_dir):
    found = _findings(spark, sf_dir)
    sensor, network = (found.where(F.col("event_type") == kind) for kind in ("signup", "click"))
    pairs = lateness.nearby_findings(sensor, network, "device_id", WITHIN, mark_first=True)
    incidents = lateness.correlated_incidents(pairs, "device_id")
    times = ("sensor", "first_network", "last_network")
    return incidents.withColumns({f"{t}_us": F.unix_micros(f"{t}_ts") for t in times}).drop(*[f"{t}_ts" for t in times])


@query("stream_findings_nearby", PAIRS)
def stream_findings_nearby(spark, sf_dir):
    """Two streams of findings joined with watermarks on both."""
    out = _folder(spark, "correlation")
    found = _findings(spark, sf_dir)
    sides = []
    for kind in ("signup", "click"):
        rows = found.where(F.col("event_type") == kind).drop("event_type")
        rows.repartitionByRange(4, "ts").write.parquet(f"{out}/{kind}")
        sides.append(spark.readStream.schema(rows.schema).parquet(f"{out}/{kind}"))
    pairs = late.stream_correlation(*sides, "device_id", WITHIN)
    writer = pairs.writeStream.format("parquet").option("path", f"{out}/pairs")
    writer.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _flat(spark.read.schema(pairs.schema).parquet(f"{out}/pairs"))
