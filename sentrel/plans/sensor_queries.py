"""Queries over sensor samples: causal features and quality findings."""

from pyspark.sql import functions as F

from sentrel.operators import sensors
from sentrel.plans.adapters import table
from sentrel.plans.registry import query

HOUR = 3_600_000_000
WINDOW_US, BASELINE_US = 6 * HOUR, 48 * HOUR

# Events stand in for the samples of ten sensors; every 37th is lost, every 31st has no value, and
# in blocks of events a sensor's value does not move.
SAMPLES = """rd AS (SELECT 'sensor-' || (user_id % 10) AS device_id, event_id AS sequence, epoch_us(ts) AS ts_us,
    CASE WHEN event_id % 31 = 0 THEN NULL
      WHEN (event_id // 320) % 5 = 0 THEN (user_id % 10)::DOUBLE ELSE value END AS value
  FROM events WHERE event_id % 37 <> 0)"""


def _samples(spark, sf_dir):
    i, device = F.col("event_id"), F.col("user_id") % 10
    value = (
        F.when(i % 31 == 0, F.lit(None))
        .when(F.expr("event_id div 320") % 5 == 0, device.cast("double"))
        .otherwise(F.col("value"))
    )
    return table(spark, sf_dir, "events").where(i % 37 != 0).select(
        F.concat(F.lit("sensor-"), device.cast("string")).alias("device_id"),
        i.alias("sequence"),
        F.unix_micros("ts").alias("ts_us"),
        value.alias("value"),
    )


@query(
    "sensor_features",
    f"""WITH {SAMPLES},
g AS (SELECT device_id, ts_us AS t, count(*)::HUGEINT AS n, sum(v)::HUGEINT AS v1, sum(v * v)::HUGEINT AS v2
  FROM (SELECT *, round(value * 1000000)::HUGEINT AS v FROM rd WHERE value IS NOT NULL) GROUP BY ALL),
w AS (SELECT *, lag(t) OVER o AS pt, lag(v1::DOUBLE / n) OVER o AS pq,
    sum(n) OVER a AS wn, sum(v1) OVER a AS w1, sum(v2) OVER a AS w2,
    sum(n * t) OVER a AS ws, sum(n * t::HUGEINT * t) OVER a AS wss, sum(t * v1) OVER a AS wsv,
    coalesce(sum(n) OVER b, 0) AS bn, sum(v1) OVER b AS b1, sum(v2) OVER b AS b2
  FROM g WINDOW o AS (PARTITION BY device_id ORDER BY t),
    a AS (PARTITION BY device_id ORDER BY t RANGE BETWEEN {WINDOW_US} PRECEDING AND CURRENT ROW),
    b AS (PARTITION BY device_id ORDER BY t RANGE BETWEEN {BASELINE_US} PRECEDING AND {WINDOW_US + 1} PRECEDING)),
d AS (SELECT *, v1::DOUBLE / n AS q, w1::DOUBLE / wn AS wm, b1::DOUBLE / bn AS bm,
    sqrt(greatest((wn * w2 - w1 * w1)::DOUBLE / wn, 0) / (wn - 1)) AS sd,
    sqrt(greatest((bn * b2 - b1 * b1)::DOUBLE / bn, 0) / (bn - 1)) AS bd,
    (wn * wss - ws * ws)::DOUBLE AS down, (wn * wsv - ws * w1)::DOUBLE AS up FROM w)
SELECT device_id, t AS ts_us, q / 1e6 AS value, wn::BIGINT AS n_window,
  CASE WHEN wn >= 3 THEN round(wm / 1e6, 6) END AS mean, CASE WHEN wn >= 3 THEN round(sd / 1e6, 5) END AS std,
  CASE WHEN wn >= 3 AND down > 0 THEN round(up / down, 6) END AS slope,
  round((q - pq) / (t - pt), 6) AS rate, bn::BIGINT AS n_baseline,
  CASE WHEN bn >= 10 THEN round(bm / 1e6, 6) END AS baseline_mean,
  CASE WHEN bn >= 10 THEN round(bd / 1e6, 5) END AS baseline_std,
  CASE WHEN bn >= 10 AND bd > 0 THEN round((q - bm) / bd, 4) END AS deviation,
  CASE WHEN wn >= 3 AND bn >= 10 THEN 'READY' ELSE 'INSUFFICIENT_HISTORY' END AS status FROM d""",
)
def sensor_features(spark, sf_dir):
    found = sensors.causal_features(
        _samples(spark, sf_dir), ["device_id"], "ts_us", "value", WINDOW_US, BASELINE_US
    )
    digits = {"mean": 6, "std": 5, "slope": 6, "rate": 6, "baseline_mean": 6, "baseline_std": 5, "deviation": 4}
    return found.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(
    "sensor_findings",
    f"""WITH {SAMPLES},
s AS (SELECT *, lag(ts_us) OVER o AS pt, lag(sequence) OVER o AS ps, lag(value) OVER o AS pv,
    row_number() OVER o AS k FROM rd WINDOW o AS (PARTITION BY device_id ORDER BY ts_us, sequence)),
r AS (SELECT *, sum(CASE WHEN pv = value THEN 0 ELSE 1 END) OVER (PARTITION BY device_id ORDER BY k) AS run FROM s),
z AS (SELECT device_id, run, min(ts_us) AS a, max(ts_us) AS b, count(*) AS n, any_value(value) AS v
  FROM r WHERE value IS NOT NULL GROUP BY ALL)
SELECT device_id, 'STUCK_VALUE' AS kind, a AS start_us, b AS end_us, n AS n_samples, NULL::BIGINT AS missing,
  v AS amount FROM z WHERE n >= 3 AND b - a >= {HOUR}
UNION ALL SELECT device_id, 'SAMPLE_GAP', pt, ts_us, 2, ceil((ts_us - pt) / {HOUR // 2}.0)::BIGINT - 1,
  (ts_us - pt) / 1e6 FROM s WHERE ts_us - pt > {HOUR}
UNION ALL SELECT device_id, 'SEQUENCE_GAP', pt, ts_us, 2, sequence - ps - 1, NULL FROM s WHERE sequence - ps > 1
UNION ALL SELECT device_id, 'RAPID_CHANGE', pt, ts_us, 2, NULL, round((value - pv) * 1e6 / (ts_us - pt), 9)
  FROM s WHERE ts_us > pt AND abs((value - pv) * 1e6 / (ts_us - pt)) > 0.05""",
)
def sensor_findings(spark, sf_dir):
    found = sensors.quality_findings(
        _samples(spark, sf_dir),
        ["device_id"],
        "ts_us",
        "sequence",
        "value",
        cadence_us=HOUR // 2,
        stuck_us=HOUR,
        most_per_second=0.05,
        bucket_us=24 * HOUR,
    )
    rapid = F.col("kind") == sensors.JUMP
    return found.withColumn("amount", F.when(rapid, F.round("amount", 9)).otherwise(F.col("amount")))
