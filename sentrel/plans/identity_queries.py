"""Queries on the devices behind addresses."""

from pyspark.sql import functions as F

from sentrel.operators import identity
from sentrel.plans.adapters import table
from sentrel.plans.registry import query

# Every tenth event claims an address for a device for some hours; a few claims never end, a few
# hold since ever, a few end before they begin. The other events are seen at addresses.
CLAIMS = """cl AS (SELECT '10.0.0.' || (user_id % 25) AS address, 'dev-' || (event_id // 10 % 7) AS device_id,
    CASE WHEN event_id % 1300 = 0 THEN NULL ELSE epoch_us(ts) END AS f,
    CASE WHEN event_id % 900 = 0 THEN NULL
      WHEN event_id % 70 = 0 THEN epoch_us(ts) - 1000
      ELSE epoch_us(ts) + CAST(floor(value * 1200) AS BIGINT) * 1000000 END AS t
  FROM events WHERE event_id % 10 = 0),
ok AS (SELECT * FROM cl WHERE f IS NULL OR t IS NULL OR f < t)"""


def _claims(spark, sf_dir):
    i, us = F.col("event_id"), F.unix_micros("ts")
    until = us + F.floor(F.col("value") * 1200).cast("bigint") * 1_000_000
    return table(spark, sf_dir, "events").where(i % 10 == 0).select(
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 25).cast("string")).alias("address"),
        F.concat(F.lit("dev-"), F.expr("event_id div 10 % 7").cast("string")).alias("device_id"),
        F.when(i % 1300 != 0, us).alias("valid_from_us"),
        F.when(i % 900 == 0, F.lit(None)).when(i % 70 == 0, us - 1000).otherwise(until).alias("valid_to_us"),
    )


@query(
    "device_identity",
    f"""WITH {CLAIMS},
o AS (SELECT event_id, '10.0.0.' || (user_id % 25) AS address, epoch_us(ts) AS ts_us FROM events
  WHERE event_id % 10 <> 0),
j AS (SELECT o.event_id, count(ok.address) AS n, count(DISTINCT device_id) AS nd, min(device_id) AS d
  FROM o LEFT JOIN ok ON o.address = ok.address AND (f IS NULL OR f <= ts_us) AND (t IS NULL OR ts_us < t)
  GROUP BY o.event_id)
SELECT o.*, n AS n_claims, CASE nd WHEN 0 THEN 'UNRESOLVED' WHEN 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END
    AS identity_status, CASE WHEN nd = 1 THEN d END AS resolved_device FROM o JOIN j USING (event_id)""",
)
def device_identity(spark, sf_dir):
    seen = table(spark, sf_dir, "events").where(F.col("event_id") % 10 != 0).select(
        "event_id",
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 25).cast("string")).alias("address"),
        F.unix_micros("ts").alias("ts_us"),
    )
    return identity.resolve_devices(seen, _claims(spark, sf_dir), "address", "ts_us")


@query(
    "device_conflicts",
    f"""WITH {CLAIMS},
m AS (SELECT DISTINCT address, unnest([coalesce(f, -9e17::BIGINT), coalesce(t, 9e17::BIGINT)]) AS p FROM ok),
s AS (SELECT address, p AS a, lead(p) OVER (PARTITION BY address ORDER BY p) AS b FROM m),
x AS (SELECT s.address, a, b, count(*) AS n FROM s JOIN ok ON s.address = ok.address
    AND coalesce(f, -9e17::BIGINT) <= a AND b <= coalesce(t, 9e17::BIGINT)
  GROUP BY ALL HAVING count(DISTINCT device_id) > 1)
SELECT address, CASE WHEN a > -9e17::BIGINT THEN a END AS from_us, CASE WHEN b < 9e17::BIGINT THEN b END AS to_us,
  n AS n_claims FROM x""",
)
def device_conflicts(spark, sf_dir):
    return identity.conflicting_claims(_claims(spark, sf_dir))
