"""Drift, manifests and disposition accounting."""

from pyspark.sql import functions as F

from sentrel.functions.staging import scratch as _folder
from sentrel.operators import accounting, drift, manifest
from sentrel.operators.accounting import Rule
from sentrel.plans.adapters import table
from sentrel.plans.registry import query

DAY = 86_400_000_000

# Values shift for purchases of later weeks; some are missing.
SHIFTED = f"""v AS (SELECT event_type AS kind, epoch_us(ts) // {DAY} AS day,
    CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_type = 'purchase' THEN value + event_id % 400 / 10.0 ELSE value END AS amount,
    (event_id * 7 % 1000)::DOUBLE AS noise FROM events),
d0 AS (SELECT min(day) AS d FROM v)"""


@query(
    "feature_drift",
    f"""WITH {SHIFTED},
l AS (SELECT kind, day, 'amount' AS feature, amount AS x FROM v UNION ALL SELECT kind, day, 'noise', noise FROM v),
r AS (SELECT kind, feature, list(x) FILTER (x IS NOT NULL) AS xs, count(x) AS n, count(*) - count(x) AS m
  FROM l, d0 WHERE day < d + 7 GROUP BY ALL),
c AS (SELECT kind, feature, (day - d) // 7 AS period, list(x) FILTER (x IS NOT NULL) AS xs, count(x) AS n,
    count(*) - count(x) AS m FROM l, d0 WHERE day >= d + 7 GROUP BY ALL),
e AS (SELECT kind, feature, list_sort(list_distinct(quantile_disc(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS q
  FROM l, d0 WHERE day < d + 7 GROUP BY ALL),
j AS (SELECT c.kind, c.feature, c.period, r.n AS n_reference, c.n AS n_current, r.m AS missing_reference,
    c.m AS missing_current, list_concat([0.0::DOUBLE], list_transform(q, lambda y: len(list_filter(r.xs, lambda x: x <= y)) / r.n::DOUBLE), [1.0::DOUBLE]) AS a,
    list_concat([0.0::DOUBLE], list_transform(q, lambda y: len(list_filter(c.xs, lambda x: x <= y)) / c.n::DOUBLE), [1.0::DOUBLE]) AS b
  FROM c JOIN r USING (kind, feature) JOIN e USING (kind, feature)),
p AS (SELECT * EXCLUDE (a, b), list_sum(list_transform(range(1, len(a)), lambda i:
      (greatest(b[i + 1] - b[i], 1e-4) - greatest(a[i + 1] - a[i], 1e-4))
      * ln(greatest(b[i + 1] - b[i], 1e-4) / greatest(a[i + 1] - a[i], 1e-4)))) AS psi,
    list_max(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i]))) AS shift FROM j)
SELECT * REPLACE (round(psi, 6) AS psi, round(shift, 6) AS shift, period::BIGINT AS period), CASE WHEN psi >= 0.25 THEN 'MAJOR'
  WHEN psi >= 0.1 THEN 'MODERATE' ELSE 'STABLE' END AS status FROM p""",
)
def feature_drift(spark, sf_dir):
    """Each later week against the first; sketches of this size are exact up to 32 768 values."""
    i = F.col("event_id")
    moved = F.when(F.col("event_type") == "purchase", F.col("value") + i % 400 / 10.0).otherwise(F.col("value"))
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("kind"),
        F.unix_micros("ts").alias("ts_us"),
        F.when(i % 17 != 0, moved).alias("amount"),
        (i * 7 % 1000).cast("double").alias("noise"),
    )
    first = rows.agg(F.floor(F.min("ts_us") / DAY)).first()[0] or 0
    day, features = F.col("day"), ["amount", "noise"]
    sketches = drift.daily_sketches(rows, "ts_us", features, ["kind"], 32_768)
    edges = drift.reference_edges(sketches, day < first + 7, ["kind"])
    counts = drift.daily_histograms(rows, "ts_us", edges, features, ["kind"])
    found = drift.drift(counts, day < first + 7, day >= first + 7, F.floor((day - first) / 7), ["kind"])
    return found.withColumns({c: F.round(c, 6) for c in ("psi", "shift")})


def _text(column):
    return f"coalesce(length({column}) || ':' || {column}, '~')"


def _digest(source, key):
    """SQL: the digest of the rows of ``source`` (with ``sha``), by ``key``."""
    pieces = [f"('0x' || sha[{16 * i + 1}:{16 * i + 16}])::UBIGINT" for i in range(4)]
    texts = " || ".join(f"printf('%016x', (sum({p}) % 18446744073709551616::HUGEINT)::UBIGINT)" for p in pieces)
    return f"SELECT {key}, count(*) AS n_rows, {texts} AS digest FROM {source} GROUP BY ALL"


DOCS = f"""d AS (SELECT source, lang, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
    sha256({_text('doc_id::VARCHAR')} || {_text('text')}) AS sha FROM documents)"""


@query("dataset_manifest", f"WITH {DOCS} {_digest('d', 'source, lang, split')}")
def dataset_manifest(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn(
        "split", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train")
    )
    return manifest.manifest(rows, ["doc_id", "text"], ["source", "lang", "split"])


ORDERS = f"""o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s FROM orders),
o2 AS (SELECT k, c, CASE WHEN k % 1999 = 0 THEN 'X' ELSE s END AS s FROM o WHERE k % 2003 <> 0),
h1 AS (SELECT sha256({_text('k::VARCHAR')})[1:3] AS leaf,
  sha256({_text('k::VARCHAR')} || {_text('c::VARCHAR')} || {_text('s')}) AS sha FROM o),
h2 AS (SELECT sha256({_text('k::VARCHAR')})[1:3] AS leaf,
  sha256({_text('k::VARCHAR')} || {_text('c::VARCHAR')} || {_text('s')}) AS sha FROM o2)"""


def _orders(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    changed = F.when(F.col("o_orderkey") % 1999 == 0, "X").otherwise(F.col("o_orderstatus"))
    return rows, rows.where(F.col("o_orderkey") % 2003 != 0).withColumn("o_orderstatus", changed)


def _tree(rows):
    return manifest.digest_tree(rows, ["o_orderkey", "o_custkey", "o_orderstatus"], ["o_orderkey"])


@query(
    "manifest_tree",
    f"""WITH {ORDERS}, lv AS (SELECT n AS level, leaf[1:n] AS prefix, sha FROM h1, range(0, 4) r(n))
  SELECT level::INT AS level, prefix, n_rows, digest FROM ({_digest('lv', 'level, prefix')})""",
)
def manifest_tree(spark, sf_dir):
    return _tree(_orders(spark, sf_dir)[0])


@query(
    "manifest_changes",
    f"""WITH {ORDERS}, a AS ({_digest('h1', 'leaf')}), b AS ({_digest('h2', 'leaf')})
SELECT coalesce(a.leaf, b.leaf) AS prefix, coalesce(a.n_rows, 0) AS rows_before, coalesce(b.n_rows, 0) AS rows_after
FROM a FULL JOIN b ON a.leaf = b.leaf WHERE a.digest IS DISTINCT FROM b.digest""",
)
def manifest_changes(spark, sf_dir):
    before, after = _orders(spark, sf_dir)
    return manifest.differing_leaves(_tree(before), _tree(after))


# Raw records of four gateways: broken ones, empty ones, repeated payloads, unknown devices.
RAW = """raw AS (SELECT event_id AS record_id, 'gw-' || (event_id % 4) AS gateway, epoch_us(ts) AS received_us,
    'dev-' || (user_id % 60) AS device,
    CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 43 = 0 THEN '' WHEN event_id % 47 = 0 THEN event_type
      ELSE event_type || '|' || (event_id // 3 % 500) || '|' || (user_id % 60) END AS payload FROM events),
ru AS (SELECT *, CASE WHEN payload IS NULL OR payload = '' THEN 1
    WHEN len(string_split(payload, '|')) <> 3 THEN 2 WHEN string_split(payload, '|')[2]::INT % 29 = 0 THEN 3 END AS rule FROM raw),
fi AS (SELECT payload, min(record_id) AS f FROM ru WHERE rule IS NULL GROUP BY payload),
di AS (SELECT ru.*, CASE rule WHEN 1 THEN 'REJECTED' WHEN 2 THEN 'REJECTED' WHEN 3 THEN 'UNRESOLVED'
    ELSE CASE WHEN record_id > f THEN 'DUPLICATE' WHEN device >= 'dev-50' AND length(device) = 6 THEN 'UNRESOLVED'
      ELSE 'ACCEPTED' END END AS disposition, sha256(ru.payload) AS payload_sha256
  FROM ru LEFT JOIN fi ON ru.payload = fi.payload AND rule IS NULL)"""


def _disposed(spark, sf_dir):
    i, user = F.col("event_id"), F.col("user_id") % 60
    number = F.expr("event_id div 3 % 500").cast("string")
    payload = (
        F.when(i % 41 == 0, F.lit(None))
        .when(i % 43 == 0, "")
        .when(i % 47 == 0, F.col("event_type"))
        .otherwise(F.concat_ws("|", "event_type", number, user.cast("string")))
    )
    raw = table(spark, sf_dir, "events").select(
        i.alias("record_id"),
        F.concat(F.lit("gw-"), (i % 4).cast("string")).alias("gateway"),
        F.unix_micros("ts").alias("received_us"),
        F.concat(F.lit("dev-"), user.cast("string")).alias("device"),
        payload.alias("payload"),
    )
    fields = F.split("payload", r"\|")
    rules = [
        Rule("EMPTY", 1, "no payload", F.col("payload").isNull() | (F.col("payload") == "")),
        Rule("FIELDS", 2, "not three fields", F.size(fields) != 3),
        Rule("CALIBRATION", 1, "no calibration", F.get(fields, F.lit(1)).try_cast("int") % 29 == 0, accounting.UNRESOLVED),
    ]
    known = table(spark, sf_dir, "events").select(F.concat(F.lit("dev-"), user.cast("string")).alias("device"))
    known = known.where(~((F.col("device") >= "dev-50") & (F.length("device") == 6)))
    return accounting.dispose(raw, rules, "payload", "record_id", known, "device")


@query(
    "record_dispositions",
    f"""WITH {RAW} SELECT gateway AS source, count(*) AS n_input, count(*) FILTER (disposition = 'ACCEPTED') AS n_accepted,
  count(*) FILTER (disposition = 'REJECTED') AS n_rejected, count(*) FILTER (disposition = 'DUPLICATE') AS n_duplicate,
  count(*) FILTER (disposition = 'UNRESOLVED') AS n_unresolved FROM di GROUP BY gateway""",
)
def record_dispositions(spark, sf_dir):
    return accounting.dispositions(_disposed(spark, sf_dir), "gateway")


@query(
    "record_quarantine",
    f"""WITH {RAW} SELECT record_id, gateway AS source, payload_sha256,
  CASE rule WHEN 1 THEN 'EMPTY' WHEN 2 THEN 'FIELDS' WHEN 3 THEN 'CALIBRATION' ELSE 'UNKNOWN_DEVICE' END AS rule_id,
  CASE WHEN rule = 2 THEN 2 ELSE 1 END::INT AS rule_version,
  CASE rule WHEN 1 THEN 'no payload' WHEN 2 THEN 'not three fields' WHEN 3 THEN 'no calibration'
    ELSE 'device not in the inventory' END AS reason, received_us AS received_at, 'OPEN' AS resolution
FROM di WHERE disposition IN ('REJECTED', 'UNRESOLVED')""",
)
def record_quarantine(spark, sf_dir):
    return accounting.quarantine(_disposed(spark, sf_dir), "record_id", "gateway", "received_us")


@query(
    "file_accounted",
    f"WITH {RAW} SELECT record_id, payload_sha256, disposition FROM di",
)
def file_accounted(spark, sf_dir):
    """Records written by disposition, counted and reconciled with the input."""
    path = _folder(spark, "accounted")
    accounting.write_accounted(_disposed(spark, sf_dir), path, table(spark, sf_dir, "events").count())
    return spark.read.parquet(path).select("record_id", "payload_sha256", "disposition")
