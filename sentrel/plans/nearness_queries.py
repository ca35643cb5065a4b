"""Pattern identity by distance and leakage between splits."""

from pyspark.sql import functions as F

from sentrel.operators import leakage, patterns
from sentrel.plans.adapters import table
from sentrel.plans.registry import query

# Three components of every embedding are a cluster's signature; every third is in the store.
SCALES = {"first": (0.0, 0.1), "second": (0.01, 0.1), "third": (0.0, 0.2)}
THRESHOLD = 0.45
NEW, OLD = (
    f"""SELECT vec_id AS id, 3 + vec_id % 5 AS size,
    (embedding[1]::DOUBLE - 0.0) / 0.1 AS a, (embedding[2]::DOUBLE - 0.01) / 0.1 AS b,
    (embedding[3]::DOUBLE - 0.0) / 0.2 AS c FROM embeddings WHERE vec_id % 3 {sign} 0"""
    for sign in ("<>", "=")
)
NEAR = f"""n AS ({NEW}), o AS ({OLD}),
p AS (SELECT n.id AS cluster, 'P-' || o.id AS pattern_id, sqrt((n.a - o.a) ** 2 + (n.b - o.b) ** 2 + (n.c - o.c) ** 2) AS d
  FROM n JOIN o ON abs(n.a - o.a) <= {THRESHOLD} AND abs(n.b - o.b) <= {THRESHOLD}),
m AS (SELECT cluster, arg_min(pattern_id, (d, pattern_id)) AS matched_id, min(d) AS d, count(*) AS k FROM p
  WHERE d <= {THRESHOLD} GROUP BY cluster)"""


def _signatures(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    parts = [x for k, name in enumerate(SCALES) for x in (F.lit(name), F.col("embedding")[k].cast("double"))]
    rows = e.select(i, (3 + i % 5).alias("cluster_size"), F.create_map(*parts).alias("behavioral_signature"))
    new = rows.where(i % 3 != 0).withColumnRenamed("vec_id", "cluster")
    old = rows.where(i % 3 == 0).select(
        F.concat(F.lit("P-"), i.cast("string")).alias("pattern_id"),
        "cluster_size",
        F.lit("KNOWN").alias("status"),
        "behavioral_signature",
        i.alias("store_order"),
    )
    return new, old


@query(
    "patterns_by_distance",
    f"""WITH {NEAR}
SELECT n.id AS cluster, size AS cluster_size, matched_id, round(d, 6) AS match_distance,
  coalesce(k, 0) AS n_within, 'signature-1' AS signature_version FROM n LEFT JOIN m ON n.id = m.cluster""",
)
def patterns_by_distance(spark, sf_dir):
    new, old = _signatures(spark, sf_dir)
    found = patterns.match_by_distance(new, old, SCALES, THRESHOLD)
    return found.drop("behavioral_signature").withColumn("match_distance", F.round("match_distance", 6))


@query(
    "patterns_stored_by_distance",
    f"""WITH RECURSIVE {NEAR},
f AS (SELECT * FROM n WHERE id NOT IN (SELECT cluster FROM m)),
l AS (SELECT x.id AS u, y.id AS v FROM f x JOIN f y
  ON x.id <> y.id AND sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2) <= {THRESHOLD}),
r(id, reached) AS (SELECT id, id FROM f UNION SELECT r.id, l.v FROM r JOIN l ON r.reached = l.u),
g AS (SELECT id, min(reached) AS root FROM r GROUP BY id),
top AS (SELECT max(id) AS k FROM o)
SELECT 'KNOWN' AS status, size AS cluster_size, id AS store_order FROM o
UNION ALL SELECT 'NEW', size, k + 1 + f.id FROM f JOIN g ON g.id = f.id AND g.root = f.id, top""",
)
def patterns_stored_by_distance(spark, sf_dir):
    new, old = _signatures(spark, sf_dir)
    when = F.timestamp_seconds(F.lit(1_705_276_800))
    store = patterns.extend_store_by_distance(new, old, SCALES, THRESHOLD, when)
    return store.select("status", "cluster_size", "store_order")


TOLERANCES = {"quantity": 1.0, "price": 0.5, "discount": 1.0, "tax": 1.0}
# Order lines by whole hundreds of the price are flow features; every fifth order is held out.
LINES = """li AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey % 5 = 0 AS held,
    CASE WHEN l_linenumber = 7 AND l_orderkey % 3 = 0 THEN NULL ELSE l_quantity END AS quantity,
    floor(l_extendedprice / 250) / 4 AS price,
    round(l_discount * 100) AS discount, round(l_tax * 100) AS tax FROM lineitem)"""


def _lines(spark, sf_dir):
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select(
        (k * 10 + n).alias("id"),
        (k % 5 == 0).alias("held"),
        F.when(~((n == 7) & (k % 3 == 0)), F.col("l_quantity")).alias("quantity"),
        (F.floor(F.col("l_extendedprice") / 250) / 4).alias("price"),
        F.round(F.col("l_discount") * 100).alias("discount"),
        F.round(F.col("l_tax") * 100).alias("tax"),
    )
    return rows.where(~F.col("held")).drop("held"), rows.where("held").drop("held")


CLASSES = f"""WITH {LINES},
c AS (SELECT quantity, price, discount, tax, count(*) FILTER (held) AS n_held_out,
    count(*) FILTER (NOT held) AS n_train, min(id) FILTER (held) AS first_id, row_number() OVER () AS cid FROM li GROUP BY quantity, price, discount, tax),
p AS (SELECT a.cid, count(*) AS k, sum(b.n_train) AS rows, min(greatest(
      coalesce(abs(a.quantity - b.quantity), 0), abs(a.price - b.price) / 0.5,
      abs(a.discount - b.discount), abs(a.tax - b.tax))) AS nearest
  FROM c a JOIN c b ON a.price BETWEEN b.price - 0.5 AND b.price + 0.5
    AND abs(a.discount - b.discount) <= 1 AND abs(a.tax - b.tax) <= 1
    AND (abs(a.quantity - b.quantity) <= 1 OR a.quantity IS NULL AND b.quantity IS NULL)
  WHERE a.n_held_out > 0 AND b.n_train > 0 AND NOT (a.quantity IS NOT DISTINCT FROM b.quantity
    AND a.price = b.price AND a.discount = b.discount AND a.tax = b.tax) GROUP BY a.cid),
x AS (SELECT c.* EXCLUDE (cid), coalesce(k, 0) AS n_near_classes, coalesce(rows, 0)::BIGINT AS n_near_train, nearest,
    CASE WHEN n_train > 0 THEN 'EXACT' WHEN k > 0 THEN 'NEAR' ELSE 'NONE' END AS kind
  FROM c LEFT JOIN p USING (cid) WHERE n_held_out > 0)"""


@query("leakage_classes", f"{CLASSES} SELECT * FROM x")
def leakage_classes(spark, sf_dir):
    return leakage.leakage_classes(*_lines(spark, sf_dir), TOLERANCES, "id")


@query(
    "leakage_summary",
    f"{CLASSES} SELECT kind, count(*) AS n_classes, sum(n_held_out)::BIGINT AS n_rows FROM x GROUP BY kind",
)
def leakage_summary(spark, sf_dir):
    return leakage.leakage_summary(leakage.leakage_classes(*_lines(spark, sf_dir), TOLERANCES, "id"))


@query(
    "leakage_rows",
    f"""{CLASSES} SELECT li.id, x.kind AS leak_kind FROM li JOIN x ON held AND li.price = x.price
  AND li.discount = x.discount AND li.tax = x.tax AND li.quantity IS NOT DISTINCT FROM x.quantity""",
)
def leakage_rows(spark, sf_dir):
    train, held_out = _lines(spark, sf_dir)
    classes = leakage.leakage_classes(train, held_out, TOLERANCES, "id")
    return leakage.leaked_rows(held_out, classes, list(TOLERANCES)).select("id", "leak_kind")
