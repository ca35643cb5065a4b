"""Sources, sinks and the flow stream: given tables are written to the staging folder and read back
through the operators."""

from pyspark.sql import functions as F

from sentrel.functions.staging import scratch as _folder
from sentrel.operators import quality as q
from sentrel.plans.adapters import FLOW_WINDOW_SECONDS, packets, sec_events, table
from sentrel.plans.flow_queries import short_features
from sentrel.plans.registry import ORACLES, query
from sentrel.plans.sql_parts import SEC
from sentrel.sources import events as src
from sentrel.streaming import jobs


@query(
    "file_documents",
    "SELECT l_orderkey AS id, l_linenumber AS line, l_quantity AS quantity, l_returnflag AS flag FROM lineitem",
)
def file_documents(spark, sf_dir):
    """JSON array documents, one for the few lines of each order, written and read in parallel."""
    path = _folder(spark, "arrays")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"),
        F.col("l_returnflag").alias("flag"),
    )
    documents = rows.groupBy("id").agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    documents.select("value").write.text(path)
    return src.read_documents(spark, path, "id bigint, line int, quantity double, flag string", per_line=True)


@query("file_rows", "SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal AS balance FROM customer")
def file_rows(spark, sf_dir):
    """A folder of JSON rows is replaced, not added to."""
    path = _folder(spark, "rows")
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")
    )
    src.write_documents(rows.select("id"), path)
    src.write_documents(rows, path)
    return spark.read.schema("id bigint, segment string, balance double").json(path)


@query(
    "file_events",
    f"""WITH {SEC} SELECT event_id, ts_us, src, dst, src_port, dst_port, protocol, type, confidence, severity,
    pattern_id FROM sec""",
)
def file_events(spark, sf_dir):
    """Events are appended as JSON lines in two parts and read back as one stream of events."""
    path = _folder(spark, "events")
    events = sec_events(spark, sf_dir).drop("seq", "observations", "pattern_status")
    half = F.xxhash64("event_id") > 0
    src.append_events(events.where(half), path)
    src.append_events(events.where(~half), path)
    return src.read_events(spark, path).select(
        "event_id", "ts_us", "src", "dst", "src_port", "dst_port", "protocol", "type", "confidence", "severity",
        "pattern_id",
    )


@query(
    "file_datasets",
    """SELECT kind, p_size, n, total FROM (SELECT p_size, count(*) AS n, sum(p_partkey)::BIGINT AS total FROM part
    GROUP BY 1), (SELECT unnest(['csv', 'parquet']) AS kind)""",
)
def file_datasets(spark, sf_dir):
    """A processed dataset as Parquet and as CSV with a header."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name")
    parts = []
    for kind in ("csv", "parquet"):
        path = _folder(spark, kind)
        src.write_dataset(rows, path, csv=kind == "csv")
        back = spark.read.csv(path, header=True, schema=rows.schema) if kind == "csv" else spark.read.parquet(path)
        totals = back.groupBy("p_size").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("total"))
        parts.append(totals.select(F.lit(kind).alias("kind"), "p_size", "n", "total"))
    return q.combine(*parts)


@query(
    "file_labelled_csv",
    """SELECT s_suppkey::VARCHAR AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'DoS é' ELSE 'BENIGN' END AS label,
    CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_nationkey::VARCHAR END AS extra FROM supplier""",
)
def file_labelled_csv(spark, sf_dir):
    """Latin-1 files with padded headers, one of them without a column of the other."""
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias(" id"),
        F.when(F.col("s_suppkey") % 2 == 0, "DoS é").otherwise("BENIGN").alias(" Label "),
        F.col("s_nationkey").alias("extra "),
    )
    paths = []
    for third in (True, False):
        path = _folder(spark, "labelled")
        some = rows.where((F.col("` id`") % 3 == 0) == third)
        some = some.drop("extra ") if third else some
        some.write.option("encoding", "ISO-8859-1").csv(path, header=True)
        paths.append(path)
    return src.read_labelled_csv(spark, paths).select("id", F.col("Label").alias("label"), "extra")


@query("stream_flow_features", ORACLES["flow_features"])
def stream_flow_features(spark, sf_dir):
    """The packets as a file stream; a packet ten windows later lets the watermark close them all."""
    path, out, marks = (_folder(spark, n) for n in ("packets", "flows", "marks"))
    rows = packets(spark, sf_dir)
    rows.write.parquet(path)
    late = F.timestamp_micros(F.col("ts_us") + 10 * FLOW_WINDOW_SECONDS * 1_000_000)
    closing = rows.orderBy(F.desc("ts_us")).limit(1).withColumn("ts", late).withColumn("ts_us", F.unix_micros("ts"))
    closing.coalesce(1).write.mode("append").parquet(path)
    jobs.use_rocksdb(spark)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    flows = jobs.stream_flows(stream, FLOW_WINDOW_SECONDS).drop("w")
    jobs.append_to(flows, out, marks).awaitTermination()
    return short_features(spark.read.parquet(out))
