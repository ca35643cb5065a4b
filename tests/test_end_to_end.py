"""Whole chains on small inputs."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sentrel.functions.fixed import FLOW_FEATURES
from sentrel.operators import flows, forest, isolation, patterns
from sentrel.plans import end_to_end as chain
from sentrel.plans.adapters import sec_events
from sentrel.sources import packets
from sentrel.streaming import jobs


def lines(spark, n=600):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        host = rng.randrange(6)
        t = rng.randrange(60_000) / 1000
        size = rng.randrange(1000, 1500) if host >= 3 else rng.randrange(60, 100)
        rows.append((i, f"{t:.3f}|10.0.0.{host}|10.1.0.1|{4000 + host}|80|||6|{size}|True|1|0|20|20"))
    rows.append((n, "not a packet"))
    return spark.createDataFrame(rows, "frame_no bigint, value string")


def test_packets_to_events(spark, tmp_path):
    jobs.use_rocksdb(spark)
    text = lines(spark)
    found = flows.flow_features(packets.accepted(packets.parse_packets(text)))
    big = F.col("Packet Length Mean") > 500
    labelled = found.withColumn("Label", F.when(big, "DOS").otherwise("BENIGN"))
    model = forest.train_forest(labelled, trees=5, depth=4)
    events = chain.packets_to_events(text, model).collect()
    assert len(events) == found.count() > 20
    for e in events:
        assert (e["type"] == "DOS") == (int(e["src"][-1]) >= 3)
        assert (e["severity"] == "HIGH") == (e["confidence"] >= 0.9)
        assert e["evidence"]["packet_count"] >= 2
    # The same chain on a stream; a late packet closes the windows.
    src = str(tmp_path / "in")
    text.coalesce(1).write.parquet(src)
    last = "500|10.0.0.9|10.1.0.1|1|80|||6|60|0|0|0|20|20"
    end = spark.createDataFrame([(9999, last)], "frame_no bigint, value string")
    end.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(text.schema).parquet(src)
    out = str(tmp_path / "out")
    job = chain.packets_to_events(stream, model, lateness="5 seconds")
    jobs.append_to(job, out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == sorted(
        e["event_id"] for e in events
    )


def test_flows_to_patterns(spark):
    rng = np.random.default_rng(0)
    normal = rng.normal(10, 1, (300, 22))
    odd = 60 + rng.normal(0, 0.01, (12, 22))
    x = np.concatenate([odd, normal])
    pdf = pd.DataFrame(x, columns=FLOW_FEATURES)
    pdf["row_id"] = np.arange(len(x))
    pdf["Label"] = np.where(np.arange(len(x)) % 7 == 0, "DOS", "BENIGN")
    df = spark.createDataFrame(pdf)
    model = forest.train_forest(df, trees=3, depth=3)
    anomalies = isolation.fit_isolation(df.where("row_id >= 12"), "row_id", trees=30)
    store = spark.createDataFrame([], patterns.STORE_SCHEMA)
    grown = chain.flows_to_patterns(df, "row_id", model, anomalies, store).collect()
    assert any(r["cluster_size"] >= 3 and r["status"] == "NEW" for r in grown)
    assert all(len(r["behavioral_signature"]) == 7 for r in grown)


def test_events_to_dashboard(spark, tmp_path):
    events = sec_events(spark, "/root/testdata/sf0.001")
    tables = chain.events_to_dashboard(events, 21_600)
    chain.write_dashboard(tables, str(tmp_path))
    total = spark.read.json(str(tmp_path / "summary")).first()
    assert total["total_events"] == events.count()
    assert spark.read.json(str(tmp_path / "incidents")).count() == total["incidents"]
    assert spark.read.json(str(tmp_path / "timeline")).count() == total["suspicious_events"]
    assert spark.read.json(str(tmp_path / "reports")).count() == total["incidents"]
