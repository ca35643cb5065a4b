"""Readers, sinks, cleaning and views on small files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sentrel.operators import graph, marts, quality
from sentrel.sources import events as src
from sentrel.sources import packets
from sentrel.streaming import jobs


def test_event_files(spark, tmp_path):
    lines = [
        json.dumps({"event_id": "1", "timestamp": "2024-01-01T00:00:00Z", "src": "a", "dst_port": 80,
                    "confidence": 0.5, "evidence": {"dst_port": 81, "packet_count": 3}}),
        "", "   ", "{broken", json.dumps({"event_id": "2", "timestamp": "2024-01-01T02:00:00+02:00"}),
        json.dumps({"event_id": "3", "timestamp": "2024-01-01T00:00:00.25", "confidence": None}),
        json.dumps({"event_id": "4", "timestamp": "soon", "src_port": "x"}),
    ]
    (tmp_path / "e.jsonl").write_text("\n".join(lines))
    rows = {r["event_id"]: r for r in src.read_events(spark, str(tmp_path)).collect()}
    assert set(rows) == {"1", "2", "3", "4"}
    assert rows["1"]["ts_us"] == rows["2"]["ts_us"] == 1_704_067_200_000_000
    assert rows["3"]["ts_us"] == 1_704_067_200_250_000 and rows["4"]["ts_us"] is None
    assert (rows["1"]["dst_port"], rows["1"]["evidence"]["dst_port"]) == ("80", "81")
    bad = src.malformed_events(src.parse_events(spark.read.text(str(tmp_path)))).collect()
    assert [r["value"] for r in bad] == ["{broken"]


def test_event_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.sql("SELECT 'E1' AS event_id, timestamp'2024-01-01 00:00:00.5' AS ts, 'DOS' AS type")
    src.append_events(df, path)
    src.append_events(df.withColumn("event_id", F.lit("E2")), path)
    back = src.read_events(spark, path)
    assert {(r["event_id"], r["ts_us"]) for r in back.collect()} == {
        ("E1", 1_704_067_200_500_000), ("E2", 1_704_067_200_500_000),
    }


def test_documents(spark, tmp_path):
    schema = "incident_id string, events array<string>, n bigint"
    read = lambda p: src.read_documents(spark, str(p), schema)
    assert read(tmp_path / "none.json").count() == 0
    (tmp_path / "obj.json").write_text('{"incident_id": "x"}')
    (tmp_path / "bad.json").write_text("[{")
    (tmp_path / "list.json").write_text('[{"incident_id": "a", "events": ["1"]},\n {"incident_id": "b", "n": 2}]')
    assert read(tmp_path / "obj.json").count() == 0
    assert read(tmp_path / "bad.json").count() == 0
    rows = read(tmp_path / "list.json").orderBy("incident_id").collect()
    assert [(r["incident_id"], r["events"], r["n"]) for r in rows] == [("a", ["1"], None), ("b", None, 2)]
    src.write_documents(read(tmp_path / "list.json"), str(tmp_path / "w"))
    src.write_documents(read(tmp_path / "list.json"), str(tmp_path / "w"))
    assert spark.read.json(str(tmp_path / "w")).count() == 2


def test_labelled_csv_and_cleaning(spark, tmp_path):
    (tmp_path / "one.csv").write_bytes(
        " A, B ,Label,Extra\n1,2,BENIGN ,x\n1,2,BENIGN ,x\n1,2,BENIGN ,y\nInfinity,2,Bot,z\n,5,Bot,z\n"
        "3,4,Web \x96 Attack,q\n".encode("latin-1")
    )
    (tmp_path / "two.csv").write_text("B,A,Label\n8,7,DDoS\n")
    (tmp_path / "three.csv").write_text("A,B,Label\n,1,Bot\n,2,Bot\n")
    raw = src.read_labelled_csv(spark, [str(tmp_path / f"{n}.csv") for n in ("one", "two", "three")])
    assert set(raw.columns) == {"file", "A", "B", "Label", "Extra"}
    rows = quality.clean(raw, ["A", "B"]).orderBy("A", "Label").collect()
    got = [(r["file"], r["A"], r["B"], r["Label"]) for r in rows]
    assert got == [
        ("one.csv", 1.0, 2.0, "BENIGN"), ("one.csv", 1.0, 2.0, "BENIGN"),
        ("one.csv", 3.0, 4.0, "Web \x96 Attack"), ("two.csv", 7.0, 8.0, "DDoS"),
    ]
    with pytest.raises(ValueError):
        quality.clean(raw, ["A", "C"])
    src.write_dataset(quality.clean(raw, ["A", "B"]), str(tmp_path / "p"))
    src.write_dataset(quality.clean(raw, ["A", "B"]), str(tmp_path / "c"), csv=True)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 4


def test_packet_lines(spark):
    ok = "1.5|a|b|1|2|||6|100|True|1|0|20|32"
    lines = [
        (ok, True), (ok + "|x", False), (ok.replace("1.5", "t"), False), (ok.replace("|a|", "||"), False),
        (ok.replace("|6|", "|1|"), False), (ok.replace("|100|", "|1.5|"), False),
        ("2|a|b|||5|6|17|60||||" + "|", True),
    ]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(lines)], "n int, value string")
    rows = packets.parse_packets(df).orderBy("n").collect()
    assert [r["valid"] for r in rows] == [v for _, v in lines]
    first, udp = rows[0], rows[-1]
    assert (first["ts_us"], first["syn"], first["ack"], first["push"], first["header_length"]) == (1_500_000, 1, 1, 0, 52)
    assert (udp["protocol"], udp["src_port"], udp["header_length"]) == ("UDP", "5", 20)
    strict = packets.parse_packets(df, strict_flags=True).orderBy("n").first()
    assert (strict["syn"], strict["ack"]) == (1, 0)


def test_packet_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.txt").write_text("1.5|a|b|1|2|||6|100|True|1|0|20|32\nbad\n")
    stream = spark.readStream.text(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    jobs.append_to(packets.accepted(packets.parse_packets(stream)), out, str(tmp_path / "cp")).awaitTermination()
    assert [r["size"] for r in spark.read.parquet(out).collect()] == [100]


def test_distinct_messages(spark, tmp_path):
    jobs.use_rocksdb(spark)
    df = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "message_id bigint, s bigint")
    df.selectExpr("message_id", "timestamp_seconds(s) AS received_at").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("message_id bigint, received_at timestamp").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    jobs.append_to(jobs.distinct_messages(stream), out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["message_id"] for r in spark.read.parquet(out).collect()) == [1, 2]


def plain_groups(rows):
    """rows: (ms, id, severity) in time order"""
    weight = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
    lo, hi = rows[0][0], rows[-1][0]
    pad = 300_000 if hi == lo else (hi - lo) * 0.05
    lo, span = lo - pad, hi - lo + 2 * pad
    out = []
    for t, i, sev in rows:
        pct = (t - lo) / span * 100
        if out and pct - out[-1]["pct"] < 4:
            g = out[-1]
            g["t"].append(t)
            if weight.get(sev, 0) > weight.get(g["sev"], 0):
                g["sev"] = sev
            g["pct"] = (sum(g["t"]) / len(g["t"]) - lo) / span * 100
        else:
            out.append({"id": i, "t": [t], "pct": pct, "sev": sev})
    return [(g["id"], len(g["t"]), g["sev"], pytest.approx(g["pct"])) for g in out]


@pytest.mark.parametrize("n", [1, 2, 150, 260])
def test_timeline_groups(spark, n):
    rng = random.Random(n)
    rows = sorted((rng.randrange(10_000_000), i, rng.choice(["LOW", "HIGH", "MEDIUM", "CRITICAL"])) for i in range(n))
    df = spark.createDataFrame(
        [(t * 1000, k, f"E{i}", s) for k, (t, i, s) in enumerate(rows)],
        "ts_us bigint, seq bigint, event_id string, severity string",
    )
    got = marts.timeline_groups(df, 200).orderBy("position").collect()
    want = plain_groups([(t, f"E{i}", s) for t, i, s in rows][-200:])
    assert [(r["id"], r["n"], r["max_severity"], r["pct"]) for r in got] == want


def test_graph_without_times(spark):
    nodes = spark.createDataFrame([("a", "SOURCE"), ("b", "DESTINATION"), ("c", "SOURCE")], "id string, type string")
    cols = "source string, target string, type string, ts_us bigint, seq bigint"
    untimed = spark.createDataFrame([("a", "b", "DOS", None, 1), ("a", "a", "DOS", None, 2)], cols)
    visible, links = graph.as_of_view(nodes, untimed, 0)
    assert visible.count() == 3 and links.count() == 2
    timed = spark.createDataFrame([("a", "b", "DOS", 5, 1), ("c", "b", "DOS", 50, 2)], cols)
    visible, links = graph.as_of_view(nodes, timed, 10)
    assert {r["id"] for r in visible.collect()} == {"a", "b"} and links.count() == 1
    hidden, links = graph.as_of_view(nodes, timed, 99, ("DESTINATION",))
    assert {r["id"] for r in hidden.collect()} == {"a", "c"} and links.count() == 0
    assert {r["id"]: r["degree"] for r in graph.degrees(untimed).collect()} == {"a": 3, "b": 1}
