"""Evidence and detection method travel from events through incidents into reports."""

from pyspark.sql import functions as F

from sentrel.operators import incidents, reports
from sentrel.plans.adapters import sec_events


def test_evidence_and_method_reach_the_report(spark):
    evidence = F.struct(F.lit("BY HAND").alias("detection_method"), F.col("dst_port").alias("dst_port"))
    events = sec_events(spark, "/root/testdata/sf0.001").withColumn("evidence", evidence)
    found, _ = incidents.correlate(events, 21_600)
    kept = found.where("type = 'UNKNOWN_BEHAVIOR'")
    assert kept.count() > 0 and kept.where("detection_method = 'BY HAND' AND evidence LIKE '%BY HAND%'").count() == kept.count()
    told = reports.narratives(kept.withColumn("timeline_length", F.lit(1)))
    text = " ".join(str(v) for v in told.first())
    assert "BY HAND" in text


def test_events_without_evidence_have_none(spark):
    found, _ = incidents.correlate(sec_events(spark, "/root/testdata/sf0.001"), 21_600)
    assert found.where("evidence IS NOT NULL").count() == 0
    # The correlation rules name their own method; a pattern without one has none.
    assert found.where("(type = 'UNKNOWN_BEHAVIOR') <> (detection_method IS NULL)").count() == 0
