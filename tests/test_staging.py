"""Staged tables go with their block."""

import glob

from sentrel.functions.staging import materialise, staging, staging_dir


def test_tables_of_a_block_are_deleted(spark, tmp_path):
    folder = f"{staging_dir(spark)}/sentrel-*"
    before = set(glob.glob(folder))
    with staging(spark):
        kept = materialise(spark.range(3))
        with staging(spark):
            inner = materialise(spark.range(5))
            assert inner.count() == 5
        assert kept.count() == 3
        kept.write.parquet(str(tmp_path / "out"))
        assert len(set(glob.glob(folder)) - before) == 1
    assert set(glob.glob(folder)) == before
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_scratch_folders_go_with_their_block(spark):
    import os

    from sentrel.functions.staging import scratch, staging

    with staging(spark):
        path = scratch(spark, "trial")
        spark.range(3).write.parquet(path)
        assert os.path.isdir(path)
    assert not os.path.exists(path)
    other = scratch(spark, "trial")
    assert other != path and not os.path.exists(other)
