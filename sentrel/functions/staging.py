"""Results that several steps share are written once to the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_scopes: list[list[str]] = []


def staging_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one in local mode if that is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if sc.applicationId not in _local:
        path = tempfile.mkdtemp(prefix="sentrel-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _local[sc.applicationId] = path
    return _local[sc.applicationId]


def scratch(spark: SparkSession, name: str) -> str:
    """Path of a folder of its own under the staging folder, deleted with the ``staging`` block around it."""
    path = f"{staging_dir(spark)}/sentrel-{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write the rows and read them back: no recomputation, no lost-executor reruns.

    Unlike a cache the table survives executors, and unlike a checkpoint it is columnar, so
    later steps still prune columns and the planner knows its size.
    """
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/sentrel-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside the block are deleted at its end, so results must be written before.

    ``with staging(spark): report(...).write.parquet(path)``. Blocks may be nested.
    """
    _scopes.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for name in _scopes.pop():
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
