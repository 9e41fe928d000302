"""Intermediate tables in the folder that driver and executors share: they cut lineage and tell their size."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_PATH = "_assayer_stored"
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset, a local folder for a session on one machine, an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="assayer-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/assayer/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@contextmanager
def short_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of whole texts or vectors, while what is planned inside runs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def lower_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lower the Arrow batch for a session that still has a larger one, for results that are planned after the call."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once and return the written rows; a lost executor costs no recomputation of what is behind them.

    Shuffle files behind the written rows are let go as soon as these stand.
    """
    path, spark = folder(df.sparkSession, name), df.sparkSession
    before = spark.conf.get(_CLEANED, None)
    spark.conf.set(_CLEANED, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(_CLEANED) if before is None else spark.conf.set(_CLEANED, before)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.__dict__[_PATH] = path
    return made


def release(*tables: DataFrame | None) -> None:
    """Delete tables that ``stored`` wrote and that nothing reads any more."""
    for t in tables:
        if t is not None and (path := t.__dict__.pop(_PATH, None)):
            place = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
