"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_KEPT_FILES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Rows in an Arrow batch. Texts can be long, and a batch is held whole in memory.
BATCH_ROWS = 1000


def folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Without that setting a session on one machine (tests) gets a local folder;
    on a cluster it is an error, since executors could not see each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="assayer-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/assayer/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def short_batches(spark: SparkSession) -> None:
    """Lower the Arrow batch for sessions that still have a larger one."""
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS or int(spark.conf.get(_BATCH)) <= 0:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the written rows.

    The written table replaces the lineage, so a lost executor costs no recomputation upstream, and the
    shuffle files behind it are let go as soon as it stands.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    with setting(spark, _KEPT_FILES, "true"):
        df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.__dict__["_assayer_folder"] = path
    return made


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that ``cut`` wrote and that nothing reads any more."""
    for t in tables:
        if t is not None and (path := t.__dict__.pop("_assayer_folder", None)):
            place = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
