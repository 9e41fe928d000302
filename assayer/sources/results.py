"""Stored results whose rerun replaces the rows of its keys, all at once or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the manifests that were written to their end."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    found = [f.getPath() for f in files.listStatus(place)]
    return sorted(int(p.getName().removeprefix("v=")) for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _manifest(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest/v={version}")


def replace_results(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Store rows in place of all stored rows with the same ``keys``; rows of other keys stay.

    Rows go to a folder of this run first. Then a new manifest names, for each key, the run whose rows hold; it counts once it is
    written to its end. So a run that fails on the way leaves what was there, and readers see the old rows or the new
    ones. Two runs that end at once can't both write the same manifest: the later one fails, and its rows don't count. Null
    keys are a key like any other. What no manifest names any more may be deleted by hand.
    """
    spark, run = df.sparkSession, uuid.uuid4().hex
    known = _versions(spark, path)
    df.write.parquet(f"{path}/runs/run={run}")
    made = spark.read.schema(df.schema).parquet(f"{path}/runs/run={run}").select(*keys).distinct().withColumn("run", F.lit(run))
    if known:
        old = _manifest(spark, path, known[-1])
        same = [old[k].eqNullSafe(made[k]) for k in keys]
        made = old.join(made, same, "left_anti").unionByName(made)
    version = (known[-1] if known else 0) + 1
    spark.createDataFrame([(df.schema.json(),)], "columns string").coalesce(1).write.mode("overwrite").json(f"{path}/columns/v={version}")
    made.write.mode("errorifexists").parquet(f"{path}/manifest/v={version}")


def read_results(spark: SparkSession, path: str, keys: Sequence[str], version: int | None = None) -> DataFrame:
    """The rows that hold by the last manifest, or by an earlier one; columns are those of its run, null in rows that lack them."""
    known = _versions(spark, path)
    if not known:
        raise AnalysisException(f"no results at {path}")
    version = known[-1] if version is None else version
    holds = _manifest(spark, path, version)
    columns = T.StructType.fromJson(json.loads(spark.read.json(f"{path}/columns/v={version}").first().columns))
    runs = [f"{path}/runs/run={r.run}" for r in holds.select("run").distinct().collect()]
    if not runs:
        return spark.createDataFrame([], columns)
    rows = spark.read.schema(T.StructType([*columns, T.StructField("run", T.StringType())])).option("basePath", f"{path}/runs").parquet(*runs)
    return rows.join(holds, [rows["run"] == holds["run"], *(rows[k].eqNullSafe(holds[k]) for k in keys)], "left_semi").drop("run")
