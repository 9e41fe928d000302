"""Nested clinical records: bundles, newline-delimited resources, saved runs, audit and debate tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codings import CONCEPT

PERIOD = "struct<start: string, end: string>"
REFERENCE = "struct<reference: string>"
QUANTITY = "struct<value: double, unit: string, code: string>"
#: A coded concept, or one behind a reference to it.
CODED = f"struct<concept: {CONCEPT}, reference: {REFERENCE}, coding: array<struct<system: string, code: string, display: string>>, text: string>"
#: DDL of a resource: the fields that any of the operators reads, of both record versions.
RESOURCE = (
    f"resourceType string, id string, status string, identifier array<struct<system: string, value: string>>, name array<struct<use: string, family: string, given: array<string>>>, gender string, birthDate string, "
    f"deceasedBoolean boolean, deceasedDateTime string, subject {REFERENCE}, encounter {REFERENCE}, code {CONCEPT}, type array<{CONCEPT}>, clinicalStatus {CONCEPT}, period {PERIOD}, actualPeriod {PERIOD}, "
    f"onsetDateTime string, effectiveDateTime string, issued string, authoredOn string, performedDateTime string, performedPeriod {PERIOD}, valueString string, valueCodeableConcept {CONCEPT}, "
    f"valueQuantity {QUANTITY}, component array<struct<code: {CONCEPT}, valueQuantity: {QUANTITY}>>, class string, medication {CODED}, reason array<{CODED}>, participant array<struct<individual: struct<display: string>>>, referenceRange array<struct<low: struct<value: double>, high: struct<value: double>>>, reasonCode array<{CONCEPT}>, "
    f"medicationReference {REFERENCE}, medicationCodeableConcept {CONCEPT}, dosageInstruction array<struct<text: string, doseAndRate: array<struct<doseQuantity: {QUANTITY}>>>>, title string, date string, "
    f"content array<struct<attachment: struct<contentType: string, data: string>>>, context struct<encounter: array<{REFERENCE}>>"
)


def read_bundles(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(file, patient_id, pos, resource): the entries of bundle files, in order. The first patient of a file is its patient.

    Files without a patient give no rows; with ``strict`` they are an error.
    """
    read = spark.read.option("multiLine", True).schema(f"entry array<struct<resource: struct<{_nested(RESOURCE)}>>>").json(path).withColumn("file", F.input_file_name())
    own = read.withColumn("patients", F.filter("entry", lambda e: e["resource"]["resourceType"] == "Patient")).withColumn("found", F.coalesce(F.size("patients"), F.lit(0)) > 0)
    if strict and (bad := own.where(~F.col("found")).select("file").limit(5).collect()):
        raise ValueError(f"no patient in {', '.join(r.file for r in bad)}")
    return own.where("found").select("file", F.col("patients")[0]["resource"]["id"].alias("patient_id"), F.posexplode("entry").alias("pos", "entry")).select("file", "patient_id", "pos", F.col("entry.resource").alias("resource"))


def _nested(ddl: str) -> str:
    from pyspark.sql import types as T

    return T.StructType.fromDDL(ddl).simpleString()[len("struct<") : -1]


def read_resources(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The resources of newline-delimited files (gzip or not) under one schema; missing files are empty."""
    frames = []
    for p in paths:
        try:
            frames.append(spark.read.schema(RESOURCE).json(p))
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
    out = spark.createDataFrame([], RESOURCE)
    for f in frames:
        out = out.unionByName(f)
    return out


def read_pairs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of question pairs, trajectories or triplets."""
    return spark.read.schema(schema).json(path)


def flatten_runs(runs: DataFrame, results: str = "rag_results") -> DataFrame:
    """(patient_id, query_index, result): a row for each answer of saved runs that has no error; positions count errors too."""
    patients = runs.select(F.explode("patient_results").alias("p"))
    rows = patients.select(F.col("p.patient_id").alias("patient_id"), F.posexplode(F.col(f"p.{results}")).alias("query_index", "result"))
    return rows.where(F.col("result.error").isNull())


def append(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Append rows to a table of audit entries or debates (parquet), or to a results folder (json)."""
    df.write.mode("append").format(kind).save(path)


def write_report(results: DataFrame, metrics: DataFrame, path: str) -> None:
    """Scored results as a report: JSON lines of ``model_metrics`` (a model each) and of ``per_result`` without answers' texts and citations.

    Each is a folder below ``path``, replaced as a whole, so that results of any number are written by many tasks.
    """
    for name, df in (("model_metrics", metrics), ("per_result", results.drop("answer_text", "citations"))):
        df.write.mode("overwrite").json(f"{path}/{name}")


def read_report(spark: SparkSession, path: str, results: str, metrics: str) -> tuple[DataFrame, DataFrame]:
    """(per_result, model_metrics) of a written report, by their schemas."""
    return spark.read.schema(results).json(f"{path}/per_result"), spark.read.schema(metrics).json(f"{path}/model_metrics")


def write_debate(tables: dict[str, DataFrame], path: str) -> None:
    """The four tables of a debate, each appended below ``path``."""
    for name in ("debate_queries", "debate_claims", "debate_challenges", "debate_judge_verdicts"):
        append(tables[name], f"{path}/{name}")


def patients(df: DataFrame) -> DataFrame:
    """(patient_id, family, gender, birth_date, full_name, deceased): the family name, or the id without one; deceased if a flag or a date says so."""
    name = F.try_element_at("name", F.lit(1))
    gender = F.when(F.col("gender").isin("male", "female", "other", "unknown"), F.col("gender")).otherwise("unknown")
    full = F.nullif(F.trim(F.concat_ws(" ", F.concat_ws(" ", name["given"]), name["family"])), F.lit(""))
    return df.where("resourceType = 'Patient'").select(
        F.col("id").alias("patient_id"), F.coalesce(name["family"], F.col("id")).alias("family"), gender.alias("gender"), F.col("birthDate").try_cast("date").alias("birth_date"),
        full.alias("full_name"), (F.coalesce("deceasedBoolean", F.lit(False)) | F.col("deceasedDateTime").isNotNull()).alias("deceased"),
    )
