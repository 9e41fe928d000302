"""What a record says is true: entity sets of patients, and statistics of runs against them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import filters, metrics, records


def recent_conditions(conditions: DataFrame, encounters: DataFrame) -> DataFrame:
    """(patient_id, entity, code): conditions of each patient's latest encounter; of all encounters if it has none.

    Reads patient_id, encounter_id, display, code, and start of encounters; of equal starts the smallest id is the latest.
    """
    last = encounters.groupBy("patient_id").agg(F.max_by("encounter_id", F.struct("start", (-F.col("encounter_id")).alias("i"))).alias("__last"))
    recent = F.coalesce(F.col("encounter_id") == F.col("__last"), F.lit(False))
    # one pass over the joined rows; a patient's distinct conditions are few
    each = conditions.join(last, "patient_id", "left").groupBy("patient_id", F.col("display").alias("entity"), "code").agg(F.bool_or(recent).alias("__recent"))
    some = F.max("__recent").over(Window.partitionBy("patient_id"))
    return each.withColumn("__some", some).where(F.col("patient_id").isNotNull() & (F.col("__recent") | ~F.col("__some"))).select("patient_id", "entity", "code")


def lab_entities(labs: DataFrame, kidney: bool = False) -> DataFrame:
    """(patient_id, entity, name): 'name value unit' of each lab's latest value; of all kidney values if asked for.

    Reads patient_id, display, value, unit, date, pos.
    """
    rows = labs.where(filters.named_like(F.col("display"))) if kidney else records.latest(labs, ["patient_id", "display"], "date", "pos")
    shown = F.when(F.col("value").isNotNull(), F.concat_ws(" ", "display", F.col("value").cast("string"), "unit")).otherwise(F.col("display"))
    return rows.select("patient_id", shown.alias("entity"), F.col("display").alias("name"))


def all_entities(*frames: DataFrame) -> DataFrame:
    """(patient_id, entity): the distinct union of several kinds."""
    out = frames[0].select("patient_id", "entity")
    for f in frames[1:]:
        out = out.unionByName(f.select("patient_id", "entity"))
    return out.distinct()


def run_stats(results: DataFrame, by: str) -> DataFrame:
    """Counts, mean and upper median latency, abstention rate, citation coverage, scores above their sentinels, verdicts.

    Reads error (null: none), latency_ms, n_citations, verdict, judge_score (> 0 counts), faithfulness (>= 0 counts).
    """
    ok = F.col("error").isNull()
    verdicts = results.groupBy(by, F.coalesce("verdict", F.lit("unknown")).alias("v")).agg(F.count("*").alias("n")).groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("v", "n")))).alias("verdicts"))
    held = F.when(ok, F.col("latency_ms"))
    told = results.withColumn("__latency", held).groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(~ok).alias("errors"), F.round(F.avg("__latency")).alias("avg_latency_ms"), metrics.upper_median("__latency").alias("median_latency_ms"),
        F.round(F.count_if(F.coalesce(F.col("verdict") == "abstained", F.lit(False))) / F.count("*"), 3).alias("abstention_rate"), F.round(F.count_if(ok & (F.col("n_citations") > 0)) / F.greatest(F.count_if(ok), F.lit(1)), 3).alias("citation_coverage"),
        F.round(F.avg(F.when(F.col("judge_score") > 0, F.col("judge_score"))), 2).alias("quality"), F.round(F.avg(F.when(F.col("faithfulness") >= 0, F.col("faithfulness"))), 4).alias("faithfulness"),
    )
    return told.join(verdicts, by)


def saved_run_summary(results: DataFrame, unanswerable: Sequence[int]) -> DataFrame:
    """One row of a saved run: counts, means, abstention accuracy at the positions of unanswerable queries, citation coverage.

    Reads query_index (errors count), error (null: none), latency_ms, judge_score (> 0 counts), faithfulness (>= 0 counts), answer_text,
    n_citations and verdict. A mean without values is 0.
    """
    ok, asked = F.col("error").isNull(), F.col("query_index").isin(list(unanswerable))
    mean = lambda c, digits, cond=None: F.coalesce(F.round(F.avg(F.when(ok if cond is None else ok & cond, c)), digits), F.lit(0.0))
    share = lambda a, b: F.coalesce(F.round(F.count_if(a) / F.nullif(F.count_if(b), F.lit(0)), 3), F.lit(0.0))
    return results.agg(
        F.count("*").alias("count"), F.count_if(~ok).alias("errors"), mean(F.col("latency_ms"), 0).alias("avg_latency_ms"), mean(F.col("judge_score"), 2, F.col("judge_score") > 0).alias("avg_quality"),
        mean(F.col("faithfulness"), 4, F.col("faithfulness") >= 0).alias("avg_faithfulness"), mean(F.length("answer_text"), 0).alias("avg_answer_length"),
        share(asked & F.coalesce(F.col("verdict") == "abstained", F.lit(False)), asked).alias("abstention_accuracy"), share(ok & (F.col("n_citations") > 0), ok).alias("citation_coverage"),
    )


def union_results(*frames: DataFrame) -> DataFrame:
    """Results of several runs under each other; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def verdict_matrix(pairs: DataFrame, expected: Column, predicted: Column) -> DataFrame:
    """(expected, APPROVED, REVISED, ABSTAINED, UNKNOWN, accuracy): predicted verdicts by expected ones; others count as UNKNOWN."""
    known = ["APPROVED", "REVISED", "ABSTAINED"]
    p = F.when(predicted.isin(known), predicted).otherwise("UNKNOWN")
    rows = pairs.select(expected.alias("expected"), p.alias("p")).where(F.col("expected").isin(known))
    return rows.groupBy("expected").agg(*(F.count_if(F.col("p") == v).alias(v) for v in (*known, "UNKNOWN")), F.avg((F.col("p") == F.col("expected")).cast("double")).alias("accuracy"))


def relevance(answer: Column, terms: Column) -> Column:
    """Share of the expected terms that an answer contains, in any case; 1 without terms."""
    hits = F.size(F.filter(terms, lambda t: F.contains(F.lower(answer), F.lower(t))))
    return F.when(F.size(terms) == 0, 1.0).otherwise(hits / F.size(terms))
