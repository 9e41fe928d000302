"""Scope, lookups and what is let into an index."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import scan

#: Words in the names of laboratory values of the kidney.
KIDNEY = ["creatinine", "bun", "urea nitrogen", "gfr", "glomerular", "egfr", "cystatin", "uric acid", "potassium", "bicarbonate", "anion gap", "phosphate", "calcium"]


def not_blank(df: DataFrame, body: str = "text") -> DataFrame:
    return df.where(F.trim(F.coalesce(F.col(body), F.lit(""))) != "")


def named_like(name: Column, words: list[str] = KIDNEY) -> Column:
    """Whether a name contains any of the words, in any case."""
    return reduce(Column.__or__, (F.contains(F.lower(name), F.lit(w)) for w in words))


def timeline(events: DataFrame, time: str, start: Column | None = None, end: Column | None = None, kind: Column | None = None) -> DataFrame:
    """Events in a range (both ends belong to it, each may be left out), of one kind if asked for."""
    out = events
    for cond in (None if start is None else F.col(time) >= start, None if end is None else F.col(time) <= end, kind):
        out = out if cond is None else out.where(cond)
    return out


def timeline_order(events: DataFrame, key: str, time: str, ties: Sequence[str] = ()) -> DataFrame:
    """Append ``position`` (from 1): an event's place in its patient's timeline, by time and ``ties``; events without a time come first.

    A scan over ranges, so that a patient with a third of all events is no single task.
    """
    return scan(events, [key], [time, *ties], number="position")


def scoped(requests: DataFrame, patients: DataFrame, key: str = "patient_id") -> DataFrame:
    """Append ``status``: 200 for a loaded patient, 422 for one that isn't or is missing, 400 for an unreadable request.

    Reads ``body_ok``. Every request gets a status; none is dropped.
    """
    known = patients.select(F.col(key).alias("__known")).distinct()
    joined = requests.join(known, requests[key] == F.col("__known"), "left")
    return joined.withColumn("status", F.when(~F.col("body_ok"), 400).when(F.col("__known").isNull(), 422).otherwise(200)).drop("__known")


def audit_entries(log: DataFrame, session: str | None = None, patient: str | None = None) -> DataFrame:
    """Entries of a session or a patient; ``seq`` is their order."""
    out = log if session is None else log.where(F.col("session_id") == session)
    return out if patient is None else out.where(F.col("patient_id") == patient)


def indexable(chunks: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    """Chunks whose vector has the dimension, and the others."""
    ok = F.coalesce(F.size("embedding") == dimension, F.lit(False))
    return chunks.where(ok), chunks.where(~ok)


def segments(df: DataFrame, id: str, body: str = "text", size: int = 500, most: int = 5000) -> DataFrame:
    """(id, at, segment): a record's first ``most`` characters in pieces of ``size``, as sources to compare an answer with."""
    held = df.select(id, F.substring(body, 1, most).alias("t")).where(F.length("t") > 0)
    return held.select(id, "t", F.explode(F.sequence(F.lit(0), F.length("t") - 1, F.lit(size))).alias("at")).select(id, "at", F.substr("t", F.col("at") + 1, F.lit(size)).alias("segment"))
