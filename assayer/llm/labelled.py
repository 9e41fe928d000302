"""Which documents teach a classifier, and which only test it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves no remainder mod FOLDS. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def lessons(docs: DataFrame, labels: DataFrame, label: str, most: int, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, text, label): at most ``most`` labelled documents to learn from, those with the smallest hashed ids.

    Held-out ids, null labels and null ids teach nothing. Of several labels of one id the largest counts; of several
    rows of one id the text with the smallest hash is the lesson (a null text is like any other), so there are no more lessons
    than ids. The ids are bounded, so their join may be broadcast.
    """
    known = labels.where(~held_out(id) & F.col(label).isNotNull()).groupBy(id).agg(F.max(label).cast("int").alias("__label"))
    chosen = known.orderBy(F.xxhash64(F.col(id).cast("long")), id).limit(most).select(F.col(id).alias("__id"), "__label")
    rows = docs.select(F.col(id).alias("__own"), F.col(text).alias("text"))
    found = rows.join(F.broadcast(chosen), F.col("__own") == F.col("__id")).groupBy(F.col("__own").alias("id")).agg(F.min_by(F.struct("text", F.col("__label").alias("label")), F.xxhash64("text")).alias("__row"))
    return found.select("id", "__row.text", "__row.label")


