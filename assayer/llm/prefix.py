"""Running totals over a global order, without a task that holds a whole key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

_PART = "__part"


def same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Equality of the named columns in which null equals null."""
    return reduce(Column.__and__, (left[c].eqNullSafe(right[c]) for c in names))


def running(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, out: str, modulo: int = 1 << 62) -> DataFrame:
    """Add ``out``: the sum, modulo ``modulo``, of the long ``value`` over the rows of the same ``key`` that come before in ``order``.

    Rows are dealt by ranges of (key, order), so a key with a third of all rows spreads over a third of the
    partitions. What a range starts with comes from the per-range sums: a row for each range and each key in it.
    Sums of whole numbers, of 38 digits, make the outcome independent of where the ranges lie. ``order`` should tell rows apart; rows
    it cannot tell apart share their values in any order. Null keys form one key. An empty table stays empty.
    """
    placed = scratch.cut(df.repartitionByRange(*key, *order).withColumn(_PART, F.spark_partition_id()), "ranges")
    keys, wide, none = [*key, _PART], F.col(value).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")
    ahead = Window.partitionBy(*key).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy(*keys).agg(F.sum(wide).alias("__sum")).withColumn("__base", F.pmod(F.coalesce(F.sum("__sum").over(ahead), none), F.lit(modulo)).cast("long")).drop("__sum")
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    told = placed.withColumn("__inside", F.pmod(F.coalesce(F.sum(wide).over(inside), none), F.lit(modulo)).cast("long"))
    joined = told.join(base, same(told, base, keys), "left")
    return joined.select(*(told[c] for c in df.columns), F.pmod(told["__inside"] + base["__base"], F.lit(modulo)).alias(out))
