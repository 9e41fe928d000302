"""Running values over an order within keys, without a task that holds a whole key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

_PART = "__part"


def scan(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    before: Mapping[str, Column] | None = None,
    seen: Mapping[str, Column] | None = None,
    number: str | None = None,
) -> DataFrame:
    """Append, for the rows of each key in ``order``: ``sums`` (so far, this row included), ``before`` (the value of the row before), ``seen`` (whether an earlier row met the condition), and the row's ``number`` from 1.

    Rows are dealt by ranges of (key, order) and written once, so a key with a third of all rows spreads over a third of
    the ranges. A window runs within each range; what a range starts with comes from a summary of each (key, range).
    Only keys that lie across a bound between ranges have such a carry, one for each bound, so the carries are fewer than the
    shuffle's partitions: small enough to broadcast, whatever the data. Rows that ``order`` cannot tell apart stay in one
    range, in any order. Null keys form one key; null values add nothing; an empty table stays empty. Sums of doubles
    may differ in the last digits with where the ranges lie.
    """
    sums, before, seen = dict(sums or {}), dict(before or {}), dict(seen or {})
    named = {f"__s{i}": c for i, c in enumerate(sums.values())} | {f"__b{i}": c for i, c in enumerate(before.values())} | {f"__m{i}": F.coalesce(c.cast("int"), F.lit(0)) for i, c in enumerate(seen.values())}
    placed = stored(df.select("*", *(c.alias(n) for n, c in named.items())).repartitionByRange(*key, *order).withColumn(_PART, F.spark_partition_id()), "ranges")
    last = F.max_by(F.struct(F.lit(True).alias("held"), *(f"__b{i}" for i in range(len(before)))), F.struct(*order))
    of_range = placed.groupBy(*key, _PART).agg(F.count("*").alias("__rows"), last.alias("__last"), *(F.sum(f"__s{i}").alias(f"__s{i}") for i in range(len(sums))), *(F.max(f"__m{i}").alias(f"__m{i}") for i in range(len(seen))))
    ahead = Window.partitionBy(*key).orderBy(_PART)
    earlier = ahead.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum("__rows").over(earlier).alias("__c_rows"), F.lag("__last").over(ahead).alias("__c_last")]
    carried += [F.sum(f"__s{i}").over(earlier).alias(f"__c_s{i}") for i in range(len(sums))] + [F.max(f"__m{i}").over(earlier).alias(f"__c_m{i}") for i in range(len(seen))]
    carry = of_range.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(key)), F.col(_PART).alias("__p"), *carried).where("__c_rows is not null")
    inside = Window.partitionBy(*key, _PART).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    own = [F.row_number().over(inside).alias("__n")]
    own += [F.sum(f"__s{i}").over(upto).alias(f"__i_s{i}") for i in range(len(sums))] + [F.lag(f"__b{i}").over(inside).alias(f"__i_b{i}") for i in range(len(before))]
    own += [F.max(f"__m{i}").over(inside.rowsBetween(Window.unboundedPreceding, -1)).alias(f"__i_m{i}") for i in range(len(seen))]
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(key)), F.col(_PART) == F.col("__p"))
    joined = placed.select("*", *own).join(F.broadcast(carry), same, "left")
    first = F.col("__n") == 1
    both = lambda a, b: F.when(F.col(a).isNull(), F.col(b)).otherwise(F.col(a) + F.coalesce(F.col(b), F.lit(0)))
    told = [both(f"__i_s{i}", f"__c_s{i}").alias(n) for i, n in enumerate(sums)]
    told += [F.when(first, F.col(f"__c_last.__b{i}")).otherwise(F.col(f"__i_b{i}")).alias(n) for i, n in enumerate(before)]
    told += [(F.greatest(F.coalesce(f"__i_m{i}", F.lit(0)), F.coalesce(f"__c_m{i}", F.lit(0))) == 1).alias(n) for i, n in enumerate(seen)]
    told += [(F.col("__n") + F.coalesce("__c_rows", F.lit(0))).cast("long").alias(number)] if number else []
    return joined.select(*(c for c in df.columns if c not in {*sums, *before, *seen, number}), *told)
