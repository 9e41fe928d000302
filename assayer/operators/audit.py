"""The hash-chained audit log."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scans import scan


def canonical_json(**fields: Column) -> Column:
    """JSON without blanks, keys in order; null fields are left out."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


def _in_order(value: Column, kind: T.DataType) -> Column:
    """A value whose fields, also those within, are in order of their names; map entries in order of their keys."""
    if isinstance(kind, T.StructType):
        parts = F.struct(*(_in_order(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)))
        return F.when(value.isNotNull(), parts)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _in_order(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), _in_order(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    return value


def entry_json(df: DataFrame, columns: Sequence[str], out: str = "data") -> DataFrame:
    """Append ``out``: the columns as JSON without blanks, with keys in order at every depth, the same wherever and however often it is made.

    This is what an entry's hash is made of. Null fields are left out.
    """
    kinds = {c: df.schema[c].dataType for c in columns}
    return df.withColumn(out, F.to_json(F.struct(*(_in_order(F.col(c), kinds[c]).alias(c) for c in sorted(columns)))))


def read_entries(df: DataFrame, schema: str | T.StructType, data: str = "data") -> DataFrame:
    """Entries with the fields that ``entry_json`` has written, as columns again; fields that the text lacks are null, as are all where it isn't JSON."""
    return df.withColumn("__read", F.from_json(data, schema)).select(*df.columns, "__read.*")


def build_chain(df: DataFrame, key: str, seq: str, data: str) -> DataFrame:
    """Append previous_hash ('' at first) and entry_hash = sha256(previous_hash + data), a chain for each key in order of ``seq``.

    Rows are dealt by key and sorted; a task goes through them once and holds the last hash alone. A chain can't be split,
    since each entry needs the one before: chain by session. Null data count as empty text; rows with a null key are one chain.
    """
    kept = [df.schema[c] for c in df.columns if c not in ("previous_hash", "entry_hash")]
    out = T.StructType([*kept, T.StructField("previous_hash", T.StringType()), T.StructField("entry_hash", T.StringType())])
    sent = df.select(*(f.name for f in kept)).repartition(key).sortWithinPartitions(key, seq)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, last = None, None
        for batch in batches:
            before, after = [], []
            for k, d in zip(batch.column(names.index(key)).to_pylist(), batch.column(names.index(data)).to_pylist(), strict=True):
                last = last if last is not None and k == owner else ""
                owner = k
                before.append(last)
                last = hashlib.sha256((last + (d or "")).encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*names, "previous_hash", "entry_hash"])

    return sent.mapInArrow(run, out)


def verify_chain(df: DataFrame, key: str, seq: str, data: str, first_empty: bool = True) -> DataFrame:
    """(key, entries, valid, first_bad): whether each entry's hash is right and names its predecessor's.

    ``first_empty`` also asks that a chain begins with an empty previous hash. An entry without a hash, or without the previous one, is bad.
    A session of any size is spread over many tasks: each entry is checked by itself, its predecessor's hash comes from a scan.
    """
    told = scan(df, [key], [seq], before={"__before": F.col("entry_hash")}, number="__number")
    linked = F.when(F.col("__number") == 1, F.col("previous_hash") == "" if first_empty else F.lit(True)).otherwise(F.col("previous_hash") == F.col("__before"))
    good = F.coalesce((F.col("entry_hash") == F.sha2(F.concat("previous_hash", F.coalesce(F.col(data), F.lit(""))), 256)) & linked, F.lit(False))
    return told.withColumn("__good", good).groupBy(key).agg(F.count("*").alias("entries"), F.bool_and("__good").alias("valid"), F.min(F.when(~F.col("__good"), F.col(seq))).alias("first_bad"))


def provenance(df: DataFrame, key: str, seq: str, match: Column) -> DataFrame:
    """A session's entries up to and including the first match; all of them if nothing matches."""
    return scan(df, [key], [seq], seen={"__earlier": match}).where(~F.col("__earlier")).drop("__earlier")


def usd(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Dollars of a call, from its tokens and the prices of a million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def cost(df: DataFrame, key: str, seq: str, cost: Column, budget: float) -> DataFrame:
    """Append ``spent`` (so far, this call included) and ``over`` (more than the budget)."""
    return scan(df, [key], [seq], sums={"spent": cost}).withColumn("over", F.col("spent") > budget)
