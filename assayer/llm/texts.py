"""Passing whole texts to numpy code, a few megabytes at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import scratch

#: Bytes of text that are worked on at once.
SLICE_BYTES = 2 << 20

_TEXT = "__text"


def give_back(made=None):
    """Return what Arrow and the C library hold unused to the system, and pass on ``made``: a worker lives on, and serves later stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
    return made


def slices(batch: pa.RecordBatch, lengths: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``most`` bytes of text each; a longer text is a part of its own."""
    start = held = 0
    for i, n in enumerate(lengths.to_pylist()):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def gathered(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in parts of about ``most`` bytes of text, across the bounds of batches."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, pc.binary_length(batch.column(column)), most):
            n = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if held and size + n > most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(part)
            size += n
    if held and sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def utf8(df: DataFrame, text: str) -> Column:
    """A text's bytes (null: none); bytes that aren't UTF-8 become U+FFFD. A binary column is taken as it is."""
    raw = isinstance(df.schema[text].dataType, T.BinaryType)
    return F.coalesce(df[text] if raw else F.make_valid_utf8(df[text]).cast("binary"), F.lit(b""))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, one after another, and where each value begins and the last ends."""
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    _, places, raw = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return held[bounds[0] : bounds[-1]], bounds - bounds[0]


def binary(bounds: np.ndarray, values: np.ndarray) -> pa.Array:
    """A binary column from bytes one after another; the inverse of ``flat``."""
    large = bounds[-1] >= 1 << 31
    kind, width = (pa.large_binary(), np.int64) if large else (pa.binary(), np.int32)
    made = pa.Array.from_buffers(kind, len(bounds) - 1, [None, pa.py_buffer(bounds.astype(width)), pa.py_buffer(np.ascontiguousarray(values))])
    return made


def with_columns(df: DataFrame, work: Callable[[], Callable[[list[bytes]], list[pa.Array]]], schema: str, text: str = "text", drop_text: bool = False) -> DataFrame:
    """Append the columns of ``schema``, computed from whole texts as UTF-8 (null: empty; what isn't UTF-8: U+FFFD).

    ``work()`` is called once in a task and gives the function of the slices. Columns of ``df`` with a name of
    ``schema`` are replaced. ``drop_text`` leaves the text itself out of the result.
    """
    scratch.short_batches(df.sparkSession)
    added = T.StructType.fromDDL(schema)
    kept = [c for c in df.columns if c not in set(added.names) and not (drop_text and c == text)]
    sent = df.select(*(df[c] for c in kept), utf8(df, text).alias(_TEXT))
    names, types = added.names, [f.type for f in to_arrow_schema(added)]
    n_kept = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = work()
        for batch in batches:
            for part in slices(batch, pc.binary_length(batch.column(n_kept))):
                made = function(part.column(n_kept).to_pylist())
                made = [x.cast(t) if x.type != t else x for x, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n_kept], *made], names=[*kept, *names])
        function = batch = part = made = None
        give_back()

    return sent.mapInArrow(run, T.StructType([*(sent.schema[c] for c in kept), *added.fields]))
