"""Vectors as short codes: product quantization by Lloyd's rounds in whole numbers, kept up by what changes."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import scratch, vectors

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors of a block, blocks of an Arrow batch; whole numbers reach so far on either side (components of 16,384).
BLOCK, BATCH, REACH = 1024, 16, 1 << 26

_CHANGE = "array<struct<part int, entry int, n long, sums array<long>>>"


def whole(rows: np.ndarray) -> np.ndarray:
    """floor(4096 x) as 32-bit numbers; beyond REACH as REACH."""
    return np.clip(np.floor(rows * SCALE), -REACH, REACH).astype(np.int32)


def nearest(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (rows, parts, width) and codebooks (parts, entries, width): nearest entries, ties to the lower, and squared distances."""
    best = np.full(parts.shape[:2], np.iinfo(np.int64).max)
    codes = np.zeros(parts.shape[:2], np.uint8)
    wide = parts.astype(np.int64)
    for entry in range(books.shape[1]):
        away = wide - books[None, :, entry]
        far = np.einsum("npw,npw->np", away, away)
        closer = far < best
        best[closer], codes[closer] = far[closer], entry
    return codes, best


def changes(parts: np.ndarray, old: np.ndarray | None, new: np.ndarray, entries: int) -> list[dict]:
    """What moved between entries: plus what came and minus what left, for each (part, entry) that either happened to."""
    out = []
    for p in range(parts.shape[1]):
        moved = np.arange(len(parts)) if old is None else np.flatnonzero(old[:, p] != new[:, p])
        rows = parts[moved, p].astype(np.int64)
        n, sums = np.zeros(entries, np.int64), np.zeros((entries, parts.shape[2]), np.int64)
        for codes, sign in ((new[moved, p], 1), *(((old[moved, p], -1),) if old is not None else ())):
            np.add.at(n, codes, sign)
            np.add.at(sums, codes, sign * rows)
        out += [{"part": p, "entry": e, "n": int(n[e]), "sums": sums[e].tolist()} for e in np.flatnonzero((n != 0) | sums.any(1)).tolist()]
    return out


class _Tables:
    """Tables bucketed by block in the shared folder, so that joining them by block shuffles nothing."""

    def __init__(self, df: DataFrame):
        self.spark, self.buckets, self.paths = df.sparkSession, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), {}

    def write(self, df: DataFrame) -> DataFrame:
        name, path = f"codes_{uuid.uuid4().hex}", scratch.folder(self.spark, "codes")
        with scratch.setting(self.spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH)):
            df.write.format("parquet").bucketBy(self.buckets, "block").sortBy("block").option("path", path).saveAsTable(name)
        made = self.spark.table(name)
        self.paths[id(made)] = name, path
        return made

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None:
                name, path = self.paths.pop(id(t))
                self.spark.sql(f"drop table {name}")
                t.__dict__["_assayer_folder"] = path
                scratch.drop(t)


def _blocks(kept: DataFrame, id: str, label: str, vector: str, width: int) -> DataFrame:
    """(block, ids, labels, whole): up to BLOCK vectors of a task in a row."""
    out = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kept.schema[id].dataType)), T.StructField("labels", T.ArrayType(kept.schema[label].dataType)), T.StructField("whole", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made = [], 0, TaskContext.get().partitionId() << 32

        def emit() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids, labels, vs = (rows.column(i).combine_chunks() for i in range(3))
            ends = pa.array([0, len(rows)], pa.int32())
            raw = whole(vectors.matrix(vs, width)).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, labels), pa.array([raw], pa.binary())], names=out.names)

        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                if size + part.num_rows > BLOCK:
                    yield emit()
                    held, size, made = [], 0, made + 1
                held.append(part)
                size += part.num_rows
        if size:
            yield emit()

    return kept.select(id, label, vector).mapInArrow(pack, out)


def compress(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of all vectors without null or non-finite components.

    Components become floor(4096 x); vectors are cut into ``parts`` consecutive parts with a codebook each, which begins
    with the parts of the smallest ids. Vectors are packed into blocks, in a table bucketed by block; a round joins it,
    without a shuffle, with the previous round's codes (a byte for each part, bucketed alike), and writes the new codes and,
    for each block, what came to and left each entry. These changes alone are shuffled and summed, and the driver adds the
    sums (a row for each entry and part) to the running counts and sums that the next codebooks are made of. So a round in
    which few parts move shuffles little, and one in which none moves is the last. All of it is whole numbers: reruns agree.

    Shorter vectors are followed by zeros, and so are all up to a multiple of ``parts``. Components beyond 16,384 count as
    that. Null ids come after all others; of equal ids the smaller vector begins the codebook first; repeated rows count
    each. Fewer vectors than entries make shorter codebooks. Null labels are one label. An empty table stays empty. There
    are at most 256 entries.
    """
    kept, spark = df.where(vectors.finite(vector)).select(id, label, vector), df.sparkSession
    scratch.short_batches(spark)
    length = -(-max(1, vectors.width(kept, vector)) // parts)
    width = length * parts
    first = [r[0] for r in kept.orderBy(F.col(id).asc_nulls_last(), vector).select(vector).limit(entries).collect()]
    k = len(first)
    books = whole(vectors.matrix(pa.array(first, pa.list_(pa.float64())), width)).astype(np.int64).reshape(k, parts, length).transpose(1, 0, 2).copy()
    tables = _Tables(df)
    base, state = tables.write(_blocks(kept, id, label, vector, width).repartition(tables.buckets, "block")), None
    counts, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, length), np.int64)
    for _ in range(rounds if k else 0):

        def step(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                coded, moved = [], []
                for raw, old in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    rows = np.frombuffer(raw, np.int32).reshape(-1, parts, length)
                    new = nearest(rows, books)[0]
                    coded.append(new.tobytes())
                    moved.append(changes(rows, None if old is None else np.frombuffer(old, np.uint8).reshape(-1, parts), new, books.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coded, pa.binary()), pa.array(moved, kind)], names=["block", "codes", "changes"])

        schema = T.StructType.fromDDL(f"block long, codes binary, changes {_CHANGE}")
        kind = to_arrow_schema(schema).field("changes").type
        before = base.select("block", "whole", F.lit(None).cast("binary").alias("codes")) if state is None else base.select("block", "whole").join(state.select("block", "codes").hint("merge"), "block")
        old, state = state, tables.write(before.mapInArrow(step, schema))
        tables.drop(old)
        told = state.select(F.inline("changes")).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(length))).collect()
        if not told:
            break
        for r in told:
            counts[r.part, r.entry] += r.n
            sums[r.part, r.entry] += np.array(r[3:], np.int64)
        books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
    out = T.StructType([T.StructField("id", kept.schema[id].dataType), T.StructField("label", kept.schema[label].dataType), *T.StructType.fromDDL("code string, error long").fields])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(batch.column(2).to_pylist()):
                codes, away = nearest(np.frombuffer(raw, np.int32).reshape(-1, parts, length), books)
                hexed = codes.tobytes().hex()
                told = [hexed[j : j + 2 * parts] for j in range(0, len(hexed), 2 * parts)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, pa.array(told, pa.string()), pa.array(away.sum(1))], names=out.names)

    with scratch.setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH)):
        rows = scratch.cut(base.select("ids", "labels", "whole").mapInArrow(finish, out), "coded")
    tables.drop(base, state)
    by = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return rows.join(by, rows["label"].eqNullSafe(by["of"]), "left").select(F.col("id").alias(id), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
