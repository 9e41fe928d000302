"""Exact nearest vectors: slices around pivots, and queries that pass by slices which cannot reach their k-th score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stored import release, short_batches, stored

#: Vectors of a slice and queries of a block, at most; pivots, at most; vectors that pivots are chosen from, for each; bins of the angle to a pivot.
SLICE, BLOCK, PIVOTS, LOOKS, BINS = 16_384, 1024, 256, 32, 64
#: A length under this has no direction; what an angle or a score may be off by.
TINY, SLACK = 1e-12, 1e-7


def unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column scaled to length one (a length under TINY counts as that)."""
    rows = np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64) if len(column) else np.zeros((0, 0))
    return rows / np.maximum(np.sqrt((rows * rows).sum(1, keepdims=True)), TINY)


def spread_out(sample: np.ndarray, n: int) -> np.ndarray:
    """At most n of the sample's unit vectors, each the one farthest from those before it."""
    if not len(sample):
        return sample
    chosen, closest = [0], sample @ sample[0]
    while len(chosen) < n and closest.min() < 1 - SLACK:
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, sample @ sample[chosen[-1]])
    return sample[chosen]


@dataclass(frozen=True)
class Slices:
    """Pivots, and for each slice its pivot, the range of its vectors' angles to it, and how many there are. Pivot -1: vectors without a direction."""

    pivots: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    def reach(self, queries: np.ndarray) -> np.ndarray:
        """(queries, slices): the highest cosine that a slice can have with a query, by the triangle inequality of angles."""
        angle = np.arccos(np.clip(queries @ self.pivots.T, -1, 1))[:, self.pivot]
        away = np.maximum(np.maximum(angle - self.high, self.low - angle), 0.0)
        flat = np.abs((queries * queries).sum(1) - 1) > SLACK
        return np.where((self.pivot < 0)[None, :] | flat[:, None], 1.0, np.cos(np.maximum(away - SLACK, 0)))


def _placed(chunks: DataFrame, chunk: str, pivots: np.ndarray) -> DataFrame:
    """(c, v, pivot, angle, bin): the nearest pivot of each vector."""
    out = T.StructType([T.StructField("c", chunks.schema[chunk].dataType), T.StructField("v", chunks.schema["embedding"].dataType), *T.StructType.fromDDL("pivot int, angle double, bin int").fields])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unit(batch.column(1))
            cos = rows @ pivots.T if len(rows) else np.zeros((0, len(pivots)))
            pivot = cos.argmax(1)
            angle = np.arccos(np.clip(cos[np.arange(len(rows)), pivot], -1, 1))
            pivot[np.abs((rows * rows).sum(1) - 1) > SLACK] = -1
            bins = np.minimum((angle * BINS / np.pi).astype(np.int64), BINS - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot, pa.int32()), pa.array(angle), pa.array(bins, pa.int32())], names=out.names)

    return chunks.where("embedding is not null").select(F.col(chunk).alias("c"), F.col("embedding").alias("v")).mapInArrow(place, out)


def _cut(placed: DataFrame, pivots: np.ndarray, most: int) -> tuple[DataFrame, Slices]:
    """``slice`` for each vector: neighbouring bins of a pivot together up to ``most``; a larger bin is dealt over several slices."""
    seen = placed.groupBy("pivot", "bin").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).orderBy("pivot", "bin").collect()
    made: list[list] = []  # pivot, low, high, rows
    where = []  # pivot, bin, first slice, how many
    for r in seen:
        ways = -(-r.n // most)
        if ways == 1 and made and made[-1][0] == r.pivot and made[-1][3] + r.n <= most:
            made[-1][2], made[-1][3] = r.high, made[-1][3] + r.n
        else:
            made += [[r.pivot, r.low, r.high, r.n / ways] for _ in range(ways)]
        where.append((r.pivot, r.bin, len(made) - ways, ways))
    cuts = placed.sparkSession.createDataFrame(where, "pivot int, bin int, first int, ways int")
    dealt = placed.join(F.broadcast(cuts), ["pivot", "bin"]).select("c", "v", (F.col("first") + F.pmod(F.xxhash64("c"), F.col("ways")).cast("int")).alias("s"))
    pivot, low, high, rows = (np.array(x) for x in zip(*made, strict=True))
    return dealt, Slices(pivots, pivot.astype(np.int64), low, high, rows)


def _asked(queries: DataFrame, slices: Slices, first: bool, k: int) -> DataFrame:
    """(b, s, q, v): a query for each slice that it goes to. At first those that reach highest, until they have k vectors; then all others that reach its floor."""
    out = T.StructType([queries.schema["b"], T.StructField("s", T.IntegerType()), queries.schema["q"], queries.schema["v"]])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            reach = slices.reach(unit(batch.column(2)))
            order = np.argsort(-reach, axis=1, kind="stable")
            before = np.cumsum(slices.rows[order], axis=1) - slices.rows[order]
            going = np.zeros(reach.shape, bool)
            np.put_along_axis(going, order, before < 2 * k, axis=1)
            if not first:
                going = ~going & (reach >= batch.column(3).to_numpy()[:, None] - SLACK)
            row, to = np.nonzero(going)
            for a in range(0, len(row), 1000):
                at = pa.array(row[a : a + 1000])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(to[a : a + 1000], pa.int32()), batch.column(1).take(at), batch.column(2).take(at)], names=out.names)

    return queries.select("b", "q", "v", "floor").mapInArrow(ask, out)


def _compared(asked: DataFrame, dealt: DataFrame, k: int, query: T.StructField, chunk: T.StructField) -> DataFrame:
    """(query, chunk, score): the first k of each query in each slice that it goes to; a slice goes to the blocks that ask for it."""
    schema = T.StructType([T.StructField(query.name, query.dataType), T.StructField(chunk.name, chunk.dataType), T.StructField("score", T.DoubleType())])

    def best(own: pa.Table, other: pa.Table) -> pa.Table:
        found = [own["q"].slice(0, 0), other["c"].slice(0, 0), np.zeros(0)]
        if own.num_rows and other.num_rows:
            other = other.take(pc.sort_indices(other["c"]))
            scores = unit(own["v"]) @ unit(other["v"]).T
            order = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(order)), order.shape[1])
            found = [own["q"].take(pa.array(rows)), other["c"].take(pa.array(order.ravel())), scores[rows, order.ravel()]]
        return pa.table({query.name: found[0], chunk.name: found[1], "score": found[2]})

    wanted = asked.select(F.col("b").alias("to"), F.col("s").alias("from")).distinct()
    sent = dealt.join(wanted, F.col("s") == F.col("from")).select("to", "from", "c", "v")
    return asked.groupBy("b", "s").cogroup(sent.groupBy("to", "from")).applyInArrow(best, schema)


def search(queries: DataFrame, chunks: DataFrame, k: int, query: str, chunk: str, slice_rows: int = SLICE, block: int = BLOCK, pivots: int = PIVOTS, tell: list | None = None) -> DataFrame:
    """(query, chunk, score, rank): the exact first k vectors of each of a stated set of queries, by cosine; equal scores (to nine digits) by chunk.

    Vectors go to slices around pivots (far apart in a bounded sample, which bears on speed alone); a slice knows the range of its
    vectors' angles to the pivot. A query visits the slices that may hold its best first; their k-th score is its floor, and of
    the others it visits those that can reach it. Blocks of queries meet slices, both of bounded size, and hand on k rows for each query. Where vectors
    have no structure nothing is passed by, and all are compared. Vectors of one slice skip all this. Null vectors are in no
    ranking; a vector without direction has score 0 with all. ``tell`` gets two numbers: pairs compared, and all pairs.
    """
    kinds = T.StructField(query, queries.schema[query].dataType), T.StructField(chunk, chunks.schema[chunk].dataType)
    there = chunks.where("embedding is not null")
    n, asking = there.count(), queries.where("embedding is not null")
    own = asking.select(F.pmod(F.xxhash64(query), F.lit(max(1, -(-asking.count() // block)))).alias("b"), F.col(query).alias("q"), F.col("embedding").alias("v"))
    tables: list[DataFrame] = []
    if n <= slice_rows:
        dealt = there.select(F.lit(0).alias("s"), F.col(chunk).alias("c"), F.col("embedding").alias("v"))
        asked = own.select("b", F.lit(0).alias("s"), "q", "v")
        found, sizes, asks = _compared(asked, dealt, k, *kinds), np.array([n]), [asked]
    else:
        many = min(pivots, 1 + 4 * n // slice_rows)
        share = min(1.0, LOOKS * many / n)
        some = there.where(F.pmod(F.xxhash64(chunk, F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30))).select("embedding").limit(2 * LOOKS * pivots).toArrow().column(0)
        sample = unit(some)
        far = spread_out(sample[np.abs((sample * sample).sum(1) - 1) <= SLACK] if len(sample) else np.zeros((0, 0)), many)
        with short_batches(chunks.sparkSession):
            placed = stored(_placed(chunks, chunk, far if len(far) else unit(there.limit(1).select("embedding").toArrow().column(0))), "placed")
            cut, slices = _cut(placed, far if len(far) else np.zeros((1, len(sample[0]))), slice_rows)
            dealt = stored(cut, "slices")
            first = stored(_asked(own.withColumn("floor", F.lit(0.0)), slices, True, k), "first")
            one = stored(_compared(first, dealt, k, *kinds), "found")
            place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score")))
            floors = one.withColumn("n", place).where(F.col("n") == k).select(F.col(query).alias("of"), F.col("score").alias("floor"))
            told = own.join(floors, F.col("q") == F.col("of"), "left").withColumn("floor", F.coalesce("floor", F.lit(-1.0)))
            rest = stored(_asked(told, slices, False, k), "rest")
            two = stored(_compared(rest, dealt, k, *kinds), "found")
        found, sizes, asks, tables = one.unionByName(two), slices.rows, [first, rest], [placed, dealt, one, two]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.round("score", 9).desc(), chunk))).where(F.col("rank") <= k)
    if tell is not None:
        went = {}
        for a in asks:
            for r in a.groupBy("s").agg(F.count("*").alias("n")).collect():
                went[r.s] = went.get(r.s, 0) + r.n
        tell += [round(sum(m * float(sizes[s]) for s, m in went.items())), own.count() * n]
    if not tables:
        return ranked
    ranked = stored(ranked, "nearest")
    release(*tables, *asks)
    return ranked
