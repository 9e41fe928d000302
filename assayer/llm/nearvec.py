"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within them, components of the links."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import components, scratch, texts, vectors, vptree

#: Vectors of a cell (about), cells at most, sampled vectors for each cell, k-means rounds, vectors that a product's one side has at most.
CELL, MOST_CELLS, SAMPLED, ROUNDS, BLOCK = 1024, 4096, 32, 5, 4096
#: Standard deviations of a link's step across a cell's bound that each of its two vectors covers.
MARGIN = 2.5
#: What angles may be off by; groups that what is known without comparison is spread over.
SLACK, SPREAD = 1e-6, 1 << 12


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay."""
    largest = np.abs(rows).max(1, initial=0, keepdims=True)
    rows = rows / np.where(largest > 0, largest, 1)
    length = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.where(length > 0, length, 1)


def centroids(sample: np.ndarray, k: int, apart: float) -> np.ndarray:
    """At most k unit vectors: Lloyd's rounds by cosine, from seeds of the sample of which no two are within the cosine ``apart``, so that a tight group has one."""
    closest, seeds = np.full(len(sample), -2.0), []
    for i in range(len(sample)):
        if len(seeds) == k:
            break
        if closest[i] < apart:
            seeds.append(i)
            closest = np.maximum(closest, sample @ sample[i])
    own = sample[seeds]
    for _ in range(ROUNDS):
        home = (sample @ own.T).argmax(1)
        sums = np.zeros_like(own)
        np.add.at(sums, home, sample)
        moved = np.sqrt((sums * sums).sum(1)) > 1e-9
        own = np.where(moved[:, None], unit(sums), own)
    return own


@dataclass(frozen=True)
class Cells:
    """Centroids, and what lies near each: ``core`` vectors are within half the linking angle of it, so any two of them are linked."""

    centre: np.ndarray
    angle: float
    step: float
    weight: np.ndarray | None = None
    radius: np.ndarray | None = None
    first: np.ndarray | None = None

    def home(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest centroid's cell, the angle to it, and whether the vector is of the cell's core."""
        cos = rows @ self.centre.T
        cell = cos.argmax(1)
        away = np.arccos(np.clip(cos[np.arange(len(rows)), cell], -1, 1))
        return cell, away, away <= self.angle / 2 - SLACK

    def cores(self, rows: np.ndarray, cell: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cells) twice: all of the cell's core is linked with the vector; some of it may be."""
        away = np.arccos(np.clip(rows @ self.centre.T, -1, 1))
        other = np.broadcast_to(self.weight > 0, away.shape).copy()
        other[np.arange(len(rows))[core], cell[core]] = False
        surely = other & (away + self.radius <= self.angle - SLACK)
        return surely, other & ~surely & (away - self.radius <= self.angle + SLACK)

    def visits(self, rows: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """(rows, cells): whose bound with the vector's own cell is within ``step``; not the own cell."""
        cos = rows @ self.centre.T
        gap = np.sqrt(np.maximum(2 - 2 * self.centre @ self.centre.T, 0))[cell]
        near = cos[np.arange(len(rows)), cell][:, None] - cos <= self.step * gap
        near[np.arange(len(rows)), cell] = False
        return near


def _held(df: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """mapInArrow over batches of some megabytes of vectors."""
    scratch.short_batches(df.sparkSession)
    return df.select(*columns).mapInArrow(work, schema)


def _keyed(valid: DataFrame, width: int) -> DataFrame:
    """(id, key, unit): a vector's 128-bit name and the vector scaled to length one; zero vectors go."""
    out = T.StructType([valid.schema["id"], *T.StructType.fromDDL("key binary, unit binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = vectors.matrix(batch.column(1), width)
            units = unit(rows) + 0.0
            full = np.flatnonzero(units.any(1))
            rows = rows[full] + 0.0  # no negative zeros
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full)), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in rows], pa.binary()), pa.array([x.tobytes() for x in units[full]], pa.binary())], names=["id", "key", "unit"])

    return _held(valid, ["id", "vector"], run, out)


def _units(column: pa.Array, width: int) -> np.ndarray:
    return texts.flat(column)[0].view(np.float64).reshape(len(column), width) if len(column) else np.zeros((0, width))


def _asked(placed: DataFrame, cells: Cells, width: int, split: dict[tuple[int, bool], int], block: int) -> DataFrame:
    """Rows dealt to groups (cell, core or rest, block): their homes, and those who ask them. ``kind``: 0 at home, 1 another block's, 2 a rest vector of another cell,
    3 a core vector of another cell; -1 carries what is known without comparison: ``weight`` for the node, or for the core of ``cell``, or a link from node to ``other``."""
    n_cells, names = len(cells.centre), ["group", "kind", "node", "weight", "cell", "visits", "other", "unit"]
    blocks = {g: -(-n // block) for g, n in split.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, weight, cell, core = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            rows = _units(batch.column(4), width)
            surely, maybe = cells.cores(rows, cell, core)
            near = cells.visits(rows, cell) & ~core[:, None]
            made: list[tuple] = []
            for i in range(len(rows)):
                at, kind = int(cell[i]), bool(core[i])
                n, asks, known_group = blocks[at, kind], np.flatnonzero(near[i]), -1 - int(node[i]) % SPREAD
                own = int(node[i]) * 0x9E3779B97F4A7C15 % (1 << 64) % n

                def send(to: int, to_core: bool, b: int, what: int, i=i, asks=asks, at=at) -> None:
                    made.append(((to * 2 + to_core) << 32 | b, what, int(node[i]), int(weight[i]), at, asks.tolist(), 0, i))

                send(at, kind, own, 0)
                known = 0
                if kind:  # of its own core all are linked
                    known += int(cells.weight[at]) - int(weight[i])
                    if node[i] != cells.first[at]:
                        made.append((known_group, -1, int(node[i]), 0, -1, [], int(cells.first[at]), -1))
                else:
                    for b in range(n):  # of two blocks one asks the other
                        if b != own and (own < b) == ((own + b) % 2 == 0):
                            send(at, False, b, 1)
                    for to in asks.tolist():
                        for b in range(blocks.get((to, False), 0)):
                            send(to, False, b, 2)
                for to in np.flatnonzero(surely[i]).tolist():
                    known += int(cells.weight[to])
                    made.append((known_group, -1, int(node[i]), 0, -1, [], int(cells.first[to]), -1))
                    if not kind:
                        made.append((known_group, -1, -1, int(weight[i]), to, [], -1, -1))
                for to in np.flatnonzero(maybe[i]).tolist():
                    for b in range(blocks[to, True]):
                        send(to, True, b, 3 if kind else 2)
                if known:
                    made.append((known_group, -1, int(node[i]), known, -1, [], -1, -1))
            columns = list(zip(*made, strict=True))
            for a in range(0, len(made), 1 << 13):
                part = [c[a : a + (1 << 13)] for c in columns]
                arrays = [pa.array(c, t) for c, t in zip(part[:7], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([rows[i].tobytes() if i >= 0 else b"" for i in part[7]], pa.binary())], names=names)

    assert n_cells < 1 << 30
    return _held(placed, ["node", "weight", "cell", "core", "unit"], deal, "group long, kind int, node long, weight long, cell long, visits array<int>, other long, unit binary")


def _met(dealt: DataFrame, similarity: float, width: int) -> DataFrame:
    """(node, other, n): with ``other``, a link; else so many linked vectors more for the node. Links are enough to connect what all found ones connect.

    A task goes through its groups one after another: those at home come first and stay, those who ask pass by in batches.
    """
    out = "node long, other long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, home, degree = None, None, None

        def told(node, other, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(other, pa.int64(), from_pandas=False), pa.array(n, pa.int64())], names=["node", "other", "n"])

        def degrees(node: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            node, n = node[n > 0], n[n > 0]
            return told(node, pa.nulls(len(node), pa.int64()), n)

        def pairs(a: dict, b: dict, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for i in range(0, len(a["node"]), 512):
                x, y = np.nonzero(a["unit"][i : i + 512] @ b["unit"].T >= similarity)
                x += i
                keep = x < y if same else ~_twice(a, b, x, y)
                yield x[keep], y[keep]

        def _twice(asks: dict, own: dict, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            """Pairs of rest vectors that both visit the other's cell count in the smaller cell alone."""
            both = np.zeros(len(x), bool)
            for n in np.flatnonzero((asks["kind"][x] == 2) & (not own["core"]) & (asks["cell"][x] < own["cell"][y])).tolist():
                both[n] = asks["cell"][x[n]] in own["visits"][y[n]].as_py()
            return both

        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                part, key = batch.slice(a, b - a), int(keys[a])
                if key != group:
                    if home is not None:
                        yield degrees(home["node"], degree)
                    group, home, degree = key, None, None
                if key < 0:  # known without comparison
                    cols = {n: part.column(n).to_numpy() for n in ("node", "weight", "cell", "other")}
                    is_link, of_core = cols["other"] >= 0, cols["node"] < 0
                    yield told(cols["node"][is_link], cols["other"][is_link], np.zeros(is_link.sum(), np.int64))
                    yield degrees(np.where(of_core, -1 - cols["cell"], cols["node"])[~is_link], cols["weight"][~is_link])
                    continue
                kind = part.column("kind").to_numpy()
                made = {n: part.column(n).to_numpy() for n in ("node", "weight", "cell", "kind")} | {"unit": _units(part.column("unit"), width), "visits": part.column("visits"), "core": bool(key >> 32 & 1)}
                take = lambda m, at: {k: v if k == "core" else v.take(pa.array(at)) if k == "visits" else v[at] for k, v in m.items()}
                own, asks = take(made, np.flatnonzero(kind == 0)), take(made, np.flatnonzero(kind > 0))
                found: list[tuple[np.ndarray, np.ndarray]] = []
                if len(own["node"]):
                    before = home
                    if home is None:
                        home, degree = own, np.zeros(len(own["node"]), np.int64)
                    else:
                        home = {k: v if k == "core" else pa.concat_arrays([v, own[k]]) if k == "visits" else np.concatenate([v, own[k]]) for k, v in home.items()}
                        degree = np.concatenate([degree, np.zeros(len(own["node"]), np.int64)])
                    if not own["core"]:
                        at = len(home["node"]) - len(own["node"])
                        for x, y in pairs(own, own, True):
                            np.add.at(degree, at + x, own["weight"][y])
                            np.add.at(degree, at + y, own["weight"][x])
                            found.append((own["node"][x], own["node"][y]))
                        if before is not None:
                            for x, y in pairs(own, before, False):
                                np.add.at(degree, at + x, before["weight"][y])
                                np.add.at(degree, y, own["weight"][x])
                                found.append((own["node"][x], before["node"][y]))
                if len(asks["node"]) and home is not None:
                    got = np.zeros(len(asks["node"]), np.int64)
                    for x, y in pairs(asks, home, False):
                        np.add.at(got, x, home["weight"][y])
                        back = asks["kind"][x] < 3
                        np.add.at(degree, y[back], asks["weight"][x[back]])
                        found.append((asks["node"][x], home["node"][y]))
                    yield degrees(asks["node"], got)
                if found:
                    p, q = (np.concatenate(z) for z in zip(*found, strict=True))
                    names, at = np.unique(np.concatenate([p, q]), return_inverse=True)
                    _, used = vptree.spanned(len(names), at[: len(p)], at[len(p) :])
                    yield told(p[used], q[used], np.zeros(len(used), np.int64))
        if home is not None:
            yield degrees(home["node"], degree)

    return dealt.repartition("group").sortWithinPartitions("group", "kind").mapInArrow(run, out)


def near_vectors(df: DataFrame, similarity: float = 0.95, id: str = "vec_id", vector: str = "embedding", cell: int = CELL, margin: float = MARGIN, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept): vectors linked at a cosine of ``similarity`` (over 0) or more, in double precision.

    Equal vectors are one class with a weight. Centroids are fitted to a sample of at most SAMPLED vectors for each cell and
    MOST_CELLS cells; every class is assigned. Vectors within half the linking angle of their centroid are its cell's core: any two are
    linked, and by the triangle inequality most other vectors are linked with all of a core or with none, so a group of
    near copies of any size costs no comparisons of its members. What is left is compared in blocks of products: a
    vector with its own cell, and with cells whose bound it is near, so that a link across a bound is found if either side
    is within ``margin`` / sqrt(length) of the link's length from it. A link is missed only where its whole step of twice that goes straight
    across a bound: for links in no special direction once in millions; with a margin of sqrt(length) never, at the price
    of more visits. No pair below ``similarity`` is linked. Pairs are counted and connected where they are found; a task hands on a number for each
    vector and links enough for its components, never all pairs. Homes of a block are held, all others pass by in batches.

    ``n_links`` counts other rows linked directly, copies included; ``component_id`` is the smallest id that links reach, the
    own included; ``kept`` is true for that id's row. Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing. Shorter vectors are followed by zeros. Null ids name no component (null if it has no other id, and then its rows are kept);
    rows that repeat an id keep a row each. An empty table stays empty.
    """
    assert similarity > 0
    rows = df.select(F.col(id).alias("id"), F.col(vector).alias("vector"))
    valid = rows.where(vectors.finite("vector"))
    width, angle = max(1, vectors.width(valid, "vector")), math.acos(min(1.0, similarity))
    own = scratch.cut(_keyed(valid, width), "own")
    classes = own.groupBy("key").agg(F.count("*").alias("weight"), F.min("id").alias("least"), F.any_value("unit").alias("unit"))
    classes = scratch.cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    k = min(MOST_CELLS, max(1, -(-n // cell)))
    share = min(1.0, SAMPLED * k / max(1, n))
    sample = classes.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))).select("unit").limit(2 * SAMPLED * MOST_CELLS).toArrow().column(0).combine_chunks()
    some = _units(sample, width)
    some = some if len(some) or not n else _units(classes.select("unit").limit(1).toArrow().column(0).combine_chunks(), width)
    centre = centroids(some, k, math.cos(angle / 2)) if n else np.eye(1, width)
    cells = Cells(centre, angle, margin * math.sqrt(2 - 2 * similarity) / math.sqrt(width))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, away, core = cells.home(_units(batch.column(2), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64()), pa.array(away), pa.array(core)], names=["node", "weight", "unit", "cell", "away", "core"])

    placed = scratch.cut(_held(classes, ["node", "weight", "unit"], place, "node long, weight long, unit binary, cell long, away double, core boolean"), "placed")
    k = len(centre)
    weight, radius, first, split = np.zeros(k, np.int64), np.zeros(k), np.full(k, -1), {}
    for r in placed.groupBy("cell", "core").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.max("away").alias("away"), F.min("node").alias("first")).collect():
        split[r.cell, r.core] = r.n
        if r.core:
            weight[r.cell], radius[r.cell], first[r.cell] = r.weight, r.away, r.first
    told = Cells(cells.centre, cells.angle, cells.step, weight, radius, first)
    met = scratch.cut(_met(_asked(placed, told, width, split, block), similarity, width), "met")
    degrees = met.where("other is null").groupBy(F.col("node").alias("of")).agg(F.sum("n").alias("n"))
    found = scratch.cut(components.components(met.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))), "components")
    mine = placed.select("node", F.when(F.col("core"), -1 - F.col("cell")).alias("of_core"))
    shared = degrees.where("of < 0").select(F.col("of").alias("core_of"), F.col("n").alias("more"))
    counted = mine.join(shared, F.col("of_core") == F.col("core_of"), "left").join(degrees.where("of >= 0"), F.col("node") == F.col("of"), "left").select("node", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("links"))
    rooted = classes.join(found.withColumnRenamed("node", "known"), F.col("node") == F.col("known"), "left").select("key", "weight", "least", "node", F.coalesce("root", "node").alias("root"))
    names = rooted.groupBy(F.col("root").alias("name_of")).agg(F.min("least").alias("component_id"))
    named = rooted.join(names, F.col("root") == F.col("name_of")).join(counted.withColumnRenamed("node", "counted"), F.col("node") == F.col("counted"))
    named = scratch.cut(named.select(F.col("key").alias("known"), (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id"), "named")
    scratch.drop(classes, placed, met, found)
    linked = own.join(named, F.col("key") == F.col("known")).select("id", "n_links", "component_id")
    zero = valid.where(~F.exists("vector", lambda x: x != 0)).select("id")
    alone = rows.where(~F.coalesce(vectors.finite("vector"), F.lit(False))).select("id").unionByName(zero).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id)
