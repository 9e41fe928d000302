"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import prefix, scratch

#: Rates are held as whole multiples of 2**-RATE_BITS, so that their sums are exact.
RATE_BITS = 32
#: Newton ends when the expected words are this near a target, as a share of it.
NEAR = 1e-7
MOST_STEPS = 60
#: The type of sums over a whole corpus.
_WIDE = "decimal(38,0)"
#: Phases of the systematic rounding that are tried for each source.
PHASES = 64


@dataclass
class Source:
    """What the driver knows of a source: a few numbers, however many documents it has."""

    name: str | None
    size: int
    mean: float
    target: float = 0.0
    tilt: float = 0.0
    low: float = -math.inf
    high: float = math.inf
    done: bool = False


def share_out(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess is shared by weight again."""
    out, left, open_ = [0.0] * len(sizes), float(total), [i for i in range(len(sizes)) if weights[i] > 0]
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def rate(size: Column, mean: Column, tilt: Column, most: float) -> Column:
    """Expected copies of a document: the exponential tilt by its size, at most ``most``, in units of 2**-RATE_BITS."""
    return F.round(F.exp(F.least(tilt * size / mean, F.lit(math.log(most)))) * F.lit(float(1 << RATE_BITS))).cast("long")


def solve(cells: DataFrame, sources: list[Source], most: float) -> None:
    """Find each source's tilt: the dual of minimising relative entropy under the token constraints.

    A step is one aggregation over (source, size, count) cells that gives the expected words and their derivative for
    every source; the constraints of different sources share no document, so the Hessian is diagonal. Newton steps that
    leave the bracket around the root are replaced by bisection. Sums are of whole numbers: runs agree. Where whole copies of
    few documents jump over the target the bracket closes on the jump, which is as near as a tilt comes; a source that is neither near its target nor closed in after MOST_STEPS is an error.
    """
    spark, whole = cells.sparkSession, 1 << RATE_BITS
    for s in sources:
        if s.size == 0 or s.target <= 0:
            s.tilt, s.done = -math.inf if s.target <= 0 else 0.0, True
        elif s.target >= most * s.size * (1 - NEAR):
            s.tilt, s.done = math.inf, True
        elif s.target < s.size:
            s.high = 0.0
        else:
            s.low = 0.0
    for _ in range(MOST_STEPS):
        open_ = [s for s in sources if not s.done]
        if not open_:
            return
        known = spark.createDataFrame([(s.name, s.mean, s.tilt) for s in open_], "source string, mean double, tilt double")
        own = cells.join(known, cells["source"].eqNullSafe(known["source"])).select(known["source"], "size", "n", "mean", rate(F.col("size"), F.col("mean"), F.col("tilt"), most).alias("rate"))
        words = F.floor(F.col("rate") * F.col("size") / F.lit(float(1 << (RATE_BITS - 10)))).cast("long") * F.col("n")
        slope = F.floor(words * F.col("size") / F.col("mean")).cast("long")
        found = own.groupBy("source").agg(F.sum(words.cast(_WIDE)).alias("words"), F.sum(F.when(F.col("rate") < F.lit(int(most * whole)), slope).otherwise(0).cast(_WIDE)).alias("slope")).collect()
        by_name = {r["source"]: (int(r["words"]) / 1024, int(r["slope"]) / 1024) for r in found}
        for s in open_:
            words_now, slope_now = by_name.get(s.name, (0.0, 0.0))
            if abs(words_now - s.target) <= max(NEAR * s.target, 0.01):
                s.done = True
                continue
            if words_now > s.target:
                s.high = s.tilt
            else:
                s.low = s.tilt
            step = s.tilt + (s.target - words_now) / slope_now if slope_now > 0 else math.nan
            if not s.low < step < s.high:
                step = (s.low + s.high) / 2 if math.isfinite(s.low + s.high) else 2 * s.low + 1 if math.isfinite(s.low) else 2 * s.high - 1
            s.tilt = step
    if stuck := [s.name for s in sources if not s.done and not (s.high - s.low <= 1e-9 * max(1.0, abs(s.low)))]:
        raise RuntimeError(f"no tilt meets the target of {stuck} after {MOST_STEPS} steps")


def _copies(phase: Column) -> Column:
    """Copies of a document: whole numbers that its stretch of the running rates passes, from a phase on."""
    return (F.shiftright(F.col("ahead") + F.col("rate") + phase, RATE_BITS) - F.shiftright(F.col("ahead") + phase, RATE_BITS)).cast("int")


def _phases(placed: DataFrame, sources: list[Source]) -> dict[str | None, int]:
    """For each source the phase whose rounding comes nearest the target, from one aggregation over all of them."""
    tried = [k << (RATE_BITS - PHASES.bit_length() + 1) for k in range(PHASES)]
    sums = placed.groupBy("source").agg(*(F.sum((_copies(F.lit(p)) * F.col("size")).cast(_WIDE)).alias(f"p{k}") for k, p in enumerate(tried))).collect()
    target = {s.name: s.target for s in sources}
    return {r["source"]: min(tried, key=lambda p: (abs(int(r[f"p{tried.index(p)}"]) - target[r["source"]]), p)) for r in sums}


def mix(docs: DataFrame, size: Column, weights: Sequence[float] = (1.0,), budget: float = 1.5, most: float = 2.0, source: str = "source", id: str = "doc_id") -> DataFrame:
    """Decide how many copies of each document a mix takes so that sources meet their target weights.

    ``size`` counts a document's tokens. Sources, by code point with null last, take the weights in turn, and share
    ``budget`` times all tokens; a source's target stops at ``most`` times its tokens and the excess is shared anew.
    Entropy balancing gives each document the expected copies exp(tilt * size / mean size), at most ``most``, that meet
    the target; systematic rounding along (source, size, id) turns them into copies, from the phase that brings a source's
    tokens nearest its target. Returns a row for each row given: its id, source and size, ``source_size``, ``target``,
    ``copies`` (0 to ``most``) and ``taken`` (copies * size). Rows that repeat an id are rounded each by itself; of equal
    rows it is open which gets which copies, but how many get how many is not. Null ids and sources are values like
    others; documents without tokens have expected copies of one. An empty table gives no rows.
    """
    spark = docs.sparkSession
    slim = scratch.cut(docs.select(F.col(id).alias("id"), F.col(source).cast("string").alias("source"), size.cast("long").alias("size")).withColumn("row", F.monotonically_increasing_id()), "sizes")
    cells = scratch.cut(slim.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    totals = cells.groupBy("source").agg(F.sum((F.col("size") * F.col("n")).cast(_WIDE)).cast("long").alias("size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("n")).collect()
    sources = [Source(r["source"], r["size"], r["size"] / max(1, r["n"]) or 1.0) for r in sorted(totals, key=lambda r: (r["source"] is None, r["source"] or ""))]
    shares = share_out([s.size for s in sources], [weights[i % len(weights)] for i in range(len(sources))], budget * sum(s.size for s in sources), most)
    for s, target in zip(sources, shares, strict=True):
        s.target = target
    solve(cells, sources, most)
    told = spark.createDataFrame([(s.name, s.size, s.mean, s.target, s.tilt) for s in sources], "source string, source_size long, mean double, target double, tilt double")
    tilt = F.when(F.col("size") > 0, F.col("tilt") * 1.0).otherwise(0.0)
    rated = slim.join(told, slim["source"].eqNullSafe(told["source"])).select(
        slim["id"], slim["source"], slim["size"], "row", "source_size", "target",
        F.when(F.col("size") == 0, F.lit(1 << RATE_BITS)).otherwise(rate(F.col("size"), F.col("mean"), tilt, most)).alias("rate"),
    )
    placed = scratch.cut(prefix.running(rated, ["source"], ["size", "id", "row"], "rate", "ahead", 1 << RATE_BITS), "rates")
    best = _phases(placed, sources)
    phases = spark.createDataFrame([(s.name, best.get(s.name, 0)) for s in sources], "__source string, phase long")
    placed = placed.join(phases, placed["source"].eqNullSafe(phases["__source"]))
    copies = _copies(F.col("phase"))
    return placed.select(F.col("id").alias(id), F.col("source").alias(source), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def repeat(docs: DataFrame, size: Column, **options) -> DataFrame:
    """The mixed documents themselves: each row as often as ``mix`` says, with its own columns.

    What the mix says has a row for each document, so it is joined by a shuffle at any size. Rows of one id, source and size share what ``mix`` gives to all of them as evenly as whole copies allow.
    Null ids, sources and texts are values like others; an empty table stays empty. Columns of the input may have any name but those that begin with two underscores.
    """
    source, id = options.get("source", "source"), options.get("id", "doc_id")
    told = mix(docs, size, **options).groupBy(F.col(id).alias("__id"), F.col(source).alias("__source"), F.col("size").alias("__size")).agg(F.count("*").alias("__rows"), F.sum("copies").alias("__copies"))
    told = scratch.cut(told.where("__copies > 0"), "copies")
    own = docs.withColumn("__own", size.cast("long"))
    joined = own.join(told.hint("merge"), own[id].eqNullSafe(told["__id"]) & own[source].cast("string").eqNullSafe(told["__source"]) & (own["__own"] == told["__size"]))
    if told.where("__rows > 1").limit(1).count():
        joined = scratch.cut(joined.withColumn("__row", F.monotonically_increasing_id()).withColumn("__one", F.lit(1).cast("long")), "repeated")
        placed = prefix.running(joined.where("__rows > 1"), ["__id", "__source", "__size"], ["__row"], "__one", "__at")
        spread = F.floor(F.col("__copies") / F.col("__rows")) + (F.col("__at") < F.col("__copies") % F.col("__rows")).cast("long")
        joined = joined.where("__rows = 1").unionByName(placed.withColumn("__copies", spread).drop("__at")).where("__copies > 0")
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)
