"""Mixing, sharding and running totals."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import mixing, prefix, sharding



def size():
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def test_running_totals_follow_the_order(spark):
    df = spark.createDataFrame([(None if k == 3 else k, i, i % 4) for k in range(4) for i in range(50)], "k long, i long, v long")
    got = {(r.k, r.i): r.total for r in prefix.running(df, ["k"], ["i"], "v", "total").collect()}
    assert len(got) == 200 and all(t == sum(x % 4 for x in range(i)) for (_, i), t in got.items())


@pytest.mark.parametrize("sizes, weights, total, expected", [([10, 10], [1, 1], 30, [15, 15]), ([1, 100], [5, 1], 60, [2, 58]), ([5, 5], [1, 1], 100, [10, 10]), ([0, 4], [1, 1], 4, [0, 4]), ([], [], 0, [])])
def test_shares_stop_at_twice_the_size(sizes, weights, total, expected):
    assert mixing.share_out(sizes, weights, total, 2.0) == pytest.approx(expected)


def brute_mix(rows, weights):
    """The same balance solved by bisection in plain Python; gives targets and expected rates."""
    by = defaultdict(list)
    for id, source, size in rows:
        by[source].append((size, id))
    names = sorted((s for s in by if s is not None)) + [None] * (None in by)
    sizes = [sum(x for x, _ in by[s]) for s in names]
    targets = mixing.share_out(sizes, [weights[i % len(weights)] for i in range(len(names))], 1.5 * sum(sizes), 2.0)
    rates = {}
    for s, total, target in zip(names, sizes, targets):
        mean = total / max(1, sum(x > 0 for x, _ in by[s])) or 1.0
        words = lambda t: sum(x * min(2, math.exp(min(t * x / mean, 5))) for x, _ in by[s])  # noqa: B023, E731
        low, high = -60.0, 60.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if words(middle) < target else (low, middle)
        rates |= {(s, id): min(2, math.exp(min(low * x / mean, 5))) if x else 1.0 for x, id in by[s]}
    return dict(zip(names, targets)), rates


def test_mix_meets_targets_and_follows_the_rates(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [None, "a", "b", "ü"][i % 4], int(rng.integers(0, 400))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n long")
    got = mixing.mix(docs, F.col("n"), weights=(5, 2, 1)).toPandas()
    targets, rates = brute_mix(rows, (5, 2, 1))
    for r in got.itertuples():
        source = None if r.source is None or r.source != r.source else r.source
        assert r.target == pytest.approx(targets[source], rel=1e-6)
        assert r.taken == r.copies * r.size <= 2 * r.size and abs(r.copies - rates[source, r.doc_id]) < 1 + 1e-3
    sums = got.groupby(got.source.fillna("none"))[["taken", "target"]].agg({"taken": "sum", "target": "first"})
    assert ((sums.taken - sums.target).abs() <= 400).all()
    assert ((sums.taken - sums.target).abs() / sums.target < 0.01).all()
    again = mixing.mix(docs.repartition(7), F.col("n"), weights=(5, 2, 1)).toPandas()
    assert sorted(got.itertuples(index=False), key=str) == sorted(again.itertuples(index=False), key=str)


def test_mix_of_odd_rows(docs, nothing):
    got = mixing.mix(docs, size(), weights=(5, 2, 1)).toPandas()
    assert len(got) == docs.count() and (got.taken <= 2 * got["size"]).all()
    assert mixing.mix(nothing, size()).count() == 0
    mixed = mixing.repeat(docs, size(), weights=(5, 2, 1))
    assert mixed.columns == docs.columns
    assert mixed.count() == got.copies.sum()


def test_totals_beyond_64_bits_stay_right_modulo(spark):
    df = spark.range(40).select(F.lit("a").alias("k"), F.col("id").alias("i"), F.lit((1 << 61) + 12345).alias("v")).repartition(40, "i")
    got = {r.i: r.total for r in prefix.running(df, ["k"], ["i"], "v", "total", 1 << 32).collect()}
    assert got == {i: i * ((1 << 61) + 12345) % (1 << 32) for i in range(40)}


def test_rows_that_repeat_an_id_meet_the_target_together(spark):
    rows = [(None, "a", 10, "same words")] * 1000 + [(i, s, 10, f"text {i}") for i, s in enumerate(["b", "c"] * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n long, text string")
    got = mixing.mix(docs, F.col("n"), weights=(5, 2, 1)).toPandas()
    assert len(got) == 2000
    sums = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((sums.taken - sums.target).abs() / sums.target < 0.01).all()
    mixed = mixing.repeat(docs, F.col("n"), weights=(5, 2, 1)).groupBy("source").count().toPandas().set_index("source")["count"].sort_index()
    assert (mixed * 10 == sums.taken).all()


def brute_capacity(sizes, shards):
    def fits(c):
        used, held = 1, 0
        for s in sizes:
            if s > c:
                return False
            if held + s > c:
                used, held = used + 1, 0
            held += s
        return used <= shards

    return next(c for c in range(1, sum(sizes) + 1) if fits(c))


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_shards_are_minimax_and_keep_groups(docs, shards):
    got = sharding.shard(docs, shards).toPandas()
    text = {r.doc_id: r.text for r in docs.collect()}
    keyed = docs.select(F.xxhash64(F.struct(F.col("text").isNull(), F.col("text"))).alias("k"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("n")).groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").collect()
    assert got.groupby("shard")["size"].sum().max() == brute_capacity([r.n for r in keyed], shards)
    places = defaultdict(set)
    for r in got.itertuples():
        places[text[None if r.doc_id != r.doc_id else r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in places.values())
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_shards_of_a_hot_group_and_of_nothing(spark, nothing):
    hot = spark.createDataFrame([(i, "same" if i % 3 else f"text {i}") for i in range(300)], "doc_id long, text string")
    got = sharding.shard(hot, 16).toPandas()
    assert len(got) == 300 and got[got["size"] == 5].shard.nunique() == 1 and (got.law == "bytes").all() and got.grown_shard.isna().all()
    sizes = sorted(got.groupby("shard")["size"].sum())
    assert len(sizes) == 16 and sizes[-1] == 1000 and sizes[-2] - sizes[0] < 60
    assert sharding.shard(nothing, 16).count() == 0
