"""Running values, offsets and resamples against plain loops, with keys that no task may hold."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import audit, chunking, metrics, scans


@pytest.fixture(autouse=True)
def apart(spark):
    """Small tables keep their partitions, so that keys do lie across bounds."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


def rows(seed=1, n=900):
    rng = random.Random(seed)
    made = [(rng.choice(["hot", "hot", "b", "c", None]), i if rng.random() < 0.97 else None, rng.choice([None, 1, 2, 5]), rng.random() < 0.01) for i in range(n)]
    rng.shuffle(made)
    return made


def test_scans_equal_loops(spark):
    made = rows()
    made = [r for r in made if r[1] is not None]
    df = spark.createDataFrame([(*r, "x") for r in made], "k string, i long, v int, m boolean, total string").repartition(7)
    got = scans.scan(df, ["k"], ["i"], sums={"total": F.col("v"), "ones": F.lit(1)}, before={"last": F.col("v"), "last_i": F.col("i")}, seen={"met": F.col("m")}, number="n")
    told = {(r.k, r.i): (r.total, r.ones, r["last"], r.last_i, r.met, r.n) for r in got.collect()}
    want, state = {}, {}
    for k, i, v, m in sorted(made, key=lambda r: (str(r[0]), r[1])):
        total, last, last_i, met, n = state.get(k, (None, None, None, False, 0))
        total, n = (total if v is None else (total or 0) + v), n + 1
        want[k, i] = (total, n, last, last_i, met, n)
        state[k] = total, v, i, met or m, n
    assert told == want and len(told) == len(made)


def test_a_hot_key_spreads_over_ranges(spark):
    df = spark.range(4000).select(F.lit("one").alias("k"), F.col("id").alias("i"))
    held, parts = scans.stored, []
    scans.stored = lambda d, name: parts.append(made := held(d, name)) or made
    try:
        got = scans.scan(df, ["k"], ["i"], sums={"s": F.col("i")}, number="n")
        assert got.where("s <> i * (i + 1) / 2 or n <> i + 1").count() == 0 and got.count() == 4000
        assert parts[0].select("__part").distinct().count() > 1
    finally:
        scans.stored = held
    assert scans.scan(df.where("i < 0"), ["k"], ["i"], number="n").count() == 0


def test_one_long_session_is_checked_by_many_tasks(spark):
    chain = audit.build_chain(spark.range(3000).select(F.lit("s").alias("k"), F.col("id").alias("seq"), F.col("id").cast("string").alias("data")), "k", "seq", "data")
    assert [(r.entries, r.valid, r.first_bad) for r in audit.verify_chain(chain, "k", "seq", "data").collect()] == [(3000, True, None)]
    forged = chain.withColumn("data", F.when(F.col("seq").isin(1500, 2900), "forged").otherwise(F.col("data")))
    assert [(r.valid, r.first_bad) for r in audit.verify_chain(forged, "k", "seq", "data").collect()] == [(False, 1500)]
    lost = chain.where("seq <> 2000")
    assert [(r.valid, r.first_bad) for r in audit.verify_chain(lost, "k", "seq", "data").collect()] == [(False, 2001)]
    assert audit.provenance(chain, "k", "seq", F.col("seq").isin(2100, 50)).count() == 51
    spent = audit.cost(chain, "k", "seq", F.lit(0.5), 1000.0)
    assert spent.where("over").count() == 1000 and spent.agg(F.max("spent")).first()[0] == 1500


def test_word_offsets_of_odd_texts(spark):
    texts = {1: "a bb  ccc\n", 2: "", 3: None, 4: "  é\tüü", 5: "x" * 500 + " y", 6: " \n "}
    got = {}
    for r in chunking.word_offsets(spark.createDataFrame(list(texts.items()), "document_id long, text string")).collect():
        got.setdefault(r.document_id, []).append((r.n, r.word, r.char_start, r.char_end))
        assert texts[r.document_id][r.char_start : r.char_end] == r.word
    assert {i: [w for _, w, _, _ in sorted(x)] for i, x in got.items()} == {i: t.split() for i, t in texts.items() if t and t.split()}


@pytest.mark.parametrize("block", [1 << 16, 8])
def test_resamples_of_blocks_are_draws_from_all(spark, block):
    values = [random.Random(i).random() for i in range(50)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(99, None)], "i long, v double")
    got = metrics.bootstrap(df, "v", "i", 400, block=block).first()
    assert got.mean == pytest.approx(np.mean(values))
    if block > 50:
        means = sorted(np.mean([values[int(hashlib.md5(f"{b}:{j}".encode()).hexdigest()[:8], 16) % 50] for j in range(1, 51)]) for b in range(400))
        assert (got.ci_low, got.ci_high) == (pytest.approx(means[10]), pytest.approx(means[390]))
    spread = 1.96 * np.std(values) / 50**0.5
    assert got.ci_low == pytest.approx(got.mean - spread, abs=0.02) and got.ci_high == pytest.approx(got.mean + spread, abs=0.02)


def test_draws_of_all_blocks_together():
    sizes = np.array([8, 8, 3])
    counts = np.array([metrics.split_draws(b, sizes) for b in range(400)])
    assert (counts.sum(1) == 19).all() and np.abs(counts.mean(0) - sizes).max() < 0.5 and counts.std(0).min() > 1
    assert (metrics.split_draws(3, np.array([7])) == [7]).all()


def test_md5_side_by_side_equals_hashlib():
    import hashlib

    for head in (b"", b"7:", b"9999:12:", b"x" * 49):
        told = metrics.md5_heads(head, 12_345).tolist()
        assert told == [int(hashlib.md5(head + str(j).encode()).hexdigest()[:8], 16) for j in range(1, 12_346)]
    assert metrics.md5_heads(b"7:", 0).tolist() == []


def test_texts_go_to_python_in_short_batches(spark, monkeypatch):
    from assayer.functions import text
    from assayer.operators import chunking

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        monkeypatch.setattr(chunking, "PLACED", 3)
        rows = spark.createDataFrame([(0, "a bb  c d"), (1, "e"), (2, ""), (3, "é f g"), (4, None)], "document_id long, text string").coalesce(1)
        got = sorted(tuple(r) for r in chunking.word_offsets(rows).collect())
        assert int(spark.conf.get(key)) <= 1000
        assert got == [(0, 0, "a", 0, 1), (0, 1, "bb", 2, 4), (0, 2, "c", 6, 7), (0, 3, "d", 8, 9), (1, 0, "e", 0, 1), (3, 0, "é", 0, 1), (3, 1, "f", 2, 3), (3, 2, "g", 4, 5)]
    finally:
        spark.conf.set(key, before)
    told = spark.createDataFrame([("ﬁ \u0041\u030a",), ("plain",), (None,), ("",)], "t string").select(text.nfkc(F.col("t"))).collect()
    assert [r[0] for r in told] == ["fi \u00c5", "plain", None, ""]
