"""Pruned searches against plain ones."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import lexical, nearest, retrieval


def texts(n=300, seed=2):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(900)]
    made = [" ".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(rng.randint(1, 80))) for _ in range(n)]
    return [*made, made[0], made[0], made[1].upper(), "", None, "É é ÉÉ", "a\x0bb\tc"]


def plain(asked, held, k):
    split = {i: (t or "").lower().encode().split() for i, t in held.items()}
    n, mean = len(split), sum(map(len, split.values())) / len(split)
    out = {}
    for q, t in asked.items():
        scores = {}
        for w in set((t or "").lower().encode().split()):
            df = sum(w in ws for ws in split.values())
            for i, ws in split.items():
                if tf := ws.count(w):
                    scores[i] = scores.get(i, 0) + math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / mean))
        out[q] = sorted(((-round(s, 9), i) for i, s in scores.items()))[:k]
    return out


@pytest.mark.parametrize("sizes", [{}, {"slice_rows": 40, "block": 3}, {"slice_rows": 11, "block": 100}])
def test_bm25_equals_a_plain_search(spark, sizes):
    held = dict(enumerate(texts()))
    asked = {i: t for i, t in held.items() if i % 12 == 0 or i >= 300}
    chunks = spark.createDataFrame(list(held.items()), "chunk_id long, text string")
    queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    got = {}
    for r in retrieval.bm25(queries, chunks, [], 5, **sizes).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((pytest.approx(-r.score, abs=1e-8), r.chunk_id, r["rank"]))
    want = {q: [(s, i, n) for n, (s, i) in enumerate(xs, 1)] for q, xs in plain(asked, held, 5).items() if xs}
    assert want == got


def test_bm25_within_scopes_with_nulls(spark):
    held = dict(enumerate(texts(120)))
    rows = [(i, t, ["a", "b", None][i % 3]) for i, t in held.items()]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string, who string").where("who is not null")
    queries = chunks.where("chunk_id % 7 = 0").withColumnRenamed("chunk_id", "query_id")
    got = {(r.query_id, r["rank"]): (r.chunk_id, pytest.approx(r.score, abs=1e-8)) for r in retrieval.bm25(queries, chunks, ["who"], 4, slice_rows=9, block=2).collect()}
    want = {}
    for who in "ab":
        own = {i: t for i, t, w in rows if w == who}
        for q, xs in plain({i: t for i, t in own.items() if i % 7 == 0}, own, 4).items():
            want |= {(q, n): (i, -s) for n, (s, i) in enumerate(xs, 1)}
    assert want == got


def test_bm25_leaves_most_chunks_unscored(spark):
    """On the driver's documents fewer than a tenth of the pairs are scored to the end."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    queries = docs.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    n = queries.count() * docs.count()
    found = lexical.search(queries, docs, [], 30, "query_id", "doc_id", "text")
    scored = found.groupBy("query_id").agg(F.max("scored").alias("n")).agg(F.sum("n")).first()[0]
    assert 0 < scored < n / 10


def test_bm25_of_nothing(spark):
    none = spark.createDataFrame([], "chunk_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "chunk_id long, text string")
    ask = lambda df: df.withColumnRenamed("chunk_id", "query_id")
    assert [retrieval.bm25(ask(q), c, [], 3).count() for q, c in ((none, some), (some, none), (some, some), (some.where("chunk_id = 2"), some))] == [0, 0, 1, 0]
    zero = retrieval.bm25(ask(some), some, [], 3, keep_zero=True).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in zero] == [(1, 1), (1, 2), (2, 1), (2, 2)]


def nearest_plain(asked, held, k):
    unit = lambda v: np.array(v, float) / max(np.linalg.norm(np.array(v, float)), 1e-12)
    out = {}
    for q, v in asked.items():
        out[q] = sorted((-round(float(unit(v) @ unit(w)), 9), i) for i, w in held.items() if w is not None)[:k]
    return out


def groups(n_groups, each, width, spread, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n_groups, width))
    rows = [list(map(float, c + spread * rng.normal(size=width))) for c in centres for _ in range(each)]
    return [*rows, rows[0], rows[0], [2 * x for x in rows[1]], [0.0] * width, None]


@pytest.mark.parametrize("spread, sizes", [(0.05, {}), (0.05, {"slice_rows": 50, "pivots": 12, "block": 7}), (3.0, {"slice_rows": 50, "pivots": 12, "block": 100})])
def test_nearest_equal_a_plain_search(spark, spread, sizes):
    held = dict(enumerate(groups(12, 60, 8, spread)))
    asked = {i: v for i, v in held.items() if v is not None and (i % 25 == 0 or i > 718)}
    chunks = spark.createDataFrame(list(held.items()), "chunk_id long, embedding array<float>")
    held = {r.chunk_id: r.embedding for r in chunks.collect()}
    queries = chunks.where(F.col("chunk_id").isin(list(asked)) & F.col("embedding").isNotNull()).withColumnRenamed("chunk_id", "query_id")
    told: list[int] = []
    got = {}
    for r in nearest.search(queries, chunks, 4, "query_id", "chunk_id", tell=told, **sizes).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((pytest.approx(-r.score, abs=1e-8), r.chunk_id))
    assert nearest_plain({q: held[q] for q in asked}, held, 4) == got
    compared, pairs = told
    assert pairs == len(asked) * (len(held) - 1) and (compared < pairs / 3 if sizes and spread < 1 else compared <= pairs)


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], "chunk_id long, embedding array<float>")
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "chunk_id long, embedding array<float>")
    ask = lambda df: df.withColumnRenamed("chunk_id", "query_id")
    assert [nearest.search(ask(q), c, 3, "query_id", "chunk_id").count() for q, c in ((none, some), (some, none), (some, some), (none, none))] == [0, 0, 1, 0]


def test_bm25_blocks_do_not_grow_with_queries_and_slices():
    """Each block takes all lists of its slices, so that blocks times lists must not grow with the square of the tables."""
    sent = [lexical.n_blocks(rows // 50, max(1, rows // lexical.SLICE), lexical.BLOCK) * rows for rows in (50_000, 500_000, 800_000)]
    assert sent[1] <= 10 * sent[0] and sent[2] <= 16 * sent[0]
    assert lexical.n_blocks(200, 1, 32) == 7 and lexical.n_blocks(5, 4, 3) == 2 and lexical.n_blocks(0, 1, 32) == 1


def test_bm25_sends_queries_to_cells_and_not_to_slices():
    """What is sent, chunks for each block and queries for each cell, grows no faster than the tables: six GB have some 190 slices and 61,000 queries."""
    sent = []
    for rows in (500_000, 3_000_000):
        cells, queries = lexical.n_cells(rows // lexical.SLICE), rows // 50
        sent.append(rows * lexical.n_blocks(queries, cells, lexical.BLOCK) + queries * cells)
    assert sent[1] <= 6.6 * sent[0]
    assert [lexical.n_cells(n) for n in (1, 2, 32, 33, 176)] == [1, 2, 32, 17, 30]


@pytest.mark.parametrize("sizes", [{}, {"slice_rows": 40}, {"slice_rows": 3, "block": 5}])
def test_bm25_scores_do_not_depend_on_slices(spark, sizes):
    """Copies in different slices have one score to the last bit; common terms, long texts and copies that tie at the k-th place keep their order."""
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{min(int(rng.paretovariate(0.6)), 400)}" for _ in range(n))
    texts = [text(rng.choice([1, 5, 40, 300])) for _ in range(150)]
    held = dict(enumerate([*texts, *texts[:30], *texts[:30]]))
    chunks = spark.createDataFrame(list(held.items()), "chunk_id long, text string")
    queries = chunks.where("chunk_id < 40").withColumnRenamed("chunk_id", "query_id")
    got, copies = {}, {}
    for r in retrieval.bm25(queries, chunks, [], 12, **sizes).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((pytest.approx(-r.score, abs=1e-8), r.chunk_id))
        copies.setdefault((r.query_id, held[r.chunk_id]), set()).add(r.score)
    assert plain({q: held[q] for q in range(40)}, held, 12) == got
    assert all(len(scores) == 1 for scores in copies.values())
