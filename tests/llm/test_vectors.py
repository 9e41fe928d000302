"""Near-duplicate vectors and product codes, against brute force."""

import hashlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import codes, nearvec, queries

SCHEMA = "vec_id long, embedding array<double>, label string, key string, unit string, n string"


def plain_links(rows, similarity):
    """(n_links, component) of each row: all pairs by cosine."""
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max((len(rows[i][1]) for i in good), default=1)
    units = {i: np.pad(np.array(rows[i][1], float), (0, width - len(rows[i][1]))) for i in good}
    units = {i: (u / np.abs(u).max()) / np.linalg.norm(u / np.abs(u).max()) for i, u in units.items()}
    linked = {i: [j for j in good if j != i and units[i] @ units[j] >= similarity] if i in units else [] for i in range(len(rows))}
    label = list(range(len(rows)))
    for _ in rows:
        before = list(label)
        for i, js in linked.items():
            for j in js:
                label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    ids = defaultdict(list)
    for i, (id, _) in enumerate(rows):
        ids[label[i]].append(id)
    name = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(len(linked[i]), name[label[i]]) for i in range(len(rows))]


def odd_vectors(n=400, width=16, seed=3):
    """Random vectors; tight groups, a wide one, chains near the limit, copies, scaled copies, and what links with nothing."""
    rng = np.random.default_rng(seed)
    rows = [list(x) for x in rng.normal(size=(n, width))]
    tight, wide = rng.normal(size=width), rng.normal(size=width)
    rows += [list(tight + 0.03 * rng.normal(size=width)) for _ in range(150)]
    rows += [list(wide + 0.22 * rng.normal(size=width)) for _ in range(120)]
    for k in range(60):  # pairs at all cosines near the limit
        step = rng.normal(size=width)
        base = np.array(rows[k])
        rows.append(list(base + step / np.linalg.norm(step) * np.linalg.norm(base) * rng.uniform(0.2, 0.4)))
    rows += [rows[5], rows[5], [4 * x for x in rows[5]], [1e-200 * x for x in rows[6]], [1e200 * x for x in rows[6]], [-x for x in rows[7]]]
    rows += [None, [], [0.0] * width, [None] * width, [1.0, float("nan")], [float("inf"), 1.0], [3.0], [2.0, 0.0], [-0.0, 5.0], [0.0, 5.0]]
    return rows


@pytest.mark.parametrize("block", [64, 4096])
def test_links_of_all_pairs(spark, block):
    rows = [(i, v and [x if x is None else float(x) for x in v]) for i, v in enumerate(odd_vectors())]
    rows += [(3, rows[3][1]), (None, rows[9][1]), (None, [9.0] * 15 + [-9.0]), (700, rows[9][1])]
    df = spark.createDataFrame([(i, v, "a", "k", "u", "n") for i, v in rows], SCHEMA)
    got = nearvec.near_vectors(df, 0.95, cell=64, block=block)
    assert got.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    told = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()), key=str)
    want = sorted(((i, n, c, i == c) for (i, _), (n, c) in zip(rows, plain_links(rows, 0.95), strict=True)), key=str)
    assert told == want and sum(n > 100 for _, n, _, _ in want) > 100


def test_recall_near_the_limit(spark):
    """Links in no special direction in 64 dimensions, from 0.95 up, among many cells."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    step = rng.normal(size=base.shape)
    step -= (step * base).sum(1, keepdims=True) * base
    step /= np.linalg.norm(step, axis=1, keepdims=True)
    cos = rng.uniform(0.951, 0.999, len(base))[:, None]
    both = np.concatenate([base, cos * base + np.sqrt(1 - cos * cos) * step])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in nearvec.near_vectors(df, 0.95, cell=64).collect()}
    want = dict(enumerate(((both @ both.T >= 0.95).sum(1) - 1).tolist()))
    assert sum(want.values()) >= 3000 and all(got[i] <= n for i, n in want.items())
    assert sum(got.values()) >= 0.999 * sum(want.values())


def test_a_hot_tight_group_compares_nothing(spark):
    """A group within half the angle of its centroid is known without comparison, whatever its size: nobody asks its block."""
    rng = np.random.default_rng(1)
    centre, asked = rng.normal(size=32), []
    held = nearvec._asked

    def counted(*a):
        dealt = held(*a)
        asked.append(dealt.where("kind > 0 and shiftright(group, 32) % 2 = 1").count())
        return dealt

    for n in (200, 800):
        rows = [centre + 0.02 * rng.normal(size=32) for _ in range(n)] + list(rng.normal(size=(n, 32)))
        df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
        nearvec._asked = counted
        try:
            got = {r.vec_id: r for r in nearvec.near_vectors(df, 0.95, cell=100).collect()}
        finally:
            nearvec._asked = held
        assert all(got[i].n_links == n - 1 and got[i].component_id == 0 for i in range(n)) and not any(got[i].n_links for i in range(n, 2 * n))
    assert asked == [0, 0]


def test_no_vectors(spark):
    assert nearvec.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    none = spark.createDataFrame([(1, None), (2, [0.0]), (None, None)], "vec_id long, embedding array<double>")
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in nearvec.near_vectors(none).collect()), key=str) == sorted([(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)], key=str)


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """(id, code, error, label_error) and the digest, part by part and row by row."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [float(x) for x in r[1]]))
    width = -(-max(1, max(len(v) for _, v, _ in kept)) // parts)
    ints = [[int(np.clip(np.floor(x * 4096), -(1 << 26), 1 << 26)) for x in v] + [0] * (width * parts - len(v)) for _, v, _ in kept]
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in ints]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda x, p: min(range(len(books[p])), key=lambda e: (away(x, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for v in cut:
                own[best(v[p], p)].append(v[p])
            books[p] = [tuple(sum(c) // len(own[e]) for c in zip(*own[e], strict=True)) if e in own else c for e, c in enumerate(books[p])]
    told, by = [], defaultdict(int)
    for (i, _, lab), v in zip(kept, cut, strict=True):
        es = [best(v[p], p) for p in range(parts)]
        error = sum(away(v[p], books[p][e]) for p, e in enumerate(es))
        by[lab] += error
        told.append((i, "".join(f"{e:02x}" for e in es), error, lab))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by[lab], digest) for i, c, e, lab in told), key=str)


@pytest.mark.parametrize("n, width", [(9, 16), (300, 24), (60, 13)])
def test_codes_equal_plain_rounds(spark, monkeypatch, n, width):
    monkeypatch.setattr(codes, "BLOCK", 32)
    rng = np.random.default_rng(n)
    made = [(i, [float(x) for x in rng.normal(size=width).round(2)], ["a", "b", None][i % 3]) for i in range(n)]
    made += [(3, made[3][1], "a"), (3, made[4][1], "b"), (None, made[5][1], None), (n + 1, None, "a"), (n + 2, [float("nan")] * width, "a"), (n + 3, [1.0, None], None), (n + 4, [float("-inf")], "b"), (n + 5, [0.5, -1.5], "c"), (n + 6, [], "c"), (n + 7, [1e9] * 3 + [-1e30], "d")]
    df = spark.createDataFrame([(*r, "k", "u", "n") for r in made], SCHEMA)
    got = sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.compress(df).collect()), key=str)
    assert got == plain_codes(made)
    assert all(not t.name.startswith("codes_") for t in spark.catalog.listTables())


def test_codes_of_nothing_and_of_equal_vectors(spark):
    assert codes.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    same = spark.createDataFrame([(i, [0.25] * 8, None) for i in range(40)], "vec_id long, embedding array<float>, label string")
    assert {(r.code, r.error, r.label_error) for r in codes.compress(same).collect()} == {("00" * 8, 0, 0)}


def test_changes_are_what_came_and_left():
    rng = np.random.default_rng(2)
    rows, old, new = rng.integers(-50, 50, (40, 3, 2)), rng.integers(0, 4, (40, 3)), rng.integers(0, 4, (40, 3))
    for before in (None, old):
        got = {(c["part"], c["entry"]): (c["n"], c["sums"]) for c in codes.changes(rows, before, new, 4)}
        for p in range(3):
            for e in range(4):
                came, left = new[:, p] == e, np.zeros(40, bool) if before is None else before[:, p] == e
                want = int(came.sum() - left.sum()), (rows[came, p].sum(0) - rows[left, p].sum(0)).tolist()
                assert got.get((p, e), (0, [0, 0])) == want
    assert codes.changes(rows, old, old, 4) == []


@pytest.mark.parametrize("name", ["op11_resample", "op12_codes", "op13_near_vectors"])
def test_queries_equal_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = queries.QUERIES[name](spark, folder)
    rel = con.sql(queries.ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in df.columns]
    assert len(rel.columns) == len(df.columns)
    got = df.select(*(F.col(c).cast("string") for c in df.columns)).collect()
    text = lambda v: v if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    assert sorted(map(tuple, got), key=str) == sorted((tuple(text(r[i]) for i in at) for r in rel.fetchall()), key=str)
