"""Importance resampling, against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import resampling

SEED, BUCKETS = 7, 500


def plain(rows, target, longest, share, least):
    """(id, n_features, weight, score, rank), by the words of each text."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower)) for _, t in rows]
    wanted = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower)) for t in target]
    runs = lambda ws: [zlib.crc32(" ".join(ws[i : i + n]).encode()) % BUCKETS for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]
    s, t = Counter(b for ws in words for b in runs(ws)), Counter(b for ws in wanted for b in runs(ws))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + BUCKETS) / ((s[b] + 1) * (all_t + BUCKETS)))) for b in set(s)}
    told = []
    for n, ((i, _), ws) in enumerate(zip(rows, words, strict=True)):
        h = int(hashlib.sha256(f"{SEED}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in runs(ws))
        told.append((i, len(runs(ws)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(ws), n))
    able = sorted((r for r in told if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {r[5]: k for k, r in enumerate(able[: len(able) * share[0] // share[1]], 1)}
    return sorted(((*r[:4], rank.get(r[5])) for r in told), key=str)


@pytest.mark.parametrize("longest, in_range, run", [(1, 1 << 15, 1 << 16), (2, 4, 1 << 16), (1, 7, 5)])
def test_draws_equal_a_plain_sort(docs, rows, spark, monkeypatch, longest, in_range, run):
    monkeypatch.setattr(resampling, "RUN", run)
    monkeypatch.setattr(resampling, "LOOKS", 2)
    target = [(r[1],) for r in rows[:9]] + [(None,), ("",)]
    df = spark.createDataFrame(target, "text string")
    got = resampling.resample(docs, df, SEED, (40, 100), 20, longest=longest, buckets=BUCKETS, rows_in_range=in_range)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    ids = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(ids, [t for (t,) in target], longest, (40, 100), 20)


def test_repeated_rows_spread_over_ranges(spark, monkeypatch):
    """A third of all rows are one row: bounds between ranges part them too."""
    monkeypatch.setattr(resampling, "LOOKS", 4)
    rows = [(7, "same words here again " * 6)] * 300 + [(i, f"w{i} x y z " * 6) for i in range(100, 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    seen = []
    held, resampling.sorted_runs = resampling.sorted_runs, lambda *a: seen.append(a[1]) or held(*a)
    try:
        got = resampling.resample(df, df.limit(40), SEED, (1, 2), 20, rows_in_range=40)
        ranks = sorted(r["rank"] for r in got.collect() if r["rank"])
    finally:
        resampling.sorted_runs = held
    assert ranks == list(range(1, 451)) and sum(b[2] == 7 for b in seen[0]) > 3


def test_odd_tables(spark, nothing):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(nothing, none, SEED).count() == 0
    some = spark.createDataFrame([(1, "a b"), (None, None), (3, "")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_features, r.weight, r["rank"]) for r in resampling.resample(some, none, SEED, (1, 1), 0).collect()), key=str) != []
    got = {r.doc_id: r for r in resampling.resample(some, none, SEED, (1, 1), 3).collect()}
    assert {i: (r.n_features, r["rank"]) for i, r in got.items()} == {1: (2, None), None: (0, None), 3: (0, None)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=6), min_size=1, max_size=9), st.integers(0, 60))
def test_tournaments_merge_runs(runs, n):
    keyed = [[(x, r, i) for i, x in enumerate(sorted(run))] for r, run in enumerate(runs)]
    tournament = resampling.Tournament(keyed)
    got = [keyed[r][i] for r, i in tournament.draw(n)]
    assert got == sorted(k for run in keyed for k in run)[:n]
    assert sum(tournament.at) == len(got)
