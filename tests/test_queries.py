"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from assayer.plans import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value) + 0.0:.5f}"
    return str(value)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, db, name):
    df = queries.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    rel = db.sql(queries.SQL[name])
    at = {c: i for i, c in enumerate(rel.columns)}
    assert sorted(at) == names
    assert got == sorted(tuple(plain(r[at[c]]) for c in names) for r in rel.fetchall())


def test_corpus_queries_are_left_out_with_their_folder(tmp_path):
    import shutil
    import subprocess
    import sys

    here = Path(__file__).resolve().parents[1]
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    shutil.copytree(here / "assayer", tmp_path / "assayer", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, timeout=120).returncode == 0


def test_cited_replies_equal_a_plain_search(spark):
    import re

    from assayer.operators import chunking, retrieval
    from assayer.operators.alignment import lcs_length

    def ratio(a, b):
        best = 0.0
        for s, t in {(a, b), (b, a)} if len(a) == len(b) else {tuple(sorted((a, b), key=len))}:
            m = len(s)
            stretches = [t[i : i + m] for i in range(len(t) - m + 1)] + [t[:j] for j in range(1, m)] + [t[-j:] for j in range(1, m)]
            best = max(best, *(200 * lcs_length(s, w) / (m + len(w)) for w in stretches))
        return best

    rows = spark.read.parquet(f"{FOLDER}/documents.parquet")
    chunks = chunking.chunks(rows.selectExpr("doc_id as document_id", "'all' as patient_id", "'other' as section", "0 as pos", "text as body"))
    held = {r.chunk_id: (r.document_id, r.text) for r in chunks.collect()}
    docs = {r.doc_id: r.text or "" for r in rows.where("doc_id % 50 = 0").collect()}
    ranked = retrieval.bm25(rows.where("doc_id % 50 = 0").selectExpr("doc_id as query_id", "text"), chunks.select("chunk_id", "text"), [], 1000).collect()
    got = {(r.query_id, r.sentence_at): r for r in queries.QUERIES["cited_replies"](spark, FOLDER).collect()}
    seen = 0
    for q, text in docs.items():
        own = sorted((-round(r.score, 9), r.chunk_id) for r in ranked if r.query_id == q and held[r.chunk_id][0] != q)[:5]
        for at, sentence in [(at, s) for at, s in enumerate(s for s in (x.strip(" ") for x in re.split(r"(?<=[.?!])\s+", text)) if s) if len(s) < 200][:3]:
            if len(sentence.rstrip(".")) < 25:
                continue
            found = [(ratio(sentence, held[c][1][a : a + 500]), -rank, -a, c) for rank, (_, c) in enumerate(own) for a in ([0] if len(held[c][1]) <= 500 else range(0, len(held[c][1]) - 500 + 1, 125))]
            best, r = max(found), got.get((q, at))
            assert (r is None) == (best[0] < 55) and (r is None or (r.chunk_id, r.start, round(r.score, 6)) == (best[3], -best[2], round(best[0], 6)))
            seen += r is not None
    assert seen > 5


def test_overlap_of_replies_equals_the_table(spark):
    from tests.test_alignment import table

    said = {(r.conv_id, r.turn): (r.role, r.text or "") for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()}
    words = lambda t: "".join(c if c.isascii() and (c.isalnum() or c == "_") or c.isspace() or (not c.isascii() and c.isalnum()) else " " for c in t.lower()).split()
    got = {(r.conv_id, r.turn): r.rouge_l for r in queries.QUERIES["rouge_of_replies"](spark, FOLDER).collect()}
    ascii_only = {k for k, (role, t) in said.items() if role == "assistant" and (k[0], k[1] - 1) in said and (t + said[k[0], k[1] - 1][1]).isascii()}
    assert ascii_only and ascii_only <= set(got)
    for k in ascii_only:
        a, b = words(said[k][1]), words(said[k[0], k[1] - 1][1])
        n = table(a, b) if a and b else 0
        assert got[k] == (round(2 * n / (len(a) + len(b)), 4) if n else 0.0)


def test_verified_answers_drop_what_nobody_said(spark):
    rows = queries.QUERIES["verified_answers"](spark, FOLDER).collect()
    replies = spark.read.parquet(f"{FOLDER}/conversations.parquet").where("role = 'assistant'").count()
    assert len(rows) == replies > 0
    for r in rows:
        assert "quixotic zephyr" in r.removed and "quixotic" not in r.cleaned and not set(r.grounded) & set(r.removed)


def test_cited_replies_shuffle_no_chunk_texts_for_their_hits(spark, monkeypatch):
    from assayer.operators import citations

    monkeypatch.setattr(citations, "cite", lambda said, held: held)
    held = queries.QUERIES["cited_replies"](spark, FOLDER)
    plan = held._jdf.queryExecution().executedPlan().toString()
    texts = next(x for x in plan.split("\n") if "FileScan parquet" in x and "ReadSchema: struct<chunk_id:string,text:string>" in x)
    assert "BroadcastHashJoin" in plan and texts and held.groupBy("query_id").count().where("count > 5").count() == 0
