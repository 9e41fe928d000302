"""The registered corpus queries on the smallest tables: columns, types, and values against plain Python, the libraries or DuckDB."""

import hashlib
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from assayer.llm import bpe, media, queries
from tests.llm.test_dedup import plain_print
from tests.llm.test_judgement import plain_counts

FOLDER = "/root/testdata/sf0.001"
TYPES = {
    "op1_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op2_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op3_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op4_shard": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op5_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_passages": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op8_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_telephony": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op10_divergence_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def told(spark):
    made = {}

    def get(name):
        if name not in made:
            df = queries.QUERIES[name](spark, FOLDER)
            made[name] = dict(df.dtypes), {r.doc_id: r for r in df.collect()}, df.count()
        return made[name]

    return get


@pytest.mark.parametrize("name", sorted(TYPES))
def test_columns_and_rows(told, texts, name):
    types, rows, n = told(name)
    wanted = dict(c.split() for c in TYPES[name].split(", "))
    assert {c: types[c] for c in wanted} == wanted and n == len(texts) and set(rows) == set(texts)
    assert not any(v is None for r in rows.values() for c, v in r.asDict().items() if c in wanted and c != "grown_shard")


def test_mixed_words_come_near_their_targets(told, texts):
    rows = told("op1_mix_sources")[1]
    by = {}
    for i, r in rows.items():
        assert r["size"] == len(texts[i].encode().split()) and r.taken in (0, r["size"], 2 * r["size"])
        by.setdefault((r.source_size, r.target), []).append(r)
    assert all(sum(r["size"] for r in rs) % size == 0 and abs(sum(r.taken for r in rs) / (sum(r["size"] for r in rs) / size) - target) <= max(r["size"] for r in rs) for (size, target), rs in by.items() if size)


def test_ids_are_those_of_the_libraries(told, texts):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(open(P.path(queries.RANKS), "rb").read()), special_tokens={})
    words, at = Tokenizer.from_file(P.path(queries.WORD_TOKENIZER)), 0
    for i in sorted(texts):
        ids, r = library.encode_ordinary(texts[i]), told("op2_byte_bpe")[1][i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest())
        ids, r = words.encode(texts[i], add_special_tokens=False).ids + [2], told("op3_token_files")[1][i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_shards_hold_groups_and_gapless_slots(told, texts):
    rows = told("op4_shard")[1]
    places, slots = {}, {}
    for i, r in rows.items():
        assert (r["size"], r.text_crc32, r.law) == (len(texts[i].encode()) + 1, zlib.crc32(texts[i].encode()), "bytes") and 0 <= r.shard < 16
        assert places.setdefault(texts[i], r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_prints_and_components(told, texts):
    prints = {i: plain_print(t, 3) for i, t in texts.items()}
    label = {i: i for i in texts}
    for _ in texts:
        before = dict(label)
        for i in texts:
            label[i] = min(label[j] for j in texts if bin(prints[i] ^ prints[j]).count("1") <= 2)
        if label == before:
            break
    assert {i: (r.fingerprint, r.component_id) for i, r in told("op5_simhash")[1].items()} == {i: (f"{prints[i]:016x}", label[i]) for i in texts}


def test_passages_equal_their_sql(told):
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    rel = con.sql(queries.ORACLE_SQL["op7_passages"])
    want = {r[rel.columns.index("doc_id")]: dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()}
    assert {i: r.asDict() for i, r in told("op7_passages")[1].items()} == want


def test_folds_scores_and_predictions(told):
    for name, cut in (("op6_toxicity", 0.5), ("op8_quality", 0.3)):
        for i, r in told(name)[1].items():
            assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= cut)


def test_media_and_base_counts(told, texts):
    tags = sorted(media.CODINGS.values())
    for i, t in texts.items():
        raw = t.encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        stored = media.wav(payload, tags[zlib.crc32(payload) % 3])
        r = told("op9_telephony")[1][i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
        r = told("op10_divergence_rules")[1][i]
        if len(t) < 9000:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    copies = Counter(texts.values())
    features = {}
    for i, r in told("op9_telephony")[1].items():
        if copies[texts[i]] > 1:
            assert features.setdefault(texts[i], r.feature) == r.feature
