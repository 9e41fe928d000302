"""Byte-level BPE and token files, against the libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assayer.llm import bpe, encoder, scratch, token_files

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def known():
    return bpe.Vocabulary(open(RANKS, "rb").read(), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(open(RANKS, "rb").read()), special_tokens={})


def test_rows_encode_like_the_library_and_round_trip(docs, rows, library):
    got = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
        assert r.score == "clash"


def test_pieces_of_any_length(known, library):
    rng = random.Random(2)
    for n in (1, 2, 3, 5, 31, 512, 513, 2500):
        for letters in ("ab", "theing", "aé漢", "\U0001f600x"):
            piece = "".join(rng.choice(letters) for _ in range(n))
            want = library.encode_ordinary(piece)
            known.learn(set(known.split(piece)))
            flat, _ = known.encode([piece.encode()])
            assert flat.tolist() == want
            raw = piece.encode()
            whole = "".join(c for c in piece if c.isalpha())
            if len(whole) > 1 and whole.encode() not in known.ranks:
                want = library._encode_single_piece(whole.encode())
                assert np.frombuffer(known._merge_long(whole.encode()), np.int32).tolist() == want
                assert np.frombuffer(known._merge_rows([whole.encode()], len(whole.encode()))[0], np.int32).tolist() == want
            assert known.decode(np.array(flat)).tobytes() == raw


def test_null_ids_and_nothing(spark, nothing):
    df = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "doc_id long, ids array<int>")
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode(df, RANKS, P.PATTERN).collect()}
    assert got[1] == got[2] == b"" and len(got[3]) == 2
    assert bpe.encode(nothing, RANKS, P.PATTERN).count() == 0


def test_files_hold_what_the_library_gives(spark, docs, rows):
    content = open(WORDS).read()
    path = scratch.folder(spark, "files")
    token_files.write(docs, path, content, 2)
    got = token_files.read(spark, path).orderBy("start").collect()
    library = Tokenizer.from_str(content)
    assert [r.id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(library.encode(t, add_special_tokens=False).ids + [2])
    at = 0
    for r in got:
        ids = np.frombuffer(r.frame, "<u4").tolist()
        assert ids in want[r.id] and r.n_tokens == len(ids) and r.start == at
        at += len(ids)
    one = spark.read.parquet(f"{path}/index").where(F.col("id") == 69).first()
    assert token_files.read_one(path, one.file, one.offset, one.size).tolist() == want[69][0]


def test_files_name_their_dictionary(spark, docs):
    path = scratch.folder(spark, "files")
    token_files.write(docs, path, open(WORDS).read(), 2)
    token_files._put(f"{path}/dictionary", b"another")
    one = spark.read.parquet(f"{path}/index").first()
    with pytest.raises(ValueError, match="dictionary"):
        token_files.read_one(path, one.file, one.offset, one.size)


def test_files_of_nothing(spark, nothing):
    path = scratch.folder(spark, "files")
    token_files.write(nothing, path, open(WORDS).read(), 2)
    assert token_files.read(spark, path).count() == 0


def test_digests_are_of_the_ids(spark, docs):
    row = bpe.encode(docs.where("doc_id = 66"), RANKS, P.PATTERN).select(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("h"), "ids").first()
    assert row.h == hashlib.sha256(",".join(map(str, row.ids)).encode()).hexdigest()


def test_pieces_of_odd_texts_encode_like_the_library():
    content = open(WORDS).read()
    known, library = encoder.PieceEncoder(content), Tokenizer.from_str(content)
    rng = random.Random(1)
    units = ["the", "The", "é", "É", "ÿ", "×", "÷", "ß", "'", "'s", "'S", "'re", "’", "…", ".", ",", "!?", "|", "%%%", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "\n", "\t", "\u00a0", "\u3000", "漢字", "\u0301", "e\u0301", "İ", "5", "12", "_", "-", "s", "t", "ll", "\x00", "\x1c", "\x85", "\u0338", "<", ">", "😀", "\u200b", "x" * 70, "Σ"]
    texts = ["".join(rng.choice(units) for _ in range(rng.randint(0, 14))) for _ in range(8000)]
    texts += ["Don't stop,  word's 3.5 naïve İstanbul ﬁne <|endoftext|>x é   y z ΑΣ ab?! 12ab", "", " \t\n"]
    raw = [t.encode() for t in texts]
    for _ in range(2):  # new pieces, then known ones
        flat, counts = known.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
        got = np.split(flat, np.cumsum(counts)[:-1])
        assert all(g.tolist() == library.encode(t, add_special_tokens=False).ids for g, t in zip(got, texts, strict=True))


def test_pieces_beyond_the_memory(monkeypatch):
    monkeypatch.setattr(encoder, "REMEMBERED", 50)
    content = open(WORDS).read()
    known, library = encoder.PieceEncoder(content), Tokenizer.from_str(content)
    rng = random.Random(3)
    for _ in range(4):
        t = " ".join("".join(rng.choice("abcde") for _ in range(6)) for _ in range(90))
        flat, _ = known.encode(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
        assert flat.tolist() == library.encode(t, add_special_tokens=False).ids


def test_bytes_that_are_not_utf8(spark):
    df = spark.sql("select 1L as doc_id, cast(x'61FF62' as string) as text")
    content = open(WORDS).read()
    path = scratch.folder(spark, "bad")
    token_files.write(df, path, content, 2)
    assert np.frombuffer(token_files.read(spark, path).first().frame, "<u4").tolist() == Tokenizer.from_str(content).encode("a\ufffdb", add_special_tokens=False).ids + [2]
    assert bytes(bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).first().decoded) == "a\ufffdb".encode()
