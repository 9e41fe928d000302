"""A training corpus from raw documents: quality rules, near-dedup, substring dedup, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A
stage works on all that its predecessor kept. Stages don't read ``sf_dir`` themselves: what they need to know of a corpus
(language references, repeats, source sizes) they take from the documents they are given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import bpe, mixing, passages, rules, scratch, simhash
from assayer.llm.queries import RANKS, WORD
from assayer.shipping import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the rules reject go. Null texts go with the short ones."""
    ship(spark)
    return rules.judge(docs).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of documents that are alike in 0.8 or more of their five-word shingles the one with the smallest id stays.

    Of equal ids the text with the smaller hash stays, of equal rows one. Null ids come after all others.
    """
    ship(spark)
    keyed = docs.withColumn("__key", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")))
    near = simhash.near_documents(keyed.select("__key", "text"), width=5, similarity=0.8, id="__key")
    stays = scratch.cut(near.where("__key = component").groupBy(F.col("component").alias("__stays")).agg(F.count("*").alias("__rows")), "stays")
    kept = keyed.join(stays, keyed["__key"] == stays["__stays"]).select("__key", *docs.columns)
    if stays.where("__rows > 1").limit(1).count():
        kept = kept.dropDuplicates(["__key"])
    return kept.select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: words of passages of 35 words or more that recur go; texts without such words stay as they are.

    A document of which no word is left goes. Where words go, the others are joined by one space and ``n_chars`` is theirs.
    """
    ship(spark)
    left = passages.remove(docs, window=35).where("n_words > n_removed")
    changed = left.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    return changed.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: sources by code point weigh 5, 2, 1 in turn; a document comes out as often as the mix takes it.

    Null sources are one source, the last; null texts have no words, and come out once. An empty table stays empty.
    """
    ship(spark)
    return mixing.repeat(docs, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)), weights=(5, 2, 1), budget=1.5, most=2.0)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: byte-level BPE ids of whole texts, and whether they decode to the text again.

    A row for each row; a null text counts as empty and has no ids. Rows that repeat an id keep a row each.
    """
    ship(spark)
    path = public_tokenizers.path(RANKS)
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256).alias("sha256"), "text"), path, public_tokenizers.PATTERN, drop_text=True)
    decoded = bpe.decode(encoded, path, public_tokenizers.PATTERN)
    return decoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("sha256")).alias("round_trip"))


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("substring dedup", substring_dedup), ("mixing", mix_sources), ("token ids", token_ids)]

#: Nearest languages, sketches, automata, Newton iterations and merges can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = scratch.cut(stage(spark, docs, sf_dir), f"stage{n}")
    return docs
