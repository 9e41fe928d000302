"""Citing evidence: the best span for each sentence, markers, references and evidence packs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import alignment

WINDOW, STEP, THRESHOLD, EXCERPT = 500, 125, 55.0, 120
#: Sentences of an answer that meet a chunk in one row.
TOGETHER = 64


def windows(chunks: DataFrame, body: str = "text") -> DataFrame:
    """Append ``window`` and ``start``: WINDOW characters every STEP; a shorter text whole. No window reaches past the end."""
    starts = F.when(F.length(body) <= WINDOW, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.length(body) - WINDOW, F.lit(STEP)))
    return chunks.withColumn("start", F.explode(starts)).withColumn("window", F.substr(F.col(body), F.col("start") + 1, F.lit(WINDOW)))


def partial_ratio(a: Column, b: Column) -> Column:
    """Similarity (0 to 100) of the shorter string with the stretch of the longer that fits it best (``alignment.partial_ratios``); null: 0."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(alignment.partial_ratios(x.tolist(), y.tolist()), dtype="float64")

    return ratio(a, b)


def best_windows(sentences: Column, body: Column, least: float) -> Column:
    """For an array of sentences, (start, score) of the window of a text that fits each best; see ``alignment.best_windows``."""

    @F.pandas_udf("array<struct<start int, score double>>")
    def best(ss: pd.Series, ts: pd.Series) -> pd.Series:
        found = alignment.windows_of_rows([[] if own is None else list(own) for own in ss], [t or "" for t in ts], WINDOW, STEP, least)
        return pd.Series([[{"start": a, "score": b} for a, b in own] for own in found])

    return best(sentences, body)


def word_overlap(a: Column, b: Column) -> Column:
    """A lexical score without Python: shared words of the sentence, 0 to 100."""
    wa, wb = text.words(text.normalize(a)), text.words(text.normalize(b))
    return F.when(F.size(wa) > 0, 100.0 * F.size(F.array_intersect(wa, wb)) / F.size(wa)).otherwise(0.0)


def dual_score(lexical: Column, cosine: Column | None = None) -> Column:
    """Half lexical, half semantic (a cosine clamped to [0, 1]); lexical alone without one."""
    if cosine is None:
        return lexical
    return F.when(cosine.isNull(), lexical).otherwise(0.5 * lexical + 50.0 * F.least(F.greatest(cosine, F.lit(0.0)), F.lit(1.0)))


def cite(answers: DataFrame, chunks: DataFrame, query: str = "query_id", lexical: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(query, sentence_at, sentence, chunk_id, start, span, score, confidence, citation_id): the best window for each sentence.

    Reads answer; of chunks chunk_id, rank, text. Windows are scored by ``partial_ratio``: an answer's sentences meet each of
    its chunks in rows of TOGETHER, and each is aligned once with the whole chunk, whose windows read their scores from that. With ``lexical``,
    a function of (sentence, window) columns, every window is a row instead. Transitional sentences cite nothing; scores under THRESHOLD
    are dropped; of equal scores the earlier chunk and window wins. Ids count the accepted sentences of an answer.
    """
    if lexical:
        split = answers.select(query, F.posexplode(text.sentences(F.col("answer"))).alias("sentence_at", "sentence")).where(~text.is_transition(F.col("sentence")))
        scored = split.join(windows(chunks.select(query, "chunk_id", "rank", "text")), query).withColumn("score", lexical(F.col("sentence"), F.col("window")))
    else:
        held = F.filter(F.transform(text.sentences(F.col("answer")), lambda s, i: F.struct(i.alias("at"), s.alias("s"))), lambda x: ~text.is_transition(x["s"]))
        parts = F.transform(F.sequence(F.lit(0), F.size("own") - 1, F.lit(TOGETHER)), lambda i: F.slice("own", i + 1, F.lit(TOGETHER)))
        some = answers.select(query, held.alias("own")).where(F.size("own") > 0).select(query, F.explode(parts).alias("own"))
        tasks = int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, since few bytes mean much work here
        met = some.join(chunks.select(query, "chunk_id", "rank", "text"), query).repartition(tasks)
        found = met.withColumn("found", best_windows(F.col("own.s"), F.col("text"), THRESHOLD))
        flat = found.select(query, "chunk_id", "rank", "text", F.inline(F.arrays_zip("own", "found")))
        scored = flat.select(query, "chunk_id", "rank", F.col("own.at").alias("sentence_at"), F.col("own.s").alias("sentence"), "found.start", F.substr("text", F.col("found.start") + 1, F.lit(WINDOW)).alias("window"), "found.score")
    best = scored.where(F.col("score") >= THRESHOLD).groupBy(query, "sentence_at", "sentence").agg(F.max_by(F.struct("chunk_id", "start", "window", "score"), F.struct("score", -F.col("rank"), -F.col("start"))).alias("b"))
    kept = best.select(query, "sentence_at", "sentence", "b.chunk_id", "b.start", F.col("b.window").alias("span"), "b.score", F.round(F.col("b.score") / 100, 4).alias("confidence"))
    return kept.withColumn("citation_id", F.row_number().over(Window.partitionBy(query).orderBy("sentence_at")))


def marked_answers(answers: DataFrame, citations: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, marked): sentences joined by blanks, each with the [n] of its citations."""
    split = answers.select(query, F.posexplode(text.sentences(F.col("answer"))).alias("sentence_at", "sentence"))
    marks = citations.groupBy(query, "sentence_at").agg(F.array_join(F.transform(F.array_sort(F.collect_list("citation_id")), lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "").alias("marks"))
    told = split.join(marks, [query, "sentence_at"], "left").withColumn("s", F.concat("sentence", F.coalesce("marks", F.lit(""))))
    return told.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence_at", "s"))), lambda x: x["s"]), " ").alias("marked"))


def excerpt(span: Column) -> Column:
    flat = F.trim(F.replace(span, F.lit("\n"), F.lit(" ")))
    return F.when(F.length(flat) <= EXCERPT, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, EXCERPT - 3)), F.lit("...")))


def references(citations: DataFrame, query: str = "query_id", source: str = "source") -> DataFrame:
    """(query, refs): a line for each citation under a heading."""
    line = F.concat(F.lit("["), F.col("citation_id").cast("string"), F.lit("] Source: "), F.coalesce(F.col(source), F.lit("Unknown source")), F.lit(' | "'), excerpt(F.col("span")), F.lit('"'))
    held = citations.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("citation_id", line.alias("l")))).alias("ls"))
    return held.select(query, F.concat(F.lit("References\n----------\n"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n")).alias("refs"))


def evidence_pack(citations: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, citations, chunk_map): the citations in order, and the text of each cited chunk's span."""
    item = F.struct("citation_id", "sentence", "chunk_id", "start", "score", "confidence")
    return citations.groupBy(query).agg(F.array_sort(F.collect_list(item)).alias("citations"), F.map_from_entries(F.array_distinct(F.collect_list(F.struct(F.col("citation_id").alias("k"), F.struct("chunk_id", "span").alias("v"))))).alias("chunk_map"))
