"""Scores of retrieval, answers and detection."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import scan
from .stored import stored

#: Answers of a block that resamples draw from, and runs of resamples that a block is sent to.
DRAWN_FROM, RUNS = 1 << 16, 32
#: Messages that are hashed side by side.
HASHED = 1 << 13
#: Fixed values of MD5 (RFC 1321).
MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
MD5_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
MD5_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)


def confusion(df: DataFrame, flagged: Column, truth: Column, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, tn, fn, precision, recall, f1 and accuracy; a denominator of 0 counts as 1 (1e-8 for f1)."""
    cells = df.groupBy(*by).agg(
        F.count_if(flagged & truth).alias("tp"), F.count_if(flagged & ~truth).alias("fp"), F.count_if(~flagged & ~truth).alias("tn"), F.count_if(~flagged & truth).alias("fn"),
    )
    one = F.lit(1)
    told = cells.withColumn("precision", F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one)).withColumn("recall", F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one))
    told = told.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-8)))
    return told.withColumn("accuracy", (F.col("tp") + F.col("tn")) / F.greatest(F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"), one))


def positive_share(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, accuracy): the share of pairs whose score is above 0."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.coalesce(F.col(score), F.lit(0)) > 0).cast("double")).alias("accuracy"))


def ranked_quality(df: DataFrame, query: str, k: int) -> DataFrame:
    """(query, recall, precision, mrr, ndcg) at k of rows with ``rank`` and ``relevant`` (0 or 1); 0 without relevant rows."""
    hit, gain = F.col("relevant") * (F.col("rank") <= k).cast("int"), F.col("relevant") / F.log2(F.col("rank") + 1)
    got = df.groupBy(query).agg(
        F.sum(hit).alias("hits"), F.sum("relevant").alias("all"), F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first"), F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("all"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1)))
    some = lambda c: F.when(F.col("all") > 0, c).otherwise(0.0)
    return got.select(query, some(F.col("hits") / F.greatest("all", F.lit(1))).alias("recall"), (F.col("hits") / F.lit(k)).alias("precision"), some(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), some(F.col("dcg") / ideal).alias("ndcg"))


def split_draws(b: int, sizes: np.ndarray) -> np.ndarray:
    """How many draws of resample ``b`` fall on each block: one multinomial draw of as many as there are answers, seeded by md5."""
    seed = int.from_bytes(hashlib.md5(f"{b}:split".encode()).digest()[:8], "big")
    return np.random.default_rng(seed).multinomial(int(sizes.sum()), sizes / sizes.sum())


def md5_heads(head: bytes, n: int) -> np.ndarray:
    """The first 32 bits of md5(head followed by j) for j from 1 to n, as unsigned integers; messages of one length are hashed side by side.

    A message has at most 55 bytes.
    """
    out, start = np.empty(n, np.uint32), 1
    while start <= n:
        stop = min(n + 1, 10 ** len(str(start)), start + HASHED)
        j, size = np.arange(start, stop, dtype=np.uint32), len(head) + len(str(start))
        words = np.zeros((16, len(j)), np.uint32)
        signs = [*head, *(j // np.uint32(10 ** (len(str(start)) - 1 - i)) % np.uint32(10) + np.uint32(48) for i in range(len(str(start)))), 0x80]
        for i, sign in enumerate(signs):
            words[i // 4] |= np.uint32(sign) << np.uint32(8 * (i % 4))
        words[14] = 8 * size
        a, b, c, d = (np.full(len(j), x, np.uint32) for x in MD5_START)
        for i in range(64):
            turn = i // 16
            f = d ^ b & (c ^ d) if turn == 0 else c ^ d & (b ^ c) if turn == 1 else b ^ c ^ d if turn == 2 else c ^ (b | ~d)
            g = (i, 5 * i + 1, 3 * i + 5, 7 * i)[turn]
            f += a
            f += words[g % 16]
            f += MD5_SINES[i]
            by = MD5_TURNS[turn][i % 4]
            a, d, c, b = d, c, b, b + (f << np.uint32(by) | f >> np.uint32(32 - by))
        out[start - 1 : stop - 1] = (a + np.uint32(MD5_START[0])).byteswap()
        start = stop
    return out


def bootstrap(df: DataFrame, value: str, order: str, draws: int, low: float = 0.025, high: float = 0.975, block: int = DRAWN_FROM) -> DataFrame:
    """(mean, ci_low, ci_high) of resampled means, of any number of answers.

    Answers are numbered in order by a scan and packed into blocks of a fixed size, so no array holds them all. A resample is a
    multinomial count for each block (``split_draws``), and that many draws within it: the same as drawing from all of them. Draw j within
    block p is value md5(b:p:j) mod its size (md5(b:j) in block 0). Blocks meet runs of resamples in tasks of their own, and a (block, resample)
    hands on one sum. So runs agree, wherever the partitions lie.
    Null values and an empty table: nulls aren't answers; without any there is no row.
    """
    answers = scan(df.where(F.col(value).isNotNull()).select(F.col(order).alias("o"), F.col(value).cast("double").alias("v"), F.lit(0).alias("k")), ["k"], ["o", "v"], number="n")
    packed = answers.groupBy(F.floor((F.col("n") - 1) / block).alias("p")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "v"))), lambda x: x["v"]).alias("vs"))
    packed = stored(packed, "blocks")
    sizes = np.array([r.n for r in packed.select("p", F.size("vs").alias("n")).orderBy("p").collect()], np.int64)
    runs = max(1, min(draws, RUNS))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                drawn = split_draws(b, sizes)
                p = np.flatnonzero(drawn)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), b)), pa.array(np.full(len(p), b % runs)), pa.array(p), pa.array(drawn[p])], names=["b", "run", "p", "drawn"])

    counts = df.sparkSession.range(draws if len(sizes) else 0).mapInArrow(split, "b long, run long, p long, drawn long")
    tasks = max(runs, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a number, since few bytes mean much work here
    sent = packed.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long")))).repartition(tasks, "p", "run")

    def draw(asked: pa.Table, block: pa.Table) -> pa.Table:
        values, sums = block["vs"].combine_chunks().values.to_numpy(zero_copy_only=False) if block.num_rows else np.zeros(0), []
        for b, p, drawn in zip(*(asked[c].to_pylist() for c in ("b", "p", "drawn")), strict=True):
            places = md5_heads(f"{b}:{p}:".encode() if p else f"{b}:".encode(), drawn)
            sums.append(float(values[places % np.uint32(len(values))].sum()))
        return pa.table({"b": asked["b"], "s": pa.array(sums, pa.float64())})

    dealt = [x.repartition(tasks, "p", "run").groupBy("p", "run") for x in (counts, sent)]
    drawn = dealt[0].cogroup(dealt[1]).applyInArrow(draw, "b long, s double")
    means = drawn.groupBy("b").agg((F.sum("s") / float(max(1, sizes.sum()))).alias("m"))
    held = means.agg(F.array_sort(F.collect_list("m")).alias("ms")).where(F.size("ms") > 0)  # a number for each resample
    at = lambda q: F.element_at("ms", F.lit(int(q * draws) + 1))
    mean = answers.agg(F.avg("v").alias("mean"))
    return held.crossJoin(mean).select("mean", at(low).alias("ci_low"), at(high).alias("ci_high"))


def faithfulness(answer: Column, evidence: Column, stop: Sequence[str]) -> Column:
    """Share of the answer's words, without stop words, that the evidence has; 1 without any."""
    split = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+)"))
    told = F.filter(split(answer), lambda w: ~w.isin(list(stop)))
    return F.when(F.size(told) == 0, 1.0).otherwise(F.size(F.filter(told, lambda w: F.array_contains(split(evidence), w))) / F.size(told))


def set_scores(found: Column, wanted: Column) -> tuple[Column, Column]:
    """Precision and recall of two sets; 1 where the set that divides is empty."""
    both = F.size(F.array_intersect(found, wanted))
    share = lambda s: F.when(F.size(F.array_distinct(s)) == 0, 1.0).otherwise(both / F.size(F.array_distinct(s)))
    return share(found), share(wanted)


def upper_median(value: str) -> Column:
    """The middle value; the upper of two. Values are counted before the shuffle, and so are equal ones of a group."""
    return F.expr(f"percentile_disc(0.5) within group (order by `{value}` desc)")


def group_advantage(df: DataFrame, group: str, reward: str) -> DataFrame:
    """(.., advantage): a reward's distance from its group's mean in sample deviations; groups without spread go."""
    by = df.groupBy(group).agg(F.avg(reward).alias("__mean"), F.stddev_samp(reward).alias("__std")).where("__std >= 1e-8")
    return df.join(by, group).withColumn("advantage", (F.col(reward) - F.col("__mean")) / (F.col("__std") + 1e-8)).drop("__mean", "__std")


def judge_scores(df: DataFrame, query: str) -> DataFrame:
    """(query, material_min, contextual_mean, aggregate, route): 0.7 of the weakest material claim, 0.3 of the others' mean.

    Both default to 1. A material claim at 0 means abstained; 0.9 or more approved; else revised.
    """
    score = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    got = df.groupBy(query).agg(F.coalesce(F.min(F.when(F.col("claim_type") == "material", score)), F.lit(1.0)).alias("material_min"), F.coalesce(F.avg(F.when(F.col("claim_type") != "material", score)), F.lit(1.0)).alias("contextual_mean"))
    told = got.withColumn("aggregate", 0.7 * F.col("material_min") + 0.3 * F.col("contextual_mean"))
    return told.withColumn("route", F.when(F.col("material_min") == 0, "abstained").when(F.col("aggregate") >= 0.9, "approved").otherwise("revised"))
