"""Claims of an answer, their verification, challenges and the judge."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics
from .stored import stored

LIMIT = 800


def split_claims(df: DataFrame, query: str = "query_id", body: str = "answer") -> DataFrame:
    """(query, claim_id, claim): numbered items, else bullets, else the first 500 characters of the answer."""
    item = lambda mark: F.filter(F.transform(F.regexp_extract_all(body, F.lit(rf"(?:^|\n)\s*{mark}\s+([^\n]+(?:\n(?!\s*{mark})[^\n]+)*)"), F.lit(1)), lambda s: F.trim(s)), lambda s: s != "")
    numbered, bullets = item(r"\d+[\.\)]"), item(r"[-*•]")
    claims = F.when(F.size(numbered) > 1, numbered).when(F.size(bullets) > 1, bullets).otherwise(F.array(F.substring(body, 1, 500)))
    return df.select(query, F.posexplode(claims).alias("at", "claim")).select(query, (F.col("at") + 1).alias("claim_id"), "claim")


def pack(body: Column, limit: int = LIMIT) -> Column:
    """Segments of a long answer: list items, else sentences, joined by blanks up to ``limit`` characters each."""
    trimmed = lambda c: F.filter(F.transform(c, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    items, lines = trimmed(F.split(body, r"(?=\n\s*\d+[\.\)]|\n\s*[-*•])")), trimmed(F.split(body, r"(?<=[.;])\s+"))
    parts = F.when(F.size(items) > 1, items).otherwise(lines)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(state: Column, part: Column) -> Column:
        full = (state["now"] != "") & (F.length(state["now"]) + F.length(part) + 1 > limit)
        joined = F.when(state["now"] == "", part).otherwise(F.concat(state["now"], F.lit(" "), part))
        return F.struct(F.when(full, F.concat(state["done"], F.array(state["now"]))).otherwise(state["done"]).alias("done"), F.when(full, part).otherwise(joined).alias("now"))

    packed = F.aggregate(parts, start, add, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))
    return F.when(F.length(body) <= limit, F.array(body)).otherwise(packed)


def verified(claims: DataFrame, verdicts: DataFrame, query: str = "query_id") -> DataFrame:
    """Claims with ``verdict`` and ``confidence`` (clipped to [0, 1]); claims without a verdict are partial at 0.5, verdicts
    on unknown claims are dropped."""
    sure = F.least(F.greatest(F.coalesce("confidence", F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    return claims.join(verdicts.select(query, "claim_id", "verdict", "confidence"), [query, "claim_id"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("PARTIAL"))).withColumn("confidence", sure)


def judged(claims: DataFrame, scores: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, claim_id, claim_type, score): the judge's scores; claims without one get 0.5, scores of unknown claims count
    as contextual."""
    joined = claims.select(query, "claim_id", "claim_type").join(scores.select(query, "claim_id", "score"), [query, "claim_id"], "full")
    return joined.select(query, "claim_id", F.coalesce("claim_type", F.lit("contextual")).alias("claim_type"), F.coalesce("score", F.lit(0.5)).alias("score"))


def to_challenge(claims: DataFrame) -> DataFrame:
    return claims.where("verdict = 'SUPPORTED'")


def early_exit(claims: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, done): all material claims are supported at 0.95 or more."""
    sure = (F.col("verdict") == "SUPPORTED") & (F.col("confidence") >= 0.95)
    return claims.where("claim_type = 'material'").groupBy(query).agg(F.bool_and(sure).alias("done"))


def routed(claims: DataFrame, scores: DataFrame, signals: DataFrame, query: str = "query_id") -> DataFrame:
    """The judge's aggregate and route with ``corrections``: up to five of its signals, for answers to revise."""
    held = signals.groupBy(query).agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "signal"))), lambda x: x["signal"]), 1, 5), "; ").alias("corrections"))
    told = metrics.judge_scores(judged(claims, scores, query), query).join(held, query, "left")
    return told.withColumn("corrections", F.when(F.col("route") == "revised", F.concat(F.lit("[Corrections needed: "), "corrections", F.lit("]"))))


def debate_summary(verdicts: DataFrame) -> DataFrame:
    """Counts of verdicts, the flagged share and mean confidence over all claims."""
    flagged = F.col("verdict").isin("NOT_SUPPORTED", "PARTIAL")
    return verdicts.agg(F.count("*").alias("claims"), F.count_if(F.col("verdict") == "SUPPORTED").alias("supported"), F.count_if(flagged).alias("flagged"), F.avg(flagged.cast("double")).alias("flagged_share"), F.avg("confidence").alias("confidence"))


#: Rounds of challenge and revision; verdicts that a revision may give.
CYCLES, VERDICTS = 2, ("SUPPORTED", "NOT_SUPPORTED", "PARTIAL")


def revised(claims: DataFrame, revisions: DataFrame, query: str = "query_id") -> DataFrame:
    """Claims with the verdicts and confidences of a reviser's rows (query, claim_id, verdict, confidence).

    Spelling of verdicts doesn't matter; an unknown or missing one leaves the verdict, a missing confidence the confidence; others are
    clipped to [0, 1]. Rows on unknown claims don't count; of several on a claim one does. The claims' words never change.
    """
    told = revisions.select(F.col(query).alias("__q"), F.col("claim_id").alias("__c"), F.upper("verdict").alias("__v"), F.col("confidence").alias("__s")).dropDuplicates(["__q", "__c"])
    joined = claims.join(told, (F.col(query) == F.col("__q")) & (F.col("claim_id") == F.col("__c")), "left")
    verdict = F.when(F.col("__v").isin(*VERDICTS), F.col("__v")).otherwise(F.col("verdict"))
    return joined.withColumn("verdict", verdict).withColumn("confidence", F.least(F.greatest(F.coalesce("__s", "confidence"), F.lit(0.0)), F.lit(1.0))).select(*claims.columns)


def debated(claims: DataFrame, challenger: Callable[[DataFrame, int], DataFrame], reviser: Callable[[DataFrame, DataFrame, int], DataFrame], query: str = "query_id", cycles: int = CYCLES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verified claims after up to ``cycles`` of challenge and revision; the challenges; and (query, cycles, challenges).

    Reads of claims query, claim_id, claim_type, verdict and confidence. A query leaves before a challenge once all its material claims
    are surely supported (``early_exit``), and after one that raises nothing; all others go into the next cycle. ``challenger`` gets the supported
    claims of the queries in debate and the cycle from 1, and gives (query, claim_id, ..); ``reviser`` gets the claims of challenged queries, the challenges and the
    cycle, and gives rows for ``revised``. Both stand for a model. Each cycle works on the queries that are still in it alone and is written, so a
    cycle's plan reads what the one before has written. Challenges have ``cycle``, ``confidence_before`` and ``confidence_after``.
    """
    now, done, log = stored(claims, "claims"), [], []
    counts = claims.select(query).distinct().select(query, F.lit(0).alias("cycles"), F.lit(0).cast("long").alias("challenges"))
    for cycle in range(1, cycles + 1):
        sure = early_exit(now, query).where("done").select(query)
        active = now.join(sure, query, "left_anti")
        raised = stored(challenger(to_challenge(active), cycle), "challenges")
        more = now.select(query).distinct().join(raised.groupBy(query).agg(F.count("*").alias("n")), query, "left").select(F.col(query).alias("__q"), F.coalesce("n", F.lit(0)).alias("n"))
        counts = counts.join(more, F.col(query) == F.col("__q"), "left").select(query, (F.col("cycles") + F.col("n").isNotNull().cast("int")).alias("cycles"), (F.col("challenges") + F.coalesce("n", F.lit(0))).alias("challenges"))
        if not raised.limit(1).count():
            break
        met = raised.select(query).distinct()
        before = now.join(met, query, "left_semi")
        after = stored(revised(before, reviser(before, raised, cycle), query), "claims")
        sided = [c.select(F.col(query).alias(f"__q{i}"), F.col("claim_id").alias(f"__c{i}"), F.col("confidence").alias(name)) for i, (c, name) in enumerate(((before, "confidence_before"), (after, "confidence_after")))]
        told = raised.withColumn("cycle", F.lit(cycle))
        for i, c in enumerate(sided):
            told = told.join(c, (F.col(query) == F.col(f"__q{i}")) & (F.col("claim_id") == F.col(f"__c{i}")), "left").drop(f"__q{i}", f"__c{i}")
        log.append(told)
        done.append(now.join(met, query, "left_anti"))
        now = after
    whole = reduce(DataFrame.unionByName, [*done, now])
    none = claims.select(query, "claim_id").limit(0).select("*", F.lit(0).alias("cycle"), F.lit(0.0).alias("confidence_before"), F.lit(0.0).alias("confidence_after"))
    return whole, reduce(DataFrame.unionByName, log) if log else none, counts
