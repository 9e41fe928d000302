"""Deterministic splits and samples, and training pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parsing


def shuffle_key(seed: int, *columns: str) -> Column:
    """A hash to shuffle by: md5 of the columns and the seed."""
    return F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in columns), F.lit(str(seed))))


def split(df: DataFrame, seed: int, share: float, *columns: str) -> DataFrame:
    """Append ``part``: 'train' for about ``share`` of the rows, by the first digits of the shuffle key, else 'test'."""
    place = F.conv(F.substring(shuffle_key(seed, *columns), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("part", F.when(place < int(share * (1 << 32)), "train").otherwise("test"))


def sample_per_group(df: DataFrame, group: str, k: int, seed: int, *columns: str) -> DataFrame:
    """At most k rows of each group, the first by shuffle key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(shuffle_key(seed, *columns)))).where(F.col("__n") <= k).drop("__n")


def triplets(chunks: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """(query, positive_id, negative_id): a query's relevant chunks with up to k of its sampled irrelevant ones.

    Reads query_id, chunk_id, text, relevant; texts under 20 characters are left out.
    """
    long = chunks.where(F.length("text") >= 20)
    negatives = sample_per_group(long.where("relevant = 0"), "query_id", k, seed, "query_id", "chunk_id")
    return long.where("relevant = 1").select("query_id", F.col("chunk_id").alias("positive_id")).join(negatives.select("query_id", F.col("chunk_id").alias("negative_id")), "query_id")


def answer_rows(pairs: DataFrame) -> DataFrame:
    """Two rows for each question pair: the true answer, and the hallucinated one with ``is_hallucinated``."""
    both = F.array(F.struct(F.col("ground_truth").alias("answer"), F.lit(False).alias("is_hallucinated")), F.struct(F.col("hallucinated").alias("answer"), F.lit(True).alias("is_hallucinated")))
    rest = [c for c in pairs.columns if c not in ("ground_truth", "hallucinated")]
    return pairs.select(*rest, F.explode(both).alias("a")).select(*rest, "a.answer", "a.is_hallucinated")


def preference_pairs(results: DataFrame, truth: DataFrame) -> DataFrame:
    """(patient_id, query_index, chosen, rejected): verdicts to prefer for saved answers.

    A grounded answer (nothing hallucinated, F1 of 0.5 or more) should be approved, not abstained from; one with over 0.1
    hallucinated should be revised, not approved. Reads hallucination_rate and f1 of ``truth``; a missing one counts as 0.
    """
    joined = results.join(truth.select("patient_id", "query_index", "hallucination_rate", "f1"), ["patient_id", "query_index"], "left").na.fill(0.0, ["hallucination_rate", "f1"])
    pair = lambda cond, a, b: joined.where(cond).select("patient_id", "query_index", F.lit(a).alias("chosen"), F.lit(b).alias("rejected"))
    return pair("hallucination_rate = 0 and f1 >= 0.5", "APPROVED", "ABSTAINED").unionByName(pair("hallucination_rate > 0.1", "REVISED", "APPROVED"))


def trajectories(pairs: DataFrame) -> DataFrame:
    """Two rows for each question pair with the targets that agents are trained to: low confidence and a challenge for the
    hallucinated answer, the reverse for the true one."""
    bad = F.col("is_hallucinated")
    rows = answer_rows(pairs)
    return rows.select(
        "*", F.when(bad, "not_supported").otherwise("supported").alias("expected_verdict"), F.when(bad, 0.1).otherwise(0.95).alias("verifier_target_confidence"),
        bad.alias("challenger_should_challenge"), F.when(bad, 0.0).otherwise(1.0).alias("judge_target_score"),
    )


def detected(pairs: DataFrame, responses: DataFrame, key: str = "pair_id") -> DataFrame:
    """Both answers of each question with what each detector said of them: (.., answer, is_hallucinated, detector, is_flagged).

    ``responses`` has key, is_hallucinated, detector and is_flagged. An answer that no detector has seen keeps a row without one; responses to unknown
    answers are dropped.
    """
    rows = answer_rows(pairs)
    said = responses.select(F.col(key).alias("__key"), F.col("is_hallucinated").alias("__bad"), "detector", "is_flagged")
    return rows.join(said, (F.col(key) == F.col("__key")) & (F.col("is_hallucinated") == F.col("__bad")), "left").drop("__key", "__bad")


def pipeline_trajectories(runs: DataFrame) -> DataFrame:
    """Append verifier_correct, challenger_correct and shared_reward to runs of the agents (is_hallucinated, verifier_output, challenger_output).

    A verifier is right if it does not support a hallucinated answer, or supports a true one; an output without a verdict is
    wrong. A challenger is right if it challenges a hallucinated answer alone. Null outputs are empty ones.
    """
    bad = F.coalesce("is_hallucinated", F.lit(False))
    verdict = F.lower(F.regexp_extract(F.coalesce("verifier_output", F.lit("")), r'"verdict"\s*:\s*"(\w+)"', 1))
    verifier = F.when(bad, verdict.isin("not_supported", "partial")).otherwise(verdict == "supported")
    said = F.coalesce("challenger_output", F.lit(""))
    challenger = (F.contains(said, F.lit("challenge_type")) & ~F.contains(said, F.lit("[]"))) == bad
    told = runs.withColumn("verifier_correct", verifier).withColumn("challenger_correct", challenger)
    return told.withColumn("shared_reward", parsing.trajectory_reward(F.col("verifier_correct"), F.col("challenger_correct")))


def qa_preferences(pairs: DataFrame, count: int, seed: int = 42, id: str = "pair_id") -> DataFrame:
    """(id, source, evidence, answer, chosen, rejected): two preference pairs of a critic for each question, ``count`` in all, questions by shuffle key.

    A hallucinated answer should be revised to the true one, not approved; a true one approved, not abstained from. Reads
    knowledge (array), ground_truth, hallucinated, difficulty and category. Verdicts are JSON objects.
    """
    passages = F.array_join(F.transform("knowledge", lambda k, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.substring(k, 1, 800))), "\n")
    none = F.lit(None).cast("string")
    said = lambda verdict, issues=None, revised=none, reason=None: F.to_json(F.struct(F.lit(verdict).alias("verdict"), (F.array(issues) if issues is not None else F.array().cast("array<string>")).alias("issues"), revised.alias("revised_text"), F.lit(reason).cast("string").alias("abstention_reason")), {"ignoreNullFields": "false"})
    invented = F.concat(F.lit("Answer contains hallucinated information ("), F.coalesce("category", F.lit("")), F.lit("). Key claims are not supported by the provided evidence."))
    bad = F.struct(F.lit(0).alias("nth"), F.col("hallucinated").alias("answer"), said("REVISED", invented, F.col("ground_truth")).alias("chosen"), said("APPROVED").alias("rejected"))
    good = F.struct(F.lit(1).alias("nth"), F.col("ground_truth").alias("answer"), said("APPROVED").alias("chosen"), said("ABSTAINED", F.lit("Insufficient evidence to verify all claims."), reason="Cannot verify claims against provided evidence.").alias("rejected"))
    rows = pairs.select(id, shuffle_key(seed, id).alias("__key"), F.concat(F.lit("medhallu_"), F.coalesce("difficulty", F.lit("medium"))).alias("source"), passages.alias("evidence"), F.explode(F.array(bad, good)).alias("p"))
    return rows.orderBy("__key", id, "p.nth").limit(count).select(id, "source", "evidence", "p.answer", "p.chosen", "p.rejected")


#: Targets of inference labels: verdict, confidence, judge's score. Numbers stand for labels in some files.
INFERENCE = {
    "entailment": ("supported", 0.9, 1.0), "contradiction": ("not_supported", 0.1, 0.0), "neutral": ("partial", 0.5, 0.5),
    "0": ("entailment", 0.9, 1.0), "1": ("neutral", 0.5, 0.5), "2": ("contradiction", 0.1, 0.0),
}


def inference_trajectories(pairs: DataFrame) -> DataFrame:
    """A trajectory for each pair (premise, hypothesis, label as text) with both parts: the targets of INFERENCE, partial at 0.5 for others."""
    known = F.create_map(*(x for k, (v, c, j) in INFERENCE.items() for x in (F.lit(k), F.struct(F.lit(v).alias("v"), F.lit(c).alias("c"), F.lit(j).alias("j")))))
    told = F.coalesce(known[F.lower(F.trim("label"))], F.struct(F.lit("partial").alias("v"), F.lit(0.5).alias("c"), F.lit(0.5).alias("j")))
    rows = pairs.where((F.coalesce("premise", F.lit("")) != "") & (F.coalesce("hypothesis", F.lit("")) != "")).withColumn("__t", told)
    return rows.select(
        *pairs.columns, F.col("hypothesis").alias("answer"), F.concat(F.lit("[1] "), "premise").alias("evidence"), F.col("__t.v").alias("expected_verdict"), F.col("__t.c").alias("verifier_target_confidence"),
        (F.col("__t.v") == "not_supported").alias("challenger_should_challenge"), F.col("__t.j").alias("judge_target_score"),
    )
