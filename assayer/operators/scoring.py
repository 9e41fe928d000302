"""Entity, grounding and overlap scores of saved answers, and their roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import alignment, answers
from .stored import stored

ROUGE_TOKENS = 2000


def entity_scores(said: DataFrame, truth: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, total_gt, found, total_answer, hallucinated, precision, recall, f1) of answers against true entities.

    ``truth`` has a row (query, entity, name, code) for each; an entity is found by its text, its name, or a code of three
    characters or more in the answer. Answer entities that match no true one are hallucinated. Without answer entities
    precision is 1 if anything was found; queries without true entities score 0. A query has one answer.
    """
    read = stored(said.select(query, "answer", text.extract_entities(F.col("answer")).alias("own")), "answers")
    own = read.select(query, F.explode("own").alias("entity"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("code"), F.lit(True).alias("said"))
    rows = own.unionByName(truth.select(query, "entity", "name", "code", F.lit(False).alias("said")))
    # what tests compare by is made once for each distinct name, and once for each answer; not for each pair
    names = rows.select(F.explode(F.array("entity", "name")).alias("of")).where("of is not null").distinct()
    forms = stored(names.select("of", *(c.alias(k) for k, c in text.plain_forms(F.col("of")).items())), "forms")
    of = lambda c: forms.select(F.col("of").alias(f"{c}_of"), F.struct("n", "s", "e").alias(f"{c}_forms"))
    told = rows.join(of("entity"), F.col("entity") == F.col("entity_of"), "left").join(of("name"), F.col("name") == F.col("name_of"), "left")
    kept = lambda which: F.collect_list(F.when(which, F.struct(F.col("entity_forms").alias("entity"), F.col("name_forms").alias("name"), "code")))
    held = told.groupBy(query).agg(kept(F.col("said")).alias("own"), kept(~F.col("said")).alias("truths"))
    wide = lambda f: text.with_words({k: f[k] for k in ("n", "s", "e")})
    made = read.select(query, "answer").join(held, query, "left").select(
        query, "answer", F.struct(*(c.alias(k) for k, c in text.text_forms(F.col("answer")).items())).alias("read"),
        F.transform("own", lambda o: wide(o["entity"])).alias("own"), F.transform("truths", lambda t: F.struct(wide(t["entity"]).alias("entity"), wide(t["name"]).alias("name"), t["code"].alias("code"))).alias("truths"),
    )
    sure = lambda c: F.coalesce(c, F.lit(False))
    hit = lambda t: sure(text.forms_mentioned(t["entity"], F.col("read"))) | sure(text.forms_mentioned(t["name"], F.col("read"))) | sure((F.length(t["code"]) >= 3) & F.contains(F.col("answer"), t["code"]))
    same = lambda o, t: sure(text.forms_match(o, t["entity"])) | sure(text.forms_match(o, t["name"]))
    counts = {"total_gt": F.size("truths"), "found": F.size(F.filter("truths", hit)), "total_answer": F.when(F.size("truths") > 0, F.size("own")), "matched": F.size(F.filter("own", lambda o: F.exists("truths", lambda t: same(o, t))))}
    told = made.select(query, *(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("long").alias(k) for k, c in counts.items()))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    told = told.withColumn("recall", F.coalesce(share("found", "total_gt"), F.lit(0.0)))
    told = told.withColumn("precision", F.when(F.col("total_gt") == 0, 0.0).otherwise(F.coalesce(share("matched", "total_answer"), (F.col("found") > 0).cast("double"))))
    both = F.col("precision") + F.col("recall")
    told = told.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)).withColumn("hallucinated", F.col("total_answer") - F.col("matched"))
    return told.select(query, "total_gt", "found", "total_answer", "hallucinated", *(F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")))


def safety_errors(scores: DataFrame, critical: Column, query: str = "query_id") -> DataFrame:
    """(query, safety_hallucinated, safety_total_entities, safety_error_rate) of the queries that are ``critical`` (on medications),
    from the rows of ``entity_scores``: hallucinated entities as a share of the answer's, 0 without any."""
    rate = F.when(F.col("total_answer") > 0, F.round(F.col("hallucinated") / F.col("total_answer"), 4)).otherwise(0.0)
    return scores.where(critical).select(query, F.col("hallucinated").alias("safety_hallucinated"), F.col("total_answer").alias("safety_total_entities"), rate.alias("safety_error_rate"))


def grounding(evidence: DataFrame, truth: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, context_precision, context_recall): evidence texts with a true entity, and true entities that evidence has."""
    hit = text.entity_mentioned(F.col("entity"), F.col("text")) | F.coalesce(text.entity_mentioned(F.col("name"), F.col("text")), F.lit(False))
    rows = evidence.select(query, F.monotonically_increasing_id().alias("ev"), "text")
    used = rows.join(truth.select(query, "entity", "name"), query, "left").groupBy(query, "ev").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("ok")).groupBy(query).agg(F.round(F.avg(F.col("ok").cast("double")), 4).alias("context_precision"))
    held = evidence.groupBy(query).agg(F.array_join(answers.in_order(evidence, "text"), " ").alias("text"))
    seen = truth.join(held, query, "left").groupBy(query).agg(F.round(F.avg(F.coalesce(hit, F.lit(False)).cast("double")), 4).alias("context_recall"))
    return used.join(seen, query, "full").na.fill(0.0, ["context_precision", "context_recall"])


def citation_accuracy(citations: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, citation_accuracy): citations (claim, evidence) whose evidence mentions their claim."""
    ok = (F.coalesce("claim", F.lit("")) != "") & (F.coalesce("evidence", F.lit("")) != "") & F.coalesce(text.entity_mentioned(F.col("claim"), F.col("evidence")), F.lit(False))
    return citations.groupBy(query).agg(F.round(F.avg(ok.cast("double")), 4).alias("citation_accuracy"))


def rouge_l(answer: Column, reference: Column) -> Column:
    """F1 of the longest common subsequence of normalised words, of the first ROUGE_TOKENS each; 0 if either has none."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x.fillna(""), y.fillna(""), strict=True):
            a, b = p.split()[:ROUGE_TOKENS], q.split()[:ROUGE_TOKENS]
            n = alignment.lcs_length(a, b)
            out.append(round(2 * n / (len(a) + len(b)), 4) if n else 0.0)
        return pd.Series(out)

    return score(text.normalize(answer), text.normalize(reference))


def roll_up(results: DataFrame, model: str = "model") -> DataFrame:
    """The four axes of each model: means over answerable results, sentinels left out; abstention over the others.

    Reads abstained (null: answerable), precision, recall, f1, hallucination_rate, rouge_l (> 0 counts), semantic_sim (>= 0
    counts), context_precision, context_recall, citation_accuracy, safety_error_rate and latency_ms (> 0 counts, of all).
    """
    can = F.col("abstained").isNull()
    mean = lambda c, ok=None: F.coalesce(F.round(F.avg(F.when(can if ok is None else can & ok, F.col(c))), 4), F.lit(0.0)).alias(c)
    plain = ["precision", "recall", "f1", "hallucination_rate", "context_precision", "context_recall", "citation_accuracy", "safety_error_rate"]
    return results.groupBy(model).agg(
        F.count("*").alias("n"), F.count_if(can).alias("answerable"), *(mean(c) for c in plain), mean("rouge_l", F.col("rouge_l") > 0), mean("semantic_sim", F.col("semantic_sim") >= 0),
        F.coalesce(F.round(F.count_if(F.col("abstained")) / F.nullif(F.count_if(~can), F.lit(0)), 3), F.lit(0.0)).alias("abstention_accuracy"),
        F.coalesce(F.round(F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms")))), F.lit(0.0)).alias("latency_ms"),
    )


def axes(rolled: DataFrame, model: str = "model") -> DataFrame:
    """Factuality, relevance, grounding and safety as means of their parts."""
    mean = lambda *cs: F.round(sum((F.col(c) for c in cs[1:]), F.col(cs[0])) / len(cs), 4)
    return rolled.select(
        model, F.round((F.col("precision") + 1 - F.col("hallucination_rate")) / 2, 4).alias("factuality"), mean("recall", "f1", "semantic_sim", "rouge_l").alias("relevance"),
        mean("context_precision", "context_recall", "citation_accuracy").alias("grounding"), F.round((F.col("abstention_accuracy") + 1 - F.col("safety_error_rate")) / 2, 4).alias("safety"),
    )


def configurations(frames: Sequence[tuple[str, DataFrame]], metrics: Sequence[str]) -> DataFrame:
    """One-row frames of configurations under each other, and a row 'delta' of the last less the first."""
    rows = [df.select(F.lit(i).alias("ordinal"), F.lit(name).alias("configuration"), *metrics) for i, (name, df) in enumerate(frames)]
    union = rows[0]
    for r in rows[1:]:
        union = union.unionByName(r)
    delta = union.agg(F.lit(len(rows)).alias("ordinal"), F.lit("delta").alias("configuration"), *((F.max_by(m, "ordinal") - F.min_by(m, "ordinal")).alias(m) for m in metrics))
    return union.unionByName(delta)
