"""What surrounds a model: prompts in, responses parsed, answers verified. Responses are a column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, parsing, text

DECOMPOSED = ["comparison", "temporal_numeric", "summary"]


def in_order(df: DataFrame, body: str) -> Column:
    """A group's texts by ``rank``, if there is one, and by themselves."""
    keys = [c for c in ("rank", body) if c in df.columns]
    return F.transform(F.array_sort(F.collect_list(F.struct(*keys))), lambda x: x[body])


def mock_model(prompts: DataFrame, rules: DataFrame, default: str, prompt: str = "prompt") -> DataFrame:
    """Append ``response``: that of the rule with the smallest priority whose keyword the prompt contains, else the default.

    ``rules`` (priority, keyword, response) is the stand-in's short script, so it goes along with the expression.
    """
    listed = rules.orderBy("priority").collect()
    out = F.lit(default)
    for r in reversed(listed):
        out = F.when(F.contains(F.lower(prompt), F.lit(r.keyword.lower())), F.lit(r.response)).otherwise(out)
    return prompts.withColumn("response", out)


def prompt(question: Column, evidence: Column, task: Column) -> Column:
    return F.concat_ws("\n\n", task, F.concat(F.lit("Question: "), question), F.concat(F.lit("Evidence:\n"), F.coalesce(evidence, F.lit("No evidence available."))))


def route(df: DataFrame, response: str = "response") -> DataFrame:
    """Append ``query_type`` and ``router_confidence`` from a router's response; 'unknown' and 0 if it doesn't parse."""
    kind, sure = parsing.json_field(F.col(response), "query_type"), parsing.json_field(F.col(response), "confidence")
    return df.withColumn("query_type", F.when(kind.isNotNull(), parsing.enum_value(kind)).otherwise("unknown")).withColumn("router_confidence", F.when(kind.isNotNull(), parsing.clipped(parsing.number(sure))).otherwise(0.0))


def sub_queries(df: DataFrame, query: str = "query_id", question: str = "question", response: str = "response") -> DataFrame:
    """(query, sub_index, sub_question): the listed parts of questions that are worth it, else the question itself."""
    listed = F.from_json(F.regexp_extract(response, r"(?s)(\[.*\])", 1), "array<string>")
    parts = F.when(F.col("query_type").isin(DECOMPOSED) & (F.size(listed) >= 2), F.slice(listed, 1, 4)).otherwise(F.array(F.col(question)))
    return df.select(query, F.posexplode(parts).alias("sub_index", "sub_question"))


def cited_chunks(answers: DataFrame, chunks: DataFrame, query: str = "query_id", body: str = "answer") -> DataFrame:
    """(query, n, chunk_id): chunks that [n] markers name, by their rank from 1; markers out of range name none."""
    marks = answers.select(query, F.posexplode(parsing.cited_indexes(F.col(body))).alias("n", "rank"))
    return marks.join(chunks.select(query, "rank", "chunk_id"), [query, "rank"]).select(query, "n", "chunk_id")


def temporal_check(answers: DataFrame, chunks: DataFrame, query: str = "query_id") -> DataFrame:
    """Append ``issues`` and ``valid``: dates of the answer that neither chunk texts nor encounter dates have, and the model's own."""
    found = F.concat(dates.extract(F.col("text")), F.when(F.col("encounter_date").isNotNull(), F.array(F.col("encounter_date").cast("date"))).otherwise(F.array().cast("array<date>")))
    known = chunks.groupBy(query).agg(F.array_distinct(F.flatten(F.collect_list(found))).alias("__known"))
    joined = answers.join(known, query, "left").withColumn("__own", dates.temporal_issues(F.col("answer"), F.coalesce("__known", F.array().cast("array<date>"))))
    said, ok = (F.coalesce(F.col(c), d) for c, d in (("model_issues", F.array().cast("array<string>")), ("model_valid", F.lit(True)))) if "model_issues" in answers.columns else (F.array().cast("array<string>"), F.lit(True))
    return joined.withColumn("issues", F.concat("__own", said)).withColumn("valid", ok & (F.size("__own") == 0)).drop("__known", "__own")


def verify_entities(answers: DataFrame, evidence: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, cleaned, grounded, removed): answers without lines that name an entity which no evidence has.

    Values and clauses are given the benefit of the doubt. A line goes if it contains such an entity, or four fifths of its
    words if it has two or more. Numbered lines are counted anew. ``evidence`` has a row (query, text) for each chunk, in order of ``rank`` if it has that column, else of the texts.
    """
    asked = answers.select(query, "answer", F.posexplode_outer(text.extract_entities(F.col("answer"))).alias("at", "entity"))
    spare = text.is_numeric_entity(F.col("entity")) | text.is_descriptive(F.col("entity"))
    joined = evidence.groupBy(query).agg(F.array_join(in_order(evidence, "text"), " ").alias("all"))
    # normal forms of evidence are made once for each query; what one text alone has, all of them joined have too
    seen = joined.select(query, text.normalize(F.col("all")).alias("plain")).select(query, "plain", text.words(F.col("plain")).alias("words"))
    tested = asked.where("entity is not null").withColumn("forms", text.sought_forms(F.col("entity"))).join(seen, query, "left")
    told = tested.withColumn("ok", spare | F.coalesce(text.forms_in_text(F.col("forms"), F.col("plain"), F.col("words")), F.lit(False)))
    pick = lambda ok: F.transform(F.array_sort(F.collect_list(F.when(F.col("ok") == ok, F.struct("at", "entity")))), lambda x: x["entity"])
    sets = told.groupBy(query).agg(pick(True).alias("grounded"), pick(False).alias("removed"))
    none = F.array().cast("array<string>")
    out = answers.select(query, "answer").join(sets, query, "left").withColumn("grounded", F.coalesce("grounded", none)).withColumn("removed", F.coalesce("removed", none))
    lines = out.where(F.size("removed") > 0).select(query, "removed", F.posexplode(F.split("answer", "\n")).alias("line_at", "line"))
    plain = text.normalize(F.col("line"))

    def names(entity: Column) -> Column:
        own = text.words(text.normalize_entity(entity, times=False))
        return F.contains(plain, text.normalize_entity(entity, times=False)) | ((F.size(own) >= 2) & (F.size(F.array_intersect(own, text.words(plain))) / F.size(own) >= 0.8))

    left = lines.where(~F.exists("removed", names))
    number = F.col("line").rlike(r"^\s*\d+[.\)]\s*")
    count = F.sum(number.cast("int")).over(Window.partitionBy(query).orderBy("line_at"))
    head = lambda g: F.regexp_extract("line", r"(?s)^(\s*)\d+([.\)])\s*(.*)$", g)
    again = left.withColumn("line", F.when(number, F.concat(head(1), count.cast("string"), head(2), F.lit(" "), head(3))).otherwise(F.col("line")))
    cleaned = again.groupBy(query).agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_at", "line"))), lambda x: x["line"]), "\n")).alias("__cleaned"))
    kept = out.join(cleaned, query, "left")
    return kept.select(query, F.when(F.size("removed") > 0, F.coalesce("__cleaned", F.lit(""))).otherwise(F.col("answer")).alias("cleaned"), "grounded", "removed")


def sufficiency(df: DataFrame, response: str = "response") -> DataFrame:
    """Append ``retrieval_verdict``, ``coverage``, ``missing`` and ``reformulated`` from an evaluator's response.

    One that doesn't parse counts as sufficient at 0.5, and so does an unknown verdict with the coverage that it states.
    """
    held, said = parsing.json_object(F.col(response)), F.lower(parsing.json_field(F.col(response), "verdict"))
    field = lambda name: F.get_json_object(held, f"$.{name}")
    told = df.withColumn("retrieval_verdict", F.when(said.isin("sufficient", "insufficient", "ambiguous"), said).otherwise("sufficient"))
    told = told.withColumn("coverage", F.coalesce(field("coverage_score").try_cast("double"), F.lit(0.5)))
    return told.withColumn("missing", F.coalesce(F.from_json(field("missing_aspects"), "array<string>"), F.array().cast("array<string>"))).withColumn("reformulated", field("reformulated_query"))


def retry(evaluated: DataFrame, found: DataFrame, retrieve: Callable[[DataFrame], DataFrame], query: str = "query_id", question: str = "question", chunk: str = "chunk_id") -> DataFrame:
    """(query, chunk, rank): a query's chunks, and for insufficient ones, after them, what a second retrieval finds beside them.

    ``retrieve`` takes (query, text) of the queries to ask again (the reformulated question, else their own) and gives (query, chunk, rank).
    There is one retry.
    """
    again = evaluated.where("retrieval_verdict = 'insufficient'").select(query, F.coalesce("reformulated", question).alias("text"))
    rows = found.select(query, chunk, F.lit(0).alias("__turn"), "rank").unionByName(retrieve(again).select(query, chunk, F.lit(1).alias("__turn"), "rank"))
    first = rows.groupBy(query, chunk).agg(F.min(F.struct("__turn", "rank")).alias("__at"))
    return first.select(query, chunk, F.row_number().over(Window.partitionBy(query).orderBy("__at", chunk)).alias("rank"))


def numeric_check(df: DataFrame, response: str = "response") -> DataFrame:
    """Append ``numeric_valid``, ``numeric_issues`` and ``corrections`` from a validator's response; one that doesn't parse is
    invalid and says so."""
    held = parsing.json_object(F.col(response))
    many = lambda name: F.coalesce(F.from_json(F.get_json_object(held, f"$.{name}"), "array<string>"), F.array().cast("array<string>"))
    told = df.withColumn("numeric_valid", F.coalesce(F.get_json_object(held, "$.valid").try_cast("boolean"), F.lit(False)))
    failed = F.array(F.lit("Numeric validation could not be completed (parse error)"))
    return told.withColumn("numeric_issues", F.when(held.isNull(), failed).otherwise(many("issues"))).withColumn("corrections", many("corrections"))


def critic_turns(df: DataFrame, responses: Sequence[str], query: str = "query_id") -> DataFrame:
    """Append ``verdict``, ``final`` and ``attempts``: a critic's responses in turn, the next only after a revision.

    A revision replaces the answer for the next attempt and stands if it was the last.
    """
    none = F.lit(None).cast("string")
    out = df.withColumn("__answer", F.col("answer")).withColumn("__open", F.lit(True)).withColumn("verdict", none).withColumn("final", none).withColumn("attempts", F.lit(0))
    for i, response in enumerate(responses):
        told = finish(out.select(query, F.col("__answer").alias("answer"), response, F.lit(i).alias("attempt")), response, len(responses) - 1)
        told = told.select(F.col(query).alias("__q"), F.col("verdict").alias("__v"), F.col("final").alias("__f"))
        joined = out.join(told, F.col(query) == F.col("__q"), "left")
        now = lambda new, old: F.when(F.col("__open"), new).otherwise(F.col(old))
        out = joined.withColumn("attempts", F.col("attempts") + F.col("__open").cast("int")).withColumn("verdict", now(F.col("__v"), "verdict")).withColumn("final", now(F.col("__f"), "final"))
        out = out.withColumn("__answer", now(F.col("__f"), "__answer")).withColumn("__open", F.col("__open") & (F.col("__v") == "revised")).select(*df.columns, "__answer", "__open", "verdict", "final", "attempts")
    return out.drop("__answer", "__open")


def finish(df: DataFrame, response: str = "response", attempts: int = 2) -> DataFrame:
    """Append ``verdict`` and ``final`` from a critic's response: a revision replaces the answer, an abstention its reason.

    ``attempt`` counts from 0; a revision after the last attempt stands as it is.
    """
    said = parsing.verdict(parsing.json_field(F.col(response), "verdict"))
    revised, reason = parsing.json_field(F.col(response), "revised_text"), parsing.json_field(F.col(response), "abstention_reason")
    out = df.withColumn("verdict", said)
    final = F.when(said == "revised", F.coalesce(revised, F.col("answer"))).when(said == "abstained", F.coalesce(reason, F.lit("Insufficient evidence."))).otherwise(F.col("answer"))
    return out.withColumn("final", final).withColumn("again", (said == "revised") & (F.col("attempt") < attempts))
