"""Model output, which is data here: values, verdicts, tagged parts, flags and rewards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query types in the order in which they are tried.
QUERY_TYPES = ["factual", "temporal", "numeric", "temporal_numeric", "medication", "summary", "comparison", "unknown"]
#: Spellings of verdicts.
VERDICTS = {"approve": "approved", "approved": "approved", "revise": "revised", "revised": "revised", "abstain": "abstained", "abstained": "abstained"}
#: Phrases of answers that abstain, of the entity scorer and of the benchmark of models.
ABSTENTIONS = ["insufficient data", "not available", "no information", "cannot determine", "no data", "not found", "no evidence", "not possible", "cannot be determined", "no genetic", "does not contain", "not present", "not included"]
BENCHMARK_ABSTENTIONS = ["insufficient data", "not available", "no information", "cannot determine", "no data", "not found", "no evidence", "not possible to", "cannot be determined", "no genetic"]


def enum_value(text: Column, members: Sequence[str] = QUERY_TYPES, default: str = "unknown") -> Column:
    """A member by its value, else the first member contained in the text, else the default."""
    low = F.lower(F.trim(text))
    out = F.when(low.isin(list(members)), low)
    for m in members:
        out = out.when(F.contains(low, F.lit(m)), m)
    return out.otherwise(default)


def number(text: Column) -> Column:
    """The first number in a text; null without one."""
    return F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def clipped(value: Column, default: float = 0.0) -> Column:
    """A value between 0 and 1; the default for null."""
    return F.least(F.greatest(F.coalesce(value, F.lit(default)), F.lit(0.0)), F.lit(1.0))


def listed(text: Column) -> Column:
    """The items of a bulleted (-, *, +) or numbered (1. or 1)) list, trimmed; empty ones and other lines are left out."""
    items = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:[-*+]|\d+[.)]) \s*(.*)"), F.lit(1))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def between_tags(text: Column, tag: str) -> Column:
    """Trimmed text between <tag> and </tag>; null without them."""
    found = F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    return F.when(F.trim(found) != "", F.trim(found))


def answer_part(text: Column) -> Column:
    """The tagged answer; without tags the whole text."""
    return F.coalesce(between_tags(text, "answer"), F.trim(text))


def cited_indexes(text: Column) -> Column:
    """Numbers of [n] markers, each once, in order of first mention."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int")))


def _balanced(text: Column) -> Column:
    """The text from its first brace to the one that closes it; null if none does. Braces within strings count like any other."""
    tail = F.when(F.contains(text, F.lit("{")), F.substr(text, F.instr(text, "{")))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(state: Column, char: Column) -> Column:
        depth = state["depth"] + F.when(char == "{", 1).when(char == "}", -1).otherwise(0)
        return F.struct(depth.alias("depth"), (state["at"] + 1).alias("at"), F.when((state["end"] == 0) & (depth == 0), state["at"] + 1).otherwise(state["end"]).alias("end"))

    end = F.aggregate(F.split(tail, ""), start, step, lambda s: s["end"])
    return F.when(end > 0, F.substr(tail, F.lit(1), end))


def json_object(text: Column) -> Column:
    """The JSON object in a text: in a fence, else in the first balanced braces, else the whole text; null if none of them is one."""
    fenced = F.trim(F.regexp_extract(text, r"(?s)```(?:json)?\s*\n?(.*?)```", 1))
    whole = lambda c: F.when(F.regexp_replace(c, r"^\s+", "").startswith("{") & F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(whole(fenced), whole(_balanced(text)), whole(F.trim(text)))


def json_field(text: Column, field: str) -> Column:
    """A field of the JSON object in a text; null without such an object."""
    return F.get_json_object(json_object(text), f"$.{field}")


def verdict(text: Column, default: str = "abstained") -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in VERDICTS.items() for x in kv))[F.lower(F.trim(text))], F.lit(default))


def abstains(text: Column, phrases: Sequence[str] = ABSTENTIONS) -> Column:
    return F.lower(text).rlike("|".join(phrases))


def judge_score(text: Column) -> Column:
    """The first character as a number from 1 to 5; 0 if it is none."""
    digit = F.substring(F.trim(text), 1, 1).try_cast("int")
    return F.when(digit.isNotNull(), F.least(F.greatest(digit, F.lit(1)), F.lit(5))).otherwise(0)


def brier(confidence: Column, truth: Column) -> Column:
    """2cv - c² for a stated confidence c and an outcome v."""
    return 2 * confidence * truth - confidence * confidence


def challenger_reward(judge: Column, change: Column) -> Column:
    """-1 for challenging what the judge fully supports, 1 for a confidence lowered by 0.1 or more, else 0."""
    return F.when(judge >= 1, -1.0).when(change <= -0.1, 1.0).otherwise(0.0)


def detection_reward(flagged: Column, bad: Column, confidence: Column) -> Column:
    """1 for right calls, -1 for a missed bad answer, -0.5 for a false alarm; surer right calls earn up to 0.3 more."""
    right = F.when(flagged & bad, 1.0 + 0.3 * (1 - confidence)).when(~flagged & ~bad, 1.0 + 0.3 * confidence)
    return right.when(bad, -1.0).otherwise(-0.5)


def stated_verdict(output: Column) -> Column:
    """The verdict that an output states, in lower case; '' if none can be read."""
    return F.lower(F.regexp_extract(output, r'"verdict"\s*:\s*"(\w+)"', 1))


def stated_confidence(output: Column) -> Column:
    return F.regexp_extract(output, r'"confidence"\s*:\s*([\d.]+)', 1).try_cast("double")


def verifier_flags(output: Column, unreadable: bool = False) -> Column:
    """Whether a verifier's output rejects an answer; one without a verdict does so if ``unreadable`` (evaluation), else not (training)."""
    said = stated_verdict(output)
    return said.isin("not_supported", "partial") | (F.lit(unreadable) & (said == ""))


def critic_flags(output: Column) -> Column:
    """Whether a critic's output rejects an answer; one without a verdict does."""
    return stated_verdict(output).isin("revised", "abstained", "")


def challenger_flags(output: Column) -> Column:
    """Whether a challenger's output has a challenge and no empty list."""
    return F.contains(output, F.lit("challenge_type")) & ~F.contains(output, F.lit("[]"))


def call_reward(flagged: Column, bad: Column) -> Column:
    """1 for a right call, -1 for a missed bad answer, -0.5 for a false alarm."""
    return F.when(flagged == bad, 1.0).when(bad, -1.0).otherwise(-0.5)


def hybrid_rewards(verifier: Column, challenger: Column, bad: Column) -> tuple[Column, Column]:
    """Rewards of two agents' flags: half the pair's, 0.3 their own, 0.2 what they add to the other alone."""
    pair = call_reward(verifier | challenger, bad)
    mixed = lambda own, other: 0.5 * pair + 0.3 * call_reward(own, bad) + 0.2 * (pair - call_reward(other, bad))
    return mixed(verifier, challenger), mixed(challenger, verifier)


def shared_rewards(verifier: Column, challenger: Column, bad: Column) -> tuple[Column, Column, Column]:
    """The pair's reward (1 or -1, 0.3 further from 0 if both agree), and each agent's: 0.2 more or less by its own call."""
    base = F.when((verifier | challenger) == bad, 1.0).otherwise(-1.0)
    base = base + F.when(verifier == challenger, 0.3 * F.signum(base)).otherwise(0.0)
    own = lambda flag: base + F.when(flag == bad, 0.2).otherwise(-0.2)
    return base, own(verifier), own(challenger)


def trajectory_reward(verifier_right: Column, challenger_right: Column) -> Column:
    """1 if both agents are right, 0 if one is, -1 if neither."""
    return F.when(verifier_right & challenger_right, 1.0).when(verifier_right | challenger_right, 0.0).otherwise(-1.0)


def detection_output_reward(output: Column, bad: Column) -> Column:
    """``detection_reward`` of a verifier's output, 0.1 more if its first line is JSON, else less; -0.5 if it has no verdict."""
    form = F.when(F.try_parse_json(F.substring_index(F.trim(output), "\n", 1)).isNotNull(), 0.1).otherwise(-0.1)
    return F.when(stated_verdict(output) == "", -0.5).otherwise(detection_reward(verifier_flags(output), bad, clipped(stated_confidence(output), 0.5)) + form)


def challenge_output_reward(output: Column, bad: Column) -> Column:
    """``call_reward`` of a challenger's output, 0.1 more if all of it is a JSON list, 0.1 less if it is no JSON."""
    whole = F.try_parse_json(F.trim(output))
    form = F.when(whole.isNull(), -0.1).when(F.trim(output).startswith("["), 0.1).otherwise(0.0)
    return call_reward(challenger_flags(output), bad) + form


def pipeline_output_reward(output: Column, bad: Column, agent: str) -> Column:
    """``call_reward`` of an agent's output in a whole pipeline: 'challenger', or one that gives a verdict (-0.3 without one)."""
    if agent == "challenger":
        return call_reward(challenger_flags(output), bad)
    said = stated_verdict(output)
    return F.when(said == "", -0.3).otherwise(call_reward(said.isin("not_supported", "partial", "insufficient"), bad))


def training_rewards(verifier: Column, challenger: Column, target: Column, should: Column) -> tuple[Column, Column]:
    """Rewards in training: Brier's of the verifier's stated confidence (-0.5 without one); the challenger's 1 and -0.5 where
    it should challenge, -1 and 0.5 where it should not."""
    sure, raised = stated_confidence(verifier), challenger_flags(challenger)
    told = F.when(sure.isNull(), -0.5).otherwise(brier(F.least(sure, F.lit(1.0)), target))
    return told, F.when(should, F.when(raised, 1.0).otherwise(-0.5)).otherwise(F.when(raised, -1.0).otherwise(0.5))
