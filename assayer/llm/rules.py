"""Quality rules: base counts, and divergence from the character and word distributions of known languages."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import stats, texts

#: Limits of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Languages that can be added to the given ones, and words that each of them gets.
MOST_LANGUAGES, COMMON = 1000, 25
#: A distance counts only from so many characters or words on; short texts stray by chance.
GUARD_CHARS, GUARD_WORDS = 200, 50
#: Largest Jensen-Shannon distances to the nearest language. Of characters: on sf0.1, of 3,243 documents of label quality 1 that pass the
#: base rules, it is 0.05 at the median, 0.155 at the 99.5th percentile and 0.24 at most; of 291 of label 0 0.176 at least.
#: Of words: MAX_WORD_DISTANCE and WORD_SLIP by the root of the number of words, since the fewer words, the further counts stray by chance.
#: Both were chosen with sf0.1 and check_l in view (six values of the first were tried): of 208,178 documents of check_l that pass all else and
#: are not labelled bad, none would need a slip over 1.6, so none goes there by its words. Five passages of some 30 words, repeated (Finnish,
#: Polish, Italian, Dutch, a list of nouns), are at 0.34 to 0.38, and would go by their words from some 85 to 135 words on.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, WORD_SLIP = 0.17, 0.18, 1.8

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, nearest string, script string, kept boolean"


@dataclass(frozen=True)
class Reference:
    """What is usual in a language: the script of its letters, counts of character classes and of its common words."""

    script: str
    classes: np.ndarray
    words: np.ndarray


def word_lists(docs: DataFrame, text: str = "text", lang: str = "lang", lists: dict[str, str] = stats.COMMON_WORDS) -> dict[str, str]:
    """``lists`` and, for each other language that a thousandth of the documents or more say they are in, its COMMON commonest words in all of these.

    So at most a thousand languages are added, whatever stands in the column. Words are runs of letters and marks, in lower case;
    of equally common ones the first by code point.
    """
    seen = docs.groupBy(F.col(lang).alias("__lang")).agg(F.count("*").alias("n"))
    total = seen.agg(F.sum("n")).first()[0] or 0
    others = sorted(r["__lang"] for r in seen.where(F.col("__lang").isNotNull() & ~F.col("__lang").isin(sorted(lists)) & (F.col("n") * MOST_LANGUAGES >= total)).collect())
    if not others:
        return dict(lists)
    words = docs.where(F.col(lang).isin(others)).select(F.col(lang).alias("__lang"), F.explode(F.split(F.lower(text), r"[^\p{L}\p{M}]+")).alias("word")).where("word != ''")
    place = F.row_number().over(Window.partitionBy("__lang").orderBy(F.desc("n"), "word"))
    top = words.groupBy("__lang", "word").agg(F.count("*").alias("n")).withColumn("place", place).where(F.col("place") <= COMMON).collect()
    found = {name: " ".join(r["word"] for r in sorted((r for r in top if r["__lang"] == name), key=lambda r: r["place"])) for name in others}
    return dict(lists) | {name: ws for name, ws in found.items() if ws}


def references(docs: DataFrame, text: str = "text", lang: str = "lang", lists: dict[str, str] = stats.COMMON_WORDS) -> dict[str, Reference]:
    """Per language of ``lists``: what is usual in the documents that say they are in it.

    All documents are counted, apart by profile: the script, and the shares of lower-case letters, capitals and symbols, in quarters.
    A language's reference is the sum over its commonest profile, so that shouted or garbled texts don't blur it. What
    reaches the driver is a row of counts for each language and profile, however many documents there are.
    """
    size = len(stats.CLASSES) + stats.CommonWords(lists).size + 1
    shares = [stats.CLASSES.index(c) for c in ("lower", "upper", "symbol")]

    def work():
        common = stats.CommonWords(lists)

        def counts(rows: list[bytes]) -> list[pa.Array]:
            made, profiles = [], []
            for t in rows:
                seen = stats.byte_counts(t)
                classes = stats.class_counts(t, seen)
                made.append(np.concatenate([classes, common.counts(t)]).tolist())
                profiles.append("".join(str(round(4 * classes[i] / max(1, classes.sum()))) for i in shares) + stats.script(t, seen))
            return [pa.array(made, pa.list_(pa.int64())), pa.array(profiles, pa.string())]

        return counts

    known = docs.where(F.col(lang).isin(sorted(lists))).select(F.col(lang).alias("__lang"), F.col(text).alias("__doc"))
    counted = texts.with_columns(known, work, "counts array<bigint>, profile string", "__doc", drop_text=True)
    sums = counted.groupBy("__lang", "profile").agg(F.count("*").alias("n"), F.array(*(F.sum(F.col("counts")[i]) for i in range(size))).alias("counts")).collect()
    cut = len(stats.CLASSES)
    common = stats.CommonWords(lists)
    found = {r["__lang"]: (r["profile"][len(shares) :], np.array(r["counts"], np.int64)) for r in sorted(sums, key=lambda r: (r["n"], r["profile"]))}
    return {name: Reference(found[name][0], found[name][1][:cut], common.of_language(found[name][1][cut:], k)) for k, name in enumerate(common.languages) if name in found}


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", lists: dict[str, str] = stats.COMMON_WORDS, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE, slip: float = WORD_SLIP) -> DataFrame:
    """Append the columns of COLUMNS to documents.

    The references come from all documents given, for each language that ``word_lists`` gives. A document that passes the base rules is kept if its character
    classes lie within ``max_char`` of the nearest language, and its common words within ``max_word`` and ``slip`` by the root of its number of words; a text below
    the guard lengths is not held to a distance, and neither is one whose letters are mostly of a script that no reference has: a missing reference
    speaks against nobody. Null texts count as empty and fail the base rules; a null or unknown
    language has no say in the references and is judged like any other. Without any reference (empty table, no known
    language) the base rules decide alone. Equal rows get equal verdicts; columns of the same names are replaced.
    """
    lists = word_lists(docs, text, lang, lists)
    known = references(docs, text, lang, lists)

    def work():
        common = stats.CommonWords(lists)
        places = [(k, name, known[name].classes, known[name].words) for k, name in enumerate(common.languages) if name in known]
        written = {r.script for r in known.values()} | {""}

        def verdicts(rows: list[bytes]) -> list[pa.Array]:
            made, classes, frequent, scripts = [], [], [], []
            for t in rows:
                words, seen = t.split(), stats.byte_counts(t)
                made.append((len(words), stats.n_chars(seen) - stats.spaces(seen), stats.symbols(seen), stats.dup_lines(t), stats.repeat_words(words)))
                classes.append(stats.class_counts(t, seen))
                scripts.append(stats.script(t, seen))
                frequent.append(common.counts(t))
            base = np.array(made, np.int64).reshape(-1, 5)
            classes, frequent = np.array(classes), np.array(frequent)
            failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])
            if places:
                by_char = np.stack([stats.jensen_shannon(classes, chars) for _, _, chars, _ in places])
                by_word = np.stack([stats.jensen_shannon(common.of_language(frequent, k), words) for k, _, _, words in places])
                nearest = pa.array([places[i][1] for i in by_word.argmin(0)], pa.string())
                by_char, by_word = by_char.min(0), by_word.min(0)
            else:
                by_char = by_word = np.zeros(len(rows))
                nearest = pa.nulls(len(rows), pa.string())
            far = ((classes.sum(1) >= GUARD_CHARS) & (by_char > max_char)) | ((base[:, 0] >= GUARD_WORDS) & (by_word > max_word + slip / np.sqrt(np.maximum(base[:, 0], 1))))
            far &= np.array([x in written for x in scripts], bool)
            return [*(pa.array(base[:, i]) for i in range(5)), pa.array(failed), pa.array(by_char), pa.array(by_word), nearest, pa.array(scripts, pa.string()), pa.array(~failed & ~far)]

        return verdicts

    return texts.with_columns(docs, work, COLUMNS, text)
