"""Sections of notes, and overlapping chunks of sections."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from .stored import lower_batches

WORD = r"[^\x20\x09-\x0D]+"
#: Tokens of a chunk, of its overlap, and the least that a further chunk of a section needs.
MAX_TOKENS, OVERLAP, MIN_TOKENS = 512, 128, 50
#: Words whose places are made at once, about.
PLACED = 1 << 17

#: Section headers, patterns in the order in which they are tried.
HEADERS = [
    ("chief_complaint", r"chief\s+complaint"), ("chief_complaint", r"cc\s*:"), ("chief_complaint", r"reason\s+for\s+(visit|consultation|admission)"),
    ("history_present_illness", r"history\s+of\s+present\s+illness"), ("history_present_illness", r"hpi\s*:"), ("history_present_illness", r"history\s+of\s+the\s+present\s+illness"), ("history_present_illness", r"present\s+illness"),
    ("past_medical_history", r"past\s+medical\s+history"), ("past_medical_history", r"pmh\s*:"), ("past_medical_history", r"medical\s+history"), ("past_medical_history", r"past\s+history"),
    ("medications", r"medications?\s*(on\s+admission|at\s+home|list)?"), ("medications", r"current\s+medications?"), ("medications", r"home\s+medications?"), ("medications", r"discharge\s+medications?"),
    ("allergies", r"allergi(es|c\s+reactions?)"), ("allergies", r"drug\s+allergies"), ("allergies", r"nkda"),
    ("social_history", r"social\s+history"), ("social_history", r"sh\s*:"), ("family_history", r"family\s+history"), ("family_history", r"fh\s*:"), ("family_history", r"fhx\s*:"),
    ("review_of_systems", r"review\s+of\s+systems?"), ("review_of_systems", r"ros\s*:"),
    ("physical_exam", r"physical\s+exam(ination)?"), ("physical_exam", r"pe\s*:"), ("physical_exam", r"exam\s*:"), ("physical_exam", r"vital\s+signs?\s*"),
    ("assessment_plan", r"assessment\s+(and|&)\s+plan"), ("assessment_plan", r"a\s*/\s*p\s*:"), ("assessment_plan", r"a&p\s*:"), ("assessment_plan", r"assessment\s*:"), ("assessment_plan", r"plan\s*:"), ("assessment_plan", r"impression\s+(and|&)\s+plan"), ("assessment_plan", r"impression\s*:"),
    ("labs_results", r"lab(oratory)?\s+results?"), ("labs_results", r"labs?\s*:"), ("labs_results", r"results?\s*:"), ("labs_results", r"pertinent\s+(labs?|results?)"),
    ("imaging", r"imaging\s*(results?|studies|findings)?"), ("imaging", r"radiology\s*(results?|findings)?"), ("imaging", r"diagnostic\s+imaging"),
    ("procedures", r"procedures?\s*(performed)?"), ("procedures", r"operative\s+(note|findings|report)"), ("procedures", r"surgical\s+history"),
]


def certain(pattern: str) -> str:
    """The longest run of letters that every match of a HEADERS pattern has, in lower case."""
    bare = re.sub(r".[?*]|\\s\+?", " ", re.sub(r"\\s\*", " ", re.sub(r"\([^()]*\)[?*]?", " ", pattern)))
    return max(re.findall("[a-z]+", bare), key=len)


def _known_header(line: Column, low: Column) -> Column:
    """The section of the first pattern that a line matches; patterns are tried only on lines with their ``certain`` letters."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(HEADERS):
        out = F.when(F.contains(low, F.lit(certain(pattern))) & line.rlike(f"(?i){pattern}"), F.lit(name)).otherwise(out)
    return out


def sections(notes: DataFrame, id: str = "document_id", body: str = "text") -> DataFrame:
    """(id, pos, section, body): a note's sections by first appearance.

    A line that has only a capitalised header of a known section begins it; a header that no pattern knows is tried again
    with the colon after it, which abbreviations need. Lines before the
    first header are of section 'other'; a section that recurs goes on after an empty line. Empty sections are left out.
    All is done where the note is: nothing is shuffled.
    """
    header = lambda line: F.regexp_extract(line, r"^[ \t]*([A-Z][A-Za-z &/\-]+)[ \t]*:?[ \t]*$", 1)
    cut = F.transform("lines", lambda line: F.struct(F.trim(header(line)).alias("h"), F.trim(line).alias("t"), F.lower(line).alias("l")))  # once for each line, not for each pattern
    kinds = F.transform(cut, lambda x: F.when(x["h"] != "", F.coalesce(_known_header(x["h"], x["l"]), _known_header(x["t"], x["l"]))))
    lines = notes.select(id, F.split(body, "\n").alias("lines")).where(F.col("lines").isNotNull()).select(id, "lines", kinds.alias("heads"))
    starts = F.filter(F.transform("heads", lambda h, i: F.when(h.isNotNull(), i)), lambda i: i.isNotNull())
    # a run of lines begins after each header, and one before the first
    runs = lines.withColumn("at", F.concat(F.array(F.lit(-1)), starts, F.array(F.size("lines"))))
    part = lambda i: F.regexp_replace(F.array_join(F.slice("lines", F.get("at", i) + 2, F.get("at", i + 1) - F.get("at", i) - 1), "\n"), r"^\s+|\s+$", "")
    named = lambda i: F.when(i == 0, "other").otherwise(F.get("heads", F.get("at", i)))
    made = F.transform(F.sequence(F.lit(0), F.size("at") - 2), lambda i: F.struct(i.cast("long").alias("run"), named(i).alias("section"), part(i).alias("part")))
    parts = runs.select(id, made.alias("parts")).select(id, F.filter("parts", lambda p: p["part"] != "").alias("parts"))
    each = parts.select(id, "parts", F.explode(F.array_distinct(F.transform("parts", lambda p: p["section"]))).alias("section"))
    own = each.select(id, "section", F.filter("parts", lambda p: p["section"] == F.col("section")).alias("own"))
    return own.select(id, F.get("own", F.lit(0))["run"].alias("pos"), "section", F.array_join(F.transform("own", lambda p: p["part"]), "\n\n").alias("body"))


def chunks(docs: DataFrame, id: str = "document_id", patient: str = "patient_id", section: str = "section", pos: str = "pos", body: str = "body", max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Overlapping chunks of sections.

    A chunk has max_tokens / 1.3 words and begins max_tokens / 1.3 - overlap / 1.3 words (1 at least) after the one before;
    each start within the section gives one, so a tail of pure overlap is one too. Of a section with several chunks
    those under min_tokens are dropped. Indexes run over the document. A blank section has none.
    """
    width, step = max(1, int(max_tokens / 1.3)), max(1, int(max_tokens / 1.3) - int(overlap / 1.3))
    ws = docs.select(id, patient, section, pos, F.regexp_extract_all(body, F.lit(f"({WORD})")).alias("ws")).where(F.size("ws") > 0)
    spans = ws.select("*", F.size("ws").alias("n"), F.explode(F.sequence(F.lit(0), F.size("ws") - 1, F.lit(step))).alias("first"))
    cut = spans.withColumn("piece", F.slice("ws", F.col("first") + 1, F.lit(width))).withColumn("token_count", text.n_tokens(F.size("piece")))
    kept = cut.where((F.col("token_count") >= min_tokens) | (F.col("n") <= step)).select(id, patient, section, pos, "first", "token_count", F.array_join("piece", " ").alias("text"))
    order = Window.partitionBy(id).orderBy(pos, "first")
    indexed = kept.withColumn("chunk_index", F.row_number().over(order) - 1).withColumn("total_chunks", F.count("*").over(Window.partitionBy(id)))
    chunk_id = F.substring(F.sha2(F.concat(F.col(patient).cast("string"), F.lit("::"), F.col(id).cast("string"), F.lit("::"), F.col("chunk_index").cast("string")), 256), 1, 16)
    return indexed.withColumn("chunk_id", chunk_id)


def word_offsets(docs: DataFrame, id: str = "document_id", body: str = "text") -> DataFrame:
    """(id, n, word, char_start, char_end): each word's place in its text.

    The places are running lengths of a text's parts, made where the text is: nothing is shuffled, and no window holds a long text's words.
    """
    lower_batches(docs.sparkSession)
    split = docs.select(id, F.regexp_extract_all(body, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)")).alias("parts")).where(F.size("parts") > 0)
    out = T.StructType([docs.schema[id], *T.StructType.fromDDL("n int, part string, char_end long").fields])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy()) // PLACED
            bounds = [0, *(np.flatnonzero(np.diff(last)) + 1).tolist(), batch.num_rows]
            for i, j in zip(bounds, bounds[1:]):  # texts of about PLACED words at once
                yield placed(batch.slice(i, j - i))

    def placed(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = pc.list_value_length(batch.column(1)).to_numpy()
        parts = batch.column(1).flatten()
        ends = np.cumsum(pc.utf8_length(parts).to_numpy().astype(np.int64))
        first = np.cumsum(sizes) - sizes
        before = np.append(0, ends)[first]
        n = np.arange(len(parts)) - np.repeat(first, sizes)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(n, pa.int32()), parts, pa.array(ends - np.repeat(before, sizes))], names=out.names)

    word = F.regexp_extract("part", f"({WORD})", 1)
    return split.mapInArrow(place, out).select(id, "n", word.alias("word"), (F.col("char_end") - F.length(word)).alias("char_start"), "char_end")
