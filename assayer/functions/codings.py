"""Coded concepts, references and times of nested clinical records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: DDL of a coded concept.
CONCEPT = "struct<coding: array<struct<system: string, code: string, display: string>>, text: string>"


def first_coding(concept: Column, or_text: bool = True) -> Column:
    """The first coding of a concept, else one with the concept's text as display; null if it has neither."""
    coding = F.try_element_at(concept["coding"], F.lit(1))
    text = F.when(concept["text"].isNotNull(), F.struct(F.lit(None).cast("string").alias("system"), F.lit(None).cast("string").alias("code"), concept["text"].alias("display")))
    return F.coalesce(coding, text) if or_text else coding


def codings(concepts: Column) -> Column:
    """The codings of a list of concepts, those without one left out."""
    return F.filter(F.transform(concepts, lambda c: first_coding(c)), lambda c: c.isNotNull())


def reference_id(reference: Column) -> Column:
    """The id in a reference: after urn:uuid:, after the first slash, or as it is."""
    return F.when(reference.startswith("urn:uuid:"), F.substr(reference, F.lit(10))).when(F.contains(reference, F.lit("/")), F.regexp_extract(reference, r"^[^/]*/(.*)$", 1)).otherwise(reference)


def prefixed_id(reference: Column, kind: str) -> Column:
    """The id in a reference of one kind ('Patient/...'); null for other kinds."""
    return F.when(reference.startswith(f"{kind}/"), F.substr(reference, F.lit(len(kind) + 2)))


def scoped_id(system: Column, value: Column) -> Column:
    return F.concat(system, F.lit("|"), value)


def age(birth: Column, at: Column) -> Column:
    """Years of 365 days, rounded down."""
    return F.floor(F.datediff(at, birth) / 365).cast("int")


def note_type(title: Column) -> Column:
    """Document type from words of a note's title, the first that fits."""
    low = F.lower(title)
    return F.when(F.contains(low, F.lit("discharge")), "discharge_summary").when(low.rlike("radiology|imaging"), "radiology_report").when(F.contains(low, F.lit("pathology")), "pathology_report").when(F.contains(low, F.lit("lab")), "lab_report").otherwise("clinical_note")


def display_source(document_type: Column, section: Column, date: Column) -> Column:
    """'Lab Report > Labs Results (2024-01-15)'; without a date, no parentheses."""
    title = lambda c: F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
    return F.concat(title(document_type), F.lit(" > "), title(section), F.coalesce(F.concat(F.lit(" ("), F.date_format(date, "yyyy-MM-dd"), F.lit(")")), F.lit("")))


def note_text(attachments: Column) -> Column:
    """Text of the last attachment whose base64 data decode; null if none does."""
    decoded = F.transform(attachments, lambda a: F.try_to_binary(a["data"], F.lit("base64")).cast("string"))
    return F.try_element_at(F.filter(decoded, lambda t: t.isNotNull()), F.lit(-1))
