"""Joining and grouping of clinical records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codings, dates


#: Classes of encounters by their codes, of either record version; all others are 'other'.
CLASSES = {"AMB": "ambulatory", "ambulatory": "ambulatory", "EMER": "emergency", "emergency": "emergency", "EW": "emergency", "IMP": "inpatient", "inpatient": "inpatient", "ACUTE": "inpatient", "OBSENC": "inpatient", "SS": "outpatient", "outpatient": "outpatient", "wellness": "wellness"}


def _codes(items: Column) -> Column:
    """Codings of a list of concepts, or of concepts behind references."""
    plain = lambda c: F.struct(c["coding"].alias("coding"), c["text"].alias("text"))
    return codings.codings(F.transform(items, lambda c: F.coalesce(c["concept"], plain(c))))


def encounters(df: DataFrame) -> DataFrame:
    """Encounter rows of resources: class, type, times, reasons and the first named participant, of either record version."""
    period = F.coalesce("actualPeriod", "period")
    code = F.coalesce(F.get_json_object("class", "$[0].coding[0].code"), F.get_json_object("class", "$.coding[0].code"), F.get_json_object("class", "$.code"))
    reasons = F.when(F.size("reason") > 0, _codes(F.col("reason"))).otherwise(codings.codings(F.col("reasonCode")))
    named = F.filter(F.transform("participant", lambda p: p["individual"]["display"]), lambda n: n.isNotNull() & (n != ""))
    kinds = F.create_map(*(F.lit(x) for kv in CLASSES.items() for x in kv))
    return df.where("resourceType = 'Encounter'").select(
        codings.reference_id(F.col("subject.reference")).alias("patient_id"), F.col("id").alias("encounter_id"), "status", F.coalesce(kinds[code], F.lit("other")).alias("class"),
        codings.first_coding(F.try_element_at("type", F.lit(1)))["display"].alias("type"), dates.record_date(period["start"]).alias("start"), dates.record_date(period["end"]).alias("end"),
        F.transform(reasons, lambda c: c["display"]).alias("reasons"), F.try_element_at(named, F.lit(1)).alias("provider"),
    )


def conditions(df: DataFrame) -> DataFrame:
    """Condition rows; those without a code go, an unknown clinical status is active."""
    code, status = codings.first_coding(F.col("code")), codings.first_coding(F.col("clinicalStatus"))["code"]
    known = ["active", "recurrence", "relapse", "inactive", "remission", "resolved"]
    return df.where("resourceType = 'Condition'").where(code.isNotNull()).select(
        codings.reference_id(F.col("subject.reference")).alias("patient_id"), F.col("id").alias("condition_id"), code["code"].alias("code"), code["display"].alias("display"),
        F.when(status.isin(known), status).otherwise("active").alias("status"), dates.record_date(F.col("onsetDateTime")).alias("onset"), codings.reference_id(F.col("encounter.reference")).alias("encounter_id"),
    )


def shown_number(value: Column) -> Column:
    """A number as records write it: whole ones without a point."""
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))


def measured(quantity: Column) -> Column:
    """'value unit' of a quantity, the unit's code without a unit; null without a value or at 0."""
    return F.when(F.coalesce(quantity["value"], F.lit(0.0)) != 0, F.concat(shown_number(quantity["value"]), F.lit(" "), F.coalesce(F.nullif(quantity["unit"], F.lit("")), quantity["code"], F.lit(""))))


def observations(df: DataFrame) -> DataFrame:
    """Observation rows; the shown value is the quantity, else the coded value, else the string, else 'N/A'.

    ``parts`` has the components that have a value, as 'name: value unit', joined by commas (null without components).
    """
    code, coded, bounds = codings.first_coding(F.col("code")), codings.first_coding(F.col("valueCodeableConcept"))["display"], F.try_element_at("referenceRange", F.lit(1))
    quantity = F.when(F.col("valueQuantity.value").isNotNull(), F.concat_ws(" ", F.col("valueQuantity.value").cast("string"), F.col("valueQuantity.unit")))
    part = lambda c: F.concat(F.coalesce(codings.first_coding(c["code"])["display"], F.lit("component")), F.lit(": "), measured(c["valueQuantity"]))
    parts = F.filter(F.transform("component", part), lambda p: p.isNotNull())
    return df.where("resourceType = 'Observation'").where(code.isNotNull()).select(
        codings.reference_id(F.col("subject.reference")).alias("patient_id"), F.col("id").alias("observation_id"), code["display"].alias("display"), F.col("valueQuantity.value").alias("value"), F.col("valueQuantity.unit").alias("unit"),
        F.coalesce(quantity, coded, F.col("valueString"), F.lit("N/A")).alias("shown"), bounds["low"]["value"].alias("low"), bounds["high"]["value"].alias("high"),
        dates.record_date(F.coalesce("effectiveDateTime", "issued")).alias("effective"), codings.reference_id(F.col("encounter.reference")).alias("encounter_id"),
        F.when(F.size("component") > 0, F.array_join(parts, ", ")).alias("parts"), F.coalesce(measured(F.col("valueQuantity")), F.nullif("valueString", F.lit(""))).alias("plain"), "issued", "effectiveDateTime",
    )


def medications(df: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """Medication rows: name, dosage (its text, else the first dose), status ('active' without one), reasons.

    The name is the inline coding's of either record version, else the looked-up one's (id, name), else 'Unknown medication'; without a
    lookup, rows without an inline code go.
    """
    own = F.coalesce(F.col("medication.concept"), F.when(F.col("medication").isNotNull(), F.struct(F.col("medication.coding").alias("coding"), F.col("medication.text").alias("text"))), F.col("medicationCodeableConcept"))
    inline = codings.first_coding(own)
    rows = df.where("resourceType = 'MedicationRequest'").withColumn("__med", codings.reference_id(F.coalesce("medicationReference.reference", "medication.reference.reference")))
    if lookup is None:
        named, name = rows.where(inline.isNotNull()), inline["display"]
    else:
        named = rows.join(lookup.select(F.col("id").alias("__id"), F.col("name").alias("__name")), F.col("__med") == F.col("__id"), "left")
        name = F.coalesce(inline["display"], F.col("__name"), F.lit("Unknown medication"))
    first = F.try_element_at("dosageInstruction", F.lit(1))
    dose = F.try_element_at(first["doseAndRate"], F.lit(1))["doseQuantity"]
    dosage = F.coalesce(F.nullif(first["text"], F.lit("")), F.trim(F.concat(dose["value"].cast("string"), F.lit(" "), F.coalesce(dose["unit"], F.lit("")))))
    reasons = F.when(F.size("reason") > 0, _codes(F.col("reason"))).otherwise(codings.codings(F.col("reasonCode")))
    return named.select(
        codings.reference_id(F.col("subject.reference")).alias("patient_id"), "id", name.alias("name"), dosage.alias("dosage"), F.coalesce("status", F.lit("active")).alias("status"),
        dates.record_date(F.col("authoredOn")).alias("authored"), codings.reference_id(F.col("encounter.reference")).alias("encounter_id"), F.transform(reasons, lambda c: c["display"]).alias("reasons"),
    )


def lab_line(display: Column, value: Column, issued: Column) -> Column:
    """'- test: value (date)'; null without a value."""
    return F.concat(F.lit("- "), F.coalesce(display, F.lit("Unknown test")), F.lit(": "), value, F.lit(" ("), F.substring(F.coalesce(issued, F.lit("")), 1, 10), F.lit(")"))


def condition_line(display: Column, code: Column) -> Column:
    return F.concat(F.lit("- "), F.coalesce(display, F.lit("Unknown condition")), F.coalesce(F.concat(F.lit(" ["), F.nullif(code, F.lit("")), F.lit("]")), F.lit("")))


def vital_line(display: Column, parts: Column, value: Column) -> Column:
    """'- sign: ' and its components or, without any, its value; null if neither has a value."""
    return F.concat(F.lit("- "), F.coalesce(display, F.lit("Vital sign")), F.lit(": "), F.when(parts.isNotNull(), F.nullif(parts, F.lit(""))).otherwise(value))


def medication_line(name: Column, dosage: Column, status: Column) -> Column:
    within = lambda c, a, b: F.coalesce(F.concat(F.lit(a), F.nullif(c, F.lit("")), F.lit(b)), F.lit(""))
    return F.concat(F.lit("- "), name, within(dosage, " (", ")"), within(status, " [", "]"))


def procedure_line(display: Column, performed: Column) -> Column:
    return F.concat(F.lit("- "), F.coalesce(display, F.lit("Unknown procedure")), F.coalesce(F.concat(F.lit(" ("), F.nullif(F.substring(performed, 1, 10), F.lit("")), F.lit(")")), F.lit("")))


#: Sections of an encounter's document in order, with their labels.
ENCOUNTER_SECTIONS = [("ASSESSMENT_PLAN", "Diagnoses"), ("LABS", "Laboratory Results"), ("PHYSICAL_EXAM", "Vital Signs"), ("MEDICATIONS", "Medications"), ("PROCEDURES", "Procedures")]


def encounter_documents(encounters: DataFrame, lines: DataFrame) -> DataFrame:
    """(encounter_id, title, text): a document for each encounter (encounter_id, class, type, start, end), with or without lines.

    ``lines`` has encounter_id, section (of ENCOUNTER_SECTIONS), ordinal and line; null lines are left out, equal ordinals go by the line.
    """
    body = section_document(lines.where("line is not null"), ["encounter_id"], ENCOUNTER_SECTIONS).withColumnRenamed("text", "__body")
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    title = F.concat(F.initcap("class"), F.lit(" Encounter on "), F.coalesce(at("start"), F.lit("Unknown date")))
    head = F.concat_ws("\n", F.concat(F.lit("Type: "), F.nullif("type", F.lit(""))), F.concat(F.lit("Start: "), at("start")), F.concat(F.lit("End: "), at("end")))
    told = encounters.join(body, "encounter_id", "left")
    text = F.concat(title, F.lit("\n\n"), F.when(head != "", F.concat(head, F.lit("\n"))).otherwise(F.lit("")), F.lit("\n"), F.coalesce(F.concat("__body", F.lit("\n")), F.lit("")))
    return told.select("encounter_id", title.alias("title"), text.alias("text"))


def encounter_summaries(encounters: DataFrame, lines: DataFrame) -> DataFrame:
    """(encounter_id, title, text): the shorter document of a bundle's encounter (encounter_id, class, type, start, provider, reasons).

    ``lines`` has section (Conditions, Observations or Medications), ordinal and line; they keep their order, without counts.
    """
    order = F.when(F.col("section") == "Conditions", 0).when(F.col("section") == "Observations", 1).otherwise(2)
    held = lines.groupBy("encounter_id", "section").agg(F.array_sort(F.collect_list(F.struct("ordinal", "line"))).alias("ls"))
    block = F.concat("section", F.lit(":\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    body = held.select("encounter_id", F.struct(order.alias("at"), block.alias("b")).alias("s")).groupBy("encounter_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["b"]), "\n\n").alias("__body"))
    title = F.concat(F.initcap("class"), F.lit(" "), F.coalesce("type", F.lit("Encounter")), F.lit(" on "), F.coalesce(F.date_format("start", "yyyy-MM-dd"), F.lit("Unknown date")), F.coalesce(F.concat(F.lit(" (Provider: "), "provider", F.lit(")")), F.lit("")))
    why = F.array_join(F.filter("reasons", lambda r: r.isNotNull() & (r != "")), ", ")
    told = encounters.join(body, "encounter_id", "left")
    return told.select("encounter_id", title.alias("title"), F.concat_ws("\n\n", title, F.concat(F.lit("Reason for visit: "), F.nullif(why, F.lit(""))), "__body").alias("text"))


def lab_summaries(labs: DataFrame, key: str = "patient_id") -> DataFrame:
    """(key, text): all results of a patient that belong to no encounter; reads issued and line (null: left out of the text, not of the patients)."""
    held = labs.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct(F.coalesce("issued", F.lit("")).alias("issued"), "line")))).alias("ls"))
    return held.select(key, F.concat(F.lit("Standalone Laboratory Results ("), F.size("ls").cast("string"), F.lit("):\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("text"))


def with_children(parents: DataFrame, key: Sequence[str], children: dict[str, DataFrame], order: Sequence[str]) -> DataFrame:
    """Parents with an ordered list of each kind of child; parents without children keep empty lists.

    Children are grouped before the join, so lists of different kinds don't multiply.
    """
    out = parents
    for name, child in children.items():
        rest = [c for c in child.columns if c not in key]
        item = F.struct(*(F.col(c) for c in [*order, *(c for c in rest if c not in order)] if c in rest))
        out = out.join(child.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias(name)), list(key), "left").withColumn(name, F.coalesce(F.col(name), F.array()))
    return out


def unlinked(children: DataFrame, parents: DataFrame, key: Sequence[str]) -> DataFrame:
    """Children whose parent is null or not among the parents."""
    return children.join(parents.select(*key).distinct(), list(key), "left_anti")


def looked_up(df: DataFrame, lookup: DataFrame, key: str, value: str, inline: Column, default: str, out: str) -> DataFrame:
    """Append ``out``: the inline name, else the looked-up one, else the default."""
    side = lookup.select(F.col(key).alias("__key"), F.col(value).alias("__value"))
    return df.join(side, df[key] == F.col("__key"), "left").withColumn(out, F.coalesce(inline, F.col("__value"), F.lit(default))).drop("__key", "__value")


def first_reference(notes: DataFrame, encounters: DataFrame, id: str, refs: str, key: str) -> DataFrame:
    """Notes with the columns of the first encounter among their references that exists; nulls if none does."""
    placed = notes.select(id, F.posexplode(refs).alias("__pos", key)).join(encounters, key)
    rest = [c for c in encounters.columns if c != key]
    chosen = placed.groupBy(id).agg(F.min_by(F.struct(key, *rest), "__pos").alias("__hit"))
    return notes.join(chosen, id, "left").select(*notes.columns, F.col(f"__hit.{key}").alias(key), *(F.col(f"__hit.{c}").alias(c) for c in rest))


def counts_by_kind(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, counts): a map from kind to number of rows."""
    parts = [df.groupBy(key).agg(F.count("*").alias("n")).select(key, F.lit(kind).alias("kind"), "n") for kind, df in frames.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("counts"))


def latest(df: DataFrame, key: Sequence[str], date: str, pos: str) -> DataFrame:
    """The row with the latest date for each key; of equal dates the first by ``pos``."""
    rest = [c for c in df.columns if c not in key]
    chosen = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(date), -F.col(pos))).alias("__row"))
    return chosen.select(*key, *(F.col(f"__row.{c}").alias(c) for c in rest))


def section_document(lines: DataFrame, key: Sequence[str], sections: Sequence[tuple[str, str]]) -> DataFrame:
    """(key, text): sections in the given order, each 'Label (n):' and its lines by ``ordinal``; empty ones left out."""
    place = F.create_map(*(F.lit(x) for i, (s, _) in enumerate(sections) for x in (s, i)))
    label = F.create_map(*(F.lit(x) for s, label in sections for x in (s, label)))
    built = lines.where(F.col("section").isin([s for s, _ in sections])).groupBy(*key, "section").agg(F.array_sort(F.collect_list(F.struct("ordinal", "line"))).alias("ls"))
    part = F.concat(label[F.col("section")], F.lit(" ("), F.size("ls").cast("string"), F.lit("):\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    ordered = built.select(*key, F.struct(place[F.col("section")].alias("at"), part.alias("part")).alias("s")).groupBy(*key).agg(F.array_sort(F.collect_list("s")).alias("ss"))
    return ordered.select(*key, F.array_join(F.transform("ss", lambda x: x["part"]), "\n\n").alias("text"))


def replace_on_key(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """New rows in place of old ones with the same key."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)
