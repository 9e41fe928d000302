"""Queries over the driver's tables, each with the DuckDB SQL that gives the same rows.

Customers stand for patients, orders for encounters, line items for observations, events for audit entries, documents for
notes, embeddings for chunk vectors, labels for verdicts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codings, dates, parsing, templates, text, units
from ..operators import answers, audit, chunking, citations, debate, filters, fuzzy, metrics, records, retrieval, sampling, scoring, truth
from ..operators.stored import folder, lower_batches, stored
from ..sources import records as sources
from ..sources import results
from ..streaming import audit as streamed_audit
from ..streaming import events as event_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WORD = r"[^\x20\x09-\x0D]+"


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


# -- records ----------------------------------------------------------------------------------------------------------


@query("""
select c_custkey::varchar as patient_id, c_name as family, case when c_custkey % 3 = 0 then 'female' when c_custkey % 3 = 1 then 'male' else 'unknown' end as gender, make_date(1950 + (c_custkey % 60)::int, 3, 1) as birth_date,
  'Jo ' || c_mktsegment || ' ' || c_name as full_name, c_custkey % 5 = 0 or c_custkey % 7 = 0 as deceased from customer""")
def patient_list(t: Tables) -> DataFrame:
    """Patients from nested records."""
    id = F.col("c_custkey")
    name = F.array(F.struct(F.col("c_name").alias("family"), F.array(F.lit("Jo"), "c_mktsegment").alias("given")))
    rows = t.customer.select(
        F.lit("Patient").alias("resourceType"), id.cast("string").alias("id"), name.alias("name"), F.when(id % 3 == 0, "female").when(id % 3 == 1, "male").otherwise("odd").alias("gender"),
        F.concat((1950 + id % 60).cast("string"), F.lit("-03-01")).alias("birthDate"), (id % 5 == 0).alias("deceasedBoolean"), F.when(id % 7 == 0, "2020-01-01").alias("deceasedDateTime"),
    )
    return sources.patients(rows)


@query("""
with e as (select o_orderkey as k, o_orderdate as d, case o_orderstatus when 'F' then 'Emergency' when 'O' then 'Inpatient' else 'Other' end as class, o_orderpriority as type from orders),
l as (select l_orderkey as k, 0 as place, lpad(l_linenumber::varchar, 3, '0') as o, '- item ' || l_partkey || ' [' || l_suppkey || ']' as line, 'Diagnoses' as label from lineitem where l_linenumber % 2 = 0
  union all select l_orderkey, 1, strftime(l_shipdate, '%Y-%m-%d'), '- item ' || l_partkey || ': ' || l_quantity::bigint || ' mg (' || strftime(l_shipdate, '%Y-%m-%d') || ')', 'Laboratory Results' from lineitem
  union all select l_orderkey, 3, lpad(l_linenumber::varchar, 3, '0'), '- item ' || l_partkey || ' [' || l_linestatus || ']', 'Medications' from lineitem where l_linenumber % 3 = 0),
s as (select k, place, label || ' (' || count(*) || '):' || chr(10) || string_agg(line, chr(10) order by o, line) as part from l group by k, place, label), b as (select k, string_agg(part, chr(10) || chr(10) order by place) as body from s group by k)
select e.k as encounter_id, md5(class || ' Encounter on ' || strftime(d, '%Y-%m-%d %H:%M') || chr(10) || chr(10) || 'Type: ' || type || chr(10) || 'Start: ' || strftime(d, '%Y-%m-%d %H:%M') || chr(10) || chr(10) || coalesce(body || chr(10), '')) as text_md5 from e left join b on e.k = b.k""")
def encounter_notes(t: Tables) -> DataFrame:
    """Whole documents of encounters: diagnoses, results and medications."""
    status = F.col("o_orderstatus")
    resources = t.orders.select(
        F.lit("Encounter").alias("resourceType"), F.col("o_orderkey").cast("string").alias("id"), F.struct(F.lit("urn:uuid:p").alias("reference")).alias("subject"), F.lit("finished").alias("status"),
        F.concat(F.lit('{"code": "'), F.when(status == "F", "EMER").when(status == "O", "IMP").otherwise("?"), F.lit('"}')).alias("class"),
        F.array(F.struct(F.array(F.struct(F.lit("s").alias("system"), F.lit("1").alias("code"), F.col("o_orderpriority").alias("display"))).alias("coding"), F.lit(None).cast("string").alias("text"))).alias("type"),
        F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start"), F.lit(None).cast("string").alias("end")).alias("period"),
        *(F.lit(None).cast(kind).alias(c) for c, kind in (("actualPeriod", sources.PERIOD), ("reason", f"array<{sources.CODED}>"), ("reasonCode", f"array<{codings.CONCEPT}>"), ("participant", "array<struct<individual: struct<display: string>>>"))),
    )
    item, day = F.concat(F.lit("item "), F.col("l_partkey").cast("string")), F.date_format("l_shipdate", "yyyy-MM-dd")
    line = lambda rows, section, order, c: rows.select(F.col("l_orderkey").cast("string").alias("encounter_id"), F.lit(section).alias("section"), order.alias("ordinal"), c.alias("line"))
    nth, own = F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), t.lineitem
    lines = line(own.where("l_linenumber % 2 = 0"), "ASSESSMENT_PLAN", nth, records.condition_line(item, F.col("l_suppkey").cast("string")))
    value = records.measured(F.struct(F.col("l_quantity").cast("double").alias("value"), F.lit("mg").alias("unit"), F.lit("").alias("code")))
    lines = lines.unionByName(line(own, "LABS", day, records.lab_line(item, value, day))).unionByName(line(own.where("l_linenumber % 3 = 0"), "MEDICATIONS", nth, records.medication_line(item, F.lit(None).cast("string"), F.col("l_linestatus"))))
    got = records.encounter_documents(records.encounters(resources), lines)
    return got.select(F.col("encounter_id").cast("long").alias("encounter_id"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""
select l_suppkey as patient_id, md5('Standalone Laboratory Results (' || count(*) || '):' || chr(10) || string_agg(line, chr(10) order by d, line)) as text_md5
from (select l_suppkey, strftime(l_shipdate, '%Y-%m-%d') as d, '- item ' || l_partkey || ': ' || l_quantity::bigint || ' mg (' || strftime(l_shipdate, '%Y-%m-%d') || ')' as line from lineitem) group by 1""")
def standalone_labs(t: Tables) -> DataFrame:
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    value = records.measured(F.struct(F.col("l_quantity").cast("double").alias("value"), F.lit("mg").alias("unit"), F.lit("").alias("code")))
    labs = t.lineitem.select(F.col("l_suppkey").alias("patient_id"), day.alias("issued"), records.lab_line(F.concat(F.lit("item "), F.col("l_partkey").cast("string")), value, day).alias("line"))
    return records.lab_summaries(labs).select("patient_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""
select o_orderkey as encounter_id, coalesce(n, 0) as n_observations, coalesce(lines, '') as lines from orders left join (
  select l_orderkey, count(*) as n, string_agg(l_linenumber || ':' || cast(l_quantity as integer), ',' order by l_linenumber, cast(l_quantity as integer)) as lines from lineitem group by 1) on l_orderkey = o_orderkey""")
def encounter_children(t: Tables) -> DataFrame:
    child = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_quantity").cast("int").alias("q"))
    got = records.with_children(t.orders.select("o_orderkey"), ["o_orderkey"], {"obs": child}, ["l_linenumber"])
    line = F.transform("obs", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["q"].cast("string")))
    return got.select(F.col("o_orderkey").alias("encounter_id"), F.size("obs").cast("long").alias("n_observations"), F.array_join(line, ",").alias("lines"))


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderdate < timestamp '1996-01-01')")
def unlinked_observations(t: Tables) -> DataFrame:
    held = t.orders.where("o_orderdate < timestamp '1996-01-01'").select(F.col("o_orderkey").alias("l_orderkey"))
    return records.unlinked(t.lineitem.select("l_orderkey", "l_linenumber"), held, ["l_orderkey"])


@query("""
select l_orderkey, l_linenumber, case when l_linenumber = 1 then 'inline ' || l_partkey else coalesce(p_name, 'Unknown medication') end as name
from lineitem left join (select * from part where p_size < 40) on p_partkey = l_partkey""")
def medication_names(t: Tables) -> DataFrame:
    inline = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("inline "), F.col("l_partkey").cast("string")))
    lookup = t.part.where("p_size < 40").withColumnRenamed("p_partkey", "l_partkey")
    got = records.looked_up(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), lookup, "l_partkey", "p_name", inline, "Unknown medication", "name")
    return got.select("l_orderkey", "l_linenumber", "name")


@query("""
select c_custkey, e.o_orderkey as encounter_id, e.o_orderdate as start from customer left join (
  select o_custkey, min_by(o_orderkey, o_orderkey) as o_orderkey, min_by(o_orderdate, o_orderkey) as o_orderdate from orders group by 1) e on o_custkey = c_custkey""")
def first_encounter_reference(t: Tables) -> DataFrame:
    refs = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("refs"))
    notes = t.customer.join(refs, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "refs")
    got = records.first_reference(notes, t.orders.select("o_orderkey", F.col("o_orderdate").alias("start")), "c_custkey", "refs", "o_orderkey")
    return got.select("c_custkey", F.col("o_orderkey").alias("encounter_id"), "start")


@query("""
select o_custkey as patient_id, array_to_string(list_sort(list(k || '=' || n)), ',') as counts from (
  select o_custkey, 'encounter' as k, count(*) as n from orders group by 1 union all
  select o_custkey, 'observation', count(*) from lineitem join orders on l_orderkey = o_orderkey group by 1) group by 1""")
def resource_counts(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    got = records.counts_by_kind({"encounter": t.orders, "observation": lines}, "o_custkey")
    shown = F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return got.select(F.col("o_custkey").alias("patient_id"), F.array_join(F.array_sort(shown), ",").alias("counts"))


@query("""
select l_partkey as lab, l_shipdate as date, l_quantity as value from (
  select *, row_number() over (partition by l_partkey order by l_shipdate desc, l_orderkey * 10 + l_linenumber) as n from lineitem) where n = 1""")
def latest_value(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_partkey").alias("lab"), F.col("l_shipdate").alias("date"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_quantity").alias("value"))
    return records.latest(rows, ["lab"], "date", "pos").select("lab", "date", "value")


@query("""
with lines as (select o_custkey, case when l_linenumber <= 2 then 'LABS' when l_linenumber <= 4 then 'MEDS' else 'SKIP' end as section, l_orderkey * 10 + l_linenumber as ordinal, 'item ' || l_partkey as line from lineitem join orders on l_orderkey = o_orderkey),
parts as (select o_custkey, section, case section when 'MEDS' then 'Medications' else 'Labs' end || ' (' || count(*) || '):' || chr(10) || string_agg(line, chr(10) order by ordinal, line) as part from lines where section <> 'SKIP' group by 1, 2)
select o_custkey as patient_id, string_agg(part, chr(10) || chr(10) order by case section when 'MEDS' then 0 else 1 end) as text from parts group by 1""")
def encounter_documents(t: Tables) -> DataFrame:
    section = F.when(F.col("l_linenumber") <= 2, "LABS").when(F.col("l_linenumber") <= 4, "MEDS").otherwise("SKIP")
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("patient_id"), section.alias("section"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.concat(F.lit("item "), F.col("l_partkey").cast("string")).alias("line"),
    )
    return records.section_document(lines, ["patient_id"], [("MEDS", "Medications"), ("LABS", "Labs")])


def _concept(code, display, text=None):
    coding = F.struct(F.lit("urn:codes").alias("system"), code.cast("string").alias("code"), display.alias("display"))
    return F.struct(F.when(code.isNotNull(), F.array(coding)).alias("coding"), (F.lit(None).cast("string") if text is None else text).alias("text"))


@query("""
select o_custkey::varchar as patient_id, o_orderkey::varchar as condition_id, case when o_orderkey % 5 <> 0 then o_orderkey % 97 || '' end as code, case when o_orderkey % 5 <> 0 then o_orderpriority else 'told: ' || o_orderpriority end as display,
  case o_orderkey % 4 when 0 then 'resolved' when 1 then 'relapse' else 'active' end as status, o_orderdate::timestamp as onset, 'e' || o_orderkey as encounter_id from orders where o_orderkey % 10 <> 0""")
def condition_rows(t: Tables) -> DataFrame:
    """Conditions of nested records: coded, in words alone, or neither (those go); odd statuses are active."""
    id = F.col("o_orderkey")
    status = F.when(id % 4 == 0, "resolved").when(id % 4 == 1, "relapse").when(id % 4 == 2, "odd")
    rows = t.orders.select(
        F.lit("Condition").alias("resourceType"), id.cast("string").alias("id"), F.struct(F.concat(F.lit("Patient/"), F.col("o_custkey").cast("string")).alias("reference")).alias("subject"),
        _concept(F.when(id % 5 != 0, id % 97), F.col("o_orderpriority"), F.when(id % 10 == 5, F.concat(F.lit("told: "), "o_orderpriority"))).alias("code"), _concept(status, status).alias("clinicalStatus"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("onsetDateTime"), F.struct(F.concat(F.lit("urn:uuid:e"), id.cast("string")).alias("reference")).alias("encounter"),
    )
    return records.conditions(rows).withColumn("onset", F.col("onset").cast("timestamp"))


@query("""
select doc_id, case doc_id % 6 when 0 then 'discharge_summary' when 1 then 'radiology_report' when 2 then 'radiology_report' when 3 then 'pathology_report' when 4 then 'lab_report' else 'clinical_note' end as document_type, 'urn:notes|' || doc_id as scoped_id from documents""")
def note_kinds(t: Tables) -> DataFrame:
    titles = ["DISCHARGE summary of lab", "Chest Radiology", "imaging, pathology", "Pathology of lab", "Lab panel", "Progress note"]
    title = F.element_at(F.array(*map(F.lit, titles)), (F.col("doc_id") % 6 + 1).cast("int"))
    return t.documents.select("doc_id", codings.note_type(title).alias("document_type"), codings.scoped_id(F.lit("urn:notes"), F.col("doc_id").cast("string")).alias("scoped_id"))


@query("select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as position from events")
def timeline_positions(t: Tables) -> DataFrame:
    return filters.timeline_order(t.events.select("user_id", "event_id", "ts"), "user_id", "ts", ["event_id"]).select("user_id", "event_id", "position")


@query("""
with r as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as rank from events),
m as (select user_id, unnest([2, 1, 99999, 2]) as rank from (select distinct user_id from events))
select distinct user_id, event_id as chunk_id from m join r using (user_id, rank)""")
def marked_chunks(t: Tables) -> DataFrame:
    """Chunks that an answer's [n] marks name; marks beyond the chunks name none."""
    chunks = t.events.select("user_id", F.col("event_id").alias("chunk_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("rank"))
    said = t.events.select("user_id").distinct().withColumn("answer", F.lit("It rose [2], then fell [1] [99999]; see [2]."))
    return answers.cited_chunks(said, chunks, "user_id").select("user_id", "chunk_id").distinct()


@query("""
select event_id, round(case when event_id % 4 = 0 then value else 0.5 * value + 50 * least(greatest(value / 80 - 0.2, 0), 1) end, 6) as score from events""")
def dual_scores(t: Tables) -> DataFrame:
    near = F.when(F.col("event_id") % 4 != 0, F.col("value") / 80 - 0.2)
    return t.events.select("event_id", r6(citations.dual_score(F.col("value"), near)).alias("score"))


@query("""
with n as (select user_id, avg(value) as v from events group by 1), a as (select round(avg(v), 4) as x, round(max(v), 4) as y from n where user_id % 2 = 0), b as (select round(avg(v), 4) as x, round(max(v), 4) as y from n where user_id % 2 = 1)
select 0 as ordinal, 'even' as configuration, x, y from a union all select 1, 'odd', x, y from b union all select 2, 'delta', b.x - a.x, b.y - a.y from a, b""")
def compared_runs(t: Tables) -> DataFrame:
    """Metrics of configurations, and how the last differs from the first."""
    n = t.events.groupBy("user_id").agg(F.avg("value").alias("v"))
    half = lambda i: n.where(F.col("user_id") % 2 == i).agg(F.round(F.avg("v"), 4).alias("x"), F.round(F.max("v"), 4).alias("y"))
    return scoring.configurations([("even", half(0)), ("odd", half(1))], ["x", "y"])


@query("""
select o_orderkey, o_totalprice from orders where o_orderkey % 10 <> 0 union all select o_orderkey, o_totalprice * 2 from orders where o_orderkey % 10 = 0 and o_orderpriority is not null""")
def replaced_reruns(t: Tables) -> DataFrame:
    old = t.orders.select("o_orderkey", "o_totalprice")
    new = t.orders.where("o_orderkey % 10 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return records.replace_on_key(old, new, ["o_orderkey"])


@query("""
select o_orderkey, o_custkey % 7 as batch, case when o_custkey % 7 in (2, 5) then o_totalprice * 2 else o_totalprice end as price from orders where o_custkey % 7 not in (2, 5) or o_orderkey % 2 = 0""")
def stored_reruns(t: Tables) -> DataFrame:
    """Results stored by batch; a rerun of two batches, with other prices and only half of the rows, replaces them."""
    path = folder(t.spark, "results")
    rows = t.orders.select("o_orderkey", (F.col("o_custkey") % 7).alias("batch"), F.col("o_totalprice").alias("price"))
    results.replace_results(rows, path, ["batch"])
    again = rows.where("batch in (2, 5) and o_orderkey % 2 = 0").withColumn("price", F.col("price") * 2)
    results.replace_results(again, path, ["batch"])
    return results.read_results(t.spark, path, ["batch"])


@query(r"""
select page_id, case when url like 'urn:uuid:%' then substr(url, 10) when contains(url, '/') then regexp_extract(url, '^[^/]*/(.*)$', 1) else url end as reference, case when url like 'https:%' then substr(url, 8) end as prefixed from pages""")
def reference_ids(t: Tables) -> DataFrame:
    return t.pages.select("page_id", codings.reference_id(F.col("url")).alias("reference"), codings.prefixed_id(F.col("url"), "https:").alias("prefixed"))


@query("""
select o_orderkey, datediff('day', date '1960-05-17', cast(o_orderdate as date)) // 365 as age, 'Lab Report > Labs Results (' || strftime(o_orderdate, '%Y-%m-%d') || ')' as shown,
  case when contains(lower(o_orderpriority), 'high') then 'x' end is null as plain from orders""")
def ages_and_sources(t: Tables) -> DataFrame:
    shown = codings.display_source(F.lit("lab_report"), F.lit("labs_results"), F.col("o_orderdate"))
    return t.orders.select("o_orderkey", codings.age(F.lit("1960-05-17").cast("date"), F.col("o_orderdate").cast("date")).cast("long").alias("age"), shown.alias("shown"), (~F.contains(F.lower("o_orderpriority"), F.lit("high"))).alias("plain"))


@query("select event_type as type, count(*) as n, min(ts) as first, max(ts) as last from events where ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-12' group by 1")
def timeline_range(t: Tables) -> DataFrame:
    held = filters.timeline(t.events, "ts", F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-12").cast("timestamp"))
    return held.groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


# -- text, dates, units -------------------------------------------------------------------------------------------------


_NORMAL = r"trim(regexp_replace(regexp_replace(lower({0}), '[^A-Za-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("select p_partkey, " + _NORMAL.format("p_name || ' (HTN, 2019-03-04) at 10:30'") + " as normal, " + _NORMAL.format(r"regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' (HTN, 2019-03-04) at 10:30'), '\b(?:on\s+)?\d{4}[-/]\d{2}[-/]\d{2}\b', '', 'g'), '\b\d{4}\b', '', 'g'), '\b\d{1,2}:\d{2}(?::\d{2})?\b', '', 'g')") + " as entity, replace(" + _NORMAL.format("p_name || ' (HTN, 2019-03-04) at 10:30'") + ", 'htn', 'hypertension') as expanded from part")
def normal_forms(t: Tables) -> DataFrame:
    c = F.concat("p_name", F.lit(" (HTN, 2019-03-04) at 10:30"))
    return t.part.select("p_partkey", text.normalize(c).alias("normal"), text.normalize_entity(c).alias("entity"), text.expand_abbreviations(c).alias("expanded"))


@query("""
with d as (select o_orderkey, o_orderdate as d, o_orderkey % 7 as k from orders)
select o_orderkey, case when k = 6 then null else strftime(d, '%Y-%m-%d') end as parsed from d""")
def record_dates(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    forms = ["yyyy-MM-dd'T'HH:mm:ss'+00:00'", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy", "dd-MMM-yyyy", "MMMM d, yyyy", "yyyyMMddHHmmss"]
    written = F.lit("some day")
    for i, f in enumerate(forms):
        written = F.when(F.col("o_orderkey") % 7 == i, F.date_format(d, f)).otherwise(written)
    return t.orders.select("o_orderkey", F.date_format(dates.record_date(F.concat(F.lit(" "), written, F.lit(" "))), "yyyy-MM-dd").alias("parsed"))


@query("""
select o_orderkey, case o_orderkey % 4 when 0 then o_orderdate - interval 180 day when 1 then o_orderdate - interval 365 day when 2 then o_orderdate - interval 21 day end as start,
  case when o_orderkey % 4 < 3 then o_orderdate end as "end" from orders""")
def relative_ranges(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 4
    phrase = F.when(k == 0, "labs of the LAST 6 months").when(k == 1, "over the past year").when(k == 2, "within the previous 3 weeks").otherwise("all labs")
    got = dates.relative_range(phrase, F.col("o_orderdate"))
    return t.orders.select("o_orderkey", got["start"].alias("start"), got["end"].alias("end"))


@query("select l_orderkey, l_linenumber, abs(cast(floor((epoch(l_shipdate) - epoch(o_orderdate) - 3600) / 86400) as bigint)) as days from lineitem join orders on l_orderkey = o_orderkey")
def days_apart(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", dates.days_between(F.col("l_shipdate"), F.col("o_orderdate") + F.expr("interval 1 hour")).alias("days"))


@query("""
select o_orderkey, strftime(least(d1, d2), '%Y-%m-%d') || case when d1 <> d2 then ',' || strftime(greatest(d1, d2), '%Y-%m-%d') else '' end as found, case when o_orderkey % 2 = 0 then 1 else 0 end + case when d1 <> d2 and o_orderkey % 2 = 0 then 1 else 0 end as issues
from (select o_orderkey, cast(o_orderdate as date) as d1, cast(o_orderdate as date) + cast(o_orderkey % 40 as integer) as d2 from orders)""")
def dates_in_text(t: Tables) -> DataFrame:
    d1 = F.col("o_orderdate").cast("date")
    d2 = F.date_add(d1, (F.col("o_orderkey") % 40).cast("int"))
    answer = F.concat(F.lit("Seen on "), F.date_format(d1, "yyyy-MM-dd"), F.lit(", again "), F.date_format(d2, "M/d/yyyy"), F.lit(" and on "), F.date_format(d1, "MMMM d, yyyy"), F.lit("."))
    evidence = F.when(F.col("o_orderkey") % 2 == 1, F.array(d1, d2)).otherwise(F.array().cast("array<date>"))
    return t.orders.select("o_orderkey", F.array_join(F.transform(dates.extract(answer), lambda d: F.date_format(d, "yyyy-MM-dd")), ",").alias("found"), F.size(dates.temporal_issues(answer, evidence)).alias("issues"))


@query("""
select l_orderkey, l_linenumber, round(case l_linenumber when 1 then l_quantity * 1000.0 when 2 then (l_quantity - 32) * 5 / 9 when 3 then null when 4 then l_quantity * 2.54 else null end, 6) as converted from lineitem""")
def unit_conversion(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    unit = F.when(n == 1, "Grams").when(n == 2, "fahrenheit").when(n == 3, "mg/dL").when(n == 4, "inches").otherwise("furlong")
    to = F.when(n == 1, "mg").when(n == 2, "degC").when(n == 3, "mmol/L").when(n == 4, "cm").otherwise("m")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", unit.alias("unit"), to.alias("to"))
    return units.convert(rows, "l_quantity", "unit", "to").select("l_orderkey", "l_linenumber", r6("converted").alias("converted"))


@query("select p_partkey, 'GLU ' || p_size || ' mg/dL, HR ' || p_size || ' bpm, T ' || p_size || ' degF, BP mmHg' as spelled from part")
def unit_spellings(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    raw = F.concat(F.lit("GLU "), size, F.lit(" MG/DL, HR "), size, F.lit(" beats / min, T "), size, F.lit(" deg F, BP MMHG"))
    return t.part.select("p_partkey", units.spell(raw).alias("spelled"))


@query(r"""
select doc_id, i - 1 as n, s as sentence, length(rtrim(s, '.')) < 25 as transition from (
  select doc_id, unnest(ss) as s, generate_subscripts(ss, 1) as i from (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.?!])[\t\n\f\r ]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as ss from documents))""")
def sentence_split(t: Tables) -> DataFrame:
    split = t.documents.select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("n", "sentence"))
    return split.select("doc_id", F.col("n").cast("long").alias("n"), "sentence", (F.length(F.rtrim(F.col("sentence"), F.lit("."))) < 25).alias("transition"))


@query("""
with p as (select p_partkey, lower(p_name) as n, list_distinct(string_split(lower(p_name), ' ')) as w from part)
select a.p_partkey as a, b.p_partkey as b from p a join p b on a.p_partkey <> b.p_partkey
where a.p_partkey % 50 = 0 and (contains(a.n, b.n) or contains(b.n, a.n) or len(list_intersect(a.w, b.w)) * 2 >= least(len(a.w), len(b.w)))""")
def entity_pairs(t: Tables) -> DataFrame:
    """Stated parts with all others that name the same."""
    asked = t.part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("a"), "p_name")
    return fuzzy.matching_pairs(asked, t.part.select(F.col("p_partkey").alias("b"), "p_name"), "a", "b", "p_name", "p_name").where("a <> b")


# -- chunks and retrieval -----------------------------------------------------------------------------------------------


@query(rf"""
with w as (select doc_id, source, regexp_extract_all(text, '{WORD}') as ws from documents),
s as (select *, len(ws) as n, unnest(range(0, len(ws), 295)) as first from w where len(ws) > 0),
p as (select *, ws[first + 1 : first + 393] as piece, cast(floor(len(ws[first + 1 : first + 393]) * 1.3::double) as integer) as token_count from s),
k as (select *, row_number() over (partition by doc_id order by first) - 1 as chunk_index, count(*) over (partition by doc_id) as total_chunks from p where token_count >= 50 or n <= 295)
select doc_id, chunk_index, total_chunks, token_count, substr(sha256(source || '::' || doc_id || '::' || chunk_index), 1, 16) as chunk_id, md5(array_to_string(piece, ' ')) as text_md5 from k""")
def document_chunks(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").alias("document_id"), F.col("source").alias("patient_id"), F.lit("other").alias("section"), F.lit(0).alias("pos"), F.col("text").alias("body"))
    got = chunking.chunks(docs)
    return got.select(F.col("document_id").alias("doc_id"), F.col("chunk_index").cast("long").alias("chunk_index"), F.col("total_chunks").cast("long").alias("total_chunks"), "token_count", "chunk_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(rf"""
select doc_id, n, cast(sum(l) over (partition by doc_id order by n) - wl as bigint) as char_start, cast(sum(l) over (partition by doc_id order by n) as bigint) as char_end from (
  select doc_id, generate_subscripts(ps, 1) - 1 as n, length(unnest(ps)) as l, length(regexp_extract(unnest(ps), '{WORD}')) as wl from (select doc_id, regexp_extract_all(text, '[\x20\x09-\x0D]*{WORD}') as ps from documents))""")
def word_places(t: Tables) -> DataFrame:
    got = chunking.word_offsets(t.documents, "doc_id", "text")
    return got.select("doc_id", F.col("n").cast("long").alias("n"), "char_start", "char_end")


@query(rf"""
with w as (select doc_id, source, unnest(regexp_extract_all(lower(text), '{WORD}')) as term from documents)
select source, term, count(distinct doc_id) as df, count(*) as cf from w group by 1, 2""")
def term_statistics(t: Tables) -> DataFrame:
    tf = retrieval.terms(t.documents.select(F.struct("source", "doc_id").alias("id"), "text"), "id", "text")
    return tf.groupBy(F.col("id.source").alias("source"), "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


_BM25 = rf"""
w as (select doc_id, unnest(regexp_extract_all(lower(text), '{WORD}')) as term from documents),
tf as (select doc_id, term, count(*) as tf from w group by 1, 2), dl as (select doc_id, len(regexp_extract_all(text, '{WORD}')) as dl from documents),
corpus as (select count(*) as n, avg(dl) as avgdl from dl), df as (select term, count(*) as df from tf group by 1), q as (select doc_id as query_id, term from tf where doc_id % 50 = 0),
scored as (select query_id, tf.doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score
  from q join df using (term) join tf using (term) join dl on dl.doc_id = tf.doc_id, corpus group by 1, 2)"""


@query(f"with {_BM25} select query_id, doc_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from scored) where rank <= 30")
def bm25_top(t: Tables) -> DataFrame:
    """Whole texts of the stated queries against all documents."""
    queries = t.documents.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    got = retrieval.bm25(queries, t.documents.select("doc_id", "text"), [], 30, chunk="doc_id")
    return got.select("query_id", "doc_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(rf"""
with w as (select lang, doc_id, regexp_extract_all(lower(text), '{WORD}') as ws from documents), tf as (select lang, doc_id, len(ws) as dl, unnest(ws) as term from w), c as (select lang, doc_id, dl, term, count(*) as tf from tf group by all),
corpus as (select lang, count(*) as n, avg(len(ws)) as avgdl from w group by 1), df as (select lang, term, count(*) as df from c group by 1, 2),
q as (select source as query_id, lang, unnest(['of', 'de', 'qqqq']) as term from (select distinct source, lang from documents)),
s as (select query_id, lang, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from q join df using (lang, term) join c using (lang, term) join corpus using (lang) group by all),
a as (select query_id, lang, doc_id, coalesce(score, 0) as score from (select distinct source as query_id, lang from documents) join (select lang, doc_id from documents) using (lang) left join s using (query_id, lang, doc_id))
select query_id, lang, doc_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id, lang order by round(score, 9) desc, doc_id) as rank from a) where rank <= 200""")
def bm25_with_zeros(t: Tables) -> DataFrame:
    """Questions of a few words within their language; chunks without a term fill the ranking up."""
    key = F.concat_ws("|", "source", "lang")
    asked = t.documents.select("source", "lang").distinct().select(key.alias("query_id"), "lang", F.lit("of DE qqqq of").alias("text"))
    got = retrieval.bm25(asked, t.documents.select("doc_id", "lang", "text"), ["lang"], 200, chunk="doc_id", keep_zero=True)
    part = lambda n: F.split_part("query_id", F.lit("|"), F.lit(n))
    return got.select(part(1).alias("query_id"), part(2).alias("lang"), "doc_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


_DENSE = """
scored as (select q.vec_id as query_id, v.vec_id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) as score, v.label from embeddings q, embeddings v where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as rank from scored)"""


@query(f"with {_DENSE} select query_id, vec_id, round(score, 6) as score, rank from ranked where rank <= 30")
def dense_top(t: Tables) -> DataFrame:
    queries = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = retrieval.dense_top_k(queries, t.embeddings, [], 30, chunk="vec_id")
    return got.select("query_id", "vec_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


_FUSED = """
s as (select q.vec_id as query_id, v.vec_id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) as a, list_cosine_similarity(q.embedding[1:32]::double[], v.embedding[1:32]::double[]) as b from embeddings q, embeddings v where q.vec_id % 50 = 0),
r as (select query_id, vec_id, row_number() over (partition by query_id order by round(a, 9) desc, vec_id) as ra, row_number() over (partition by query_id order by round(b, 9) desc, vec_id) as rb from s),
f as (select query_id, vec_id, case when ra <= 30 then 1.0 / (20 + ra) else 0 end::double + case when rb <= 30 then 1.0 / (20 + rb) else 0 end::double as rrf, case when ra <= 30 then ra end as first from r where ra <= 30 or rb <= 30)"""


@query(f"with {_FUSED} select query_id, vec_id, round(rrf, 6) as rrf, rank from (select *, row_number() over (partition by query_id order by round(rrf, 12) desc, first nulls last, vec_id) as rank from f) where rank <= 15")
def fused_top(t: Tables) -> DataFrame:
    whole, half = t.embeddings, t.embeddings.withColumn("embedding", F.slice("embedding", 1, 32))
    ranks = [retrieval.dense_top_k(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, [], 30, chunk="vec_id") for e in (whole, half)]
    return retrieval.fuse(ranks, chunk="vec_id").select("query_id", "vec_id", r6("rrf").alias("rrf"), F.col("rank").cast("long").alias("rank"))


_SECTIONS = "['chief_complaint','history_present_illness','past_medical_history','medications','allergies','social_history','family_history','review_of_systems','physical_exam','assessment_plan','labs_results','imaging','procedures','other']"
_TYPES = "['factual','temporal','numeric','temporal_numeric','medication','summary','comparison','unknown']"


@query(f"""
with c as (select source as query_id, doc_id, text, {_SECTIONS}[cast(doc_id * 7 % 14 as integer) + 1] as section, cast(doc_id * 7 % 14 as integer) as place, {_TYPES}[cast(substr(source, 4) as integer) % 8 + 1] as kind, case when doc_id % 3 = 0 then 'lab_report' else 'clinical_note' end as dt,
    case when doc_id % 5 <> 0 then timestamp '2020-01-01' + to_days(cast(doc_id * 37 % 1500 as integer)) end as d, row_number() over (partition by source order by doc_id) as rank from documents),
s as (select *, greatest(0.0, 5.0 - floor((epoch(timestamp '2024-06-01') - epoch(d)) / 86400) / 365.0) as r5, greatest(0.0, 3.0 - floor((epoch(timestamp '2024-06-01') - epoch(d)) / 86400) / 365.0) as r3,
    len(regexp_extract_all(text, '[0-9]')) / greatest(length(text), 1)::double as dd, section in ('history_present_illness','past_medical_history','assessment_plan','labs_results') as ts, section in ('labs_results','physical_exam') as ns,
    section in ('medications','allergies','assessment_plan','history_present_illness') as ms, row_number() over (partition by query_id, section order by rank) as turn from c),
k as (select *, case kind when 'temporal' then -(if(ts, 2.0, 0.0) + if(d is null, -1.0, r5)) when 'numeric' then -(if(dt = 'lab_report', 3.0, 0.0) + if(ns, 2.0, 0.0) + 10.0 * dd)
    when 'temporal_numeric' then -(if(ts, 1.5, 0.0) + if(d is null, 0.0, r3) + if(dt = 'lab_report', 2.0, 0.0) + if(ns, 1.5, 0.0) + 8.0 * dd) when 'summary' then turn when 'medication' then if(ms, 0, 1) when 'comparison' then coalesce(epoch(d), 'infinity'::double) else 0 end::double as k1,
    case when kind = 'summary' then place when kind = 'medication' and ms then coalesce(-epoch(d), 'infinity'::double) else 0 end::double as k2 from s)
select query_id, doc_id, branch_rank from (select query_id, doc_id, kind, row_number() over (partition by query_id order by if(isinf(k1), k1, round(k1, 9)), k2, rank) as branch_rank from k)
where branch_rank <= case kind when 'temporal_numeric' then 20 when 'summary' then 25 when 'comparison' then 20 else 15 end""")
def branch_rerank(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    at = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    id = F.col("doc_id")
    rows = t.documents.select(
        F.col("source").alias("query_id"), "doc_id", "text", at(retrieval.SECTIONS, id * 7 % 14).alias("section"), at(parsing.QUERY_TYPES, F.substring("source", 4, 9).cast("int") % 8).alias("query_type"),
        F.when(id % 3 == 0, "lab_report").otherwise("clinical_note").alias("document_type"), F.when(id % 5 != 0, F.date_add(F.lit("2020-01-01").cast("date"), (id * 37 % 1500).cast("int")).cast("timestamp")).alias("encounter_date"),
        F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("rank"),
    )
    got = retrieval.branch_rerank(rows, F.lit("2024-06-01").cast("timestamp"))
    return got.select("query_id", "doc_id", F.col("branch_rank").cast("long").alias("branch_rank"))


@query("select query_id, doc_id from (select lang as query_id, doc_id, row_number() over (partition by lang, md5(text) order by source, doc_id) as n from documents) where n = 1")
def merged_subqueries(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("lang").alias("query_id"), F.md5(F.col("text").cast("binary")).alias("chunk_id"), "source", "doc_id")
    return retrieval.merge_first(rows, "query_id", "chunk_id", ["source", "doc_id"]).select("query_id", "doc_id")


@query("""
select source as query_id, string_agg('[' || n || '] ' || lang || ': ' || substr(text, 1, 300), chr(10) order by n) as evidence from (select *, row_number() over (partition by source order by doc_id) as n from documents) where n <= 15 group by 1""")
def evidence_blocks(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    rows = t.documents.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    return retrieval.evidence_block(rows, "source", F.col("lang"), F.col("text"), F.col("n"), 15, 300).withColumnRenamed("source", "query_id")


# -- audit --------------------------------------------------------------------------------------------------------------


@query("""
select user_id, count(*) as n, list_reduce(list_prepend('', list(props order by event_id)), lambda a, x: sha256(a || x)) as tip from events group by 1""")
def chain_tips(t: Tables) -> DataFrame:
    chain = audit.build_chain(t.events.select("user_id", "event_id", "props"), "user_id", "event_id", "props")
    return chain.groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("entry_hash", "event_id").alias("tip"))


@query("""
with e as (select user_id, event_id, props, row_number() over (partition by user_id order by event_id) as n from events)
select user_id, count(*) as entries, max(case when n = 3 and user_id % 4 = 0 then 1 else 0 end) = 0 as valid, min(case when n = 3 and user_id % 4 = 0 then event_id end) as first_bad from e group by 1""")
def chain_verdicts(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    chain = audit.build_chain(t.events.select("user_id", "event_id", "props"), "user_id", "event_id", "props")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    tampered = chain.withColumn("props", F.when((nth == 3) & (F.col("user_id") % 4 == 0), F.concat("props", F.lit("!"))).otherwise(F.col("props")))
    return audit.verify_chain(tampered, "user_id", "event_id", "props")


@query("""
with e as (select *, max(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as before from events)
select user_id, event_id, event_type from e where coalesce(before, 0) = 0""")
def provenance(t: Tables) -> DataFrame:
    return audit.provenance(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "purchase")


@query("""
select user_id, count(*) as calls, round(max(spent), 8) as usd, count(*) filter (spent > 0.002) as over from (select user_id, sum((event_id % 100 * 3 + event_id % 7 * 15) / 1e6) over (partition by user_id order by event_id rows between unbounded preceding and current row) as spent from events) group by 1""")
def token_costs(t: Tables) -> DataFrame:
    """Tokens at 3 and 15 dollars a million, with a budget for each session."""
    id = F.col("event_id")
    got = audit.cost(t.events.select("event_id", "user_id"), "user_id", "event_id", audit.usd(id % 100, id % 7, F.lit(3.0), F.lit(15.0)), 0.002)
    return got.groupBy("user_id").agg(F.count("*").alias("calls"), F.round(F.max("spent"), 8).alias("usd"), F.count_if("over").alias("over"))


@query("""
select event_id, round(spent, 6) as spent, spent > 500 as over from (select event_id, sum(value) over (partition by user_id order by event_id rows between unbounded preceding and current row) as spent from events)""")
def running_cost(t: Tables) -> DataFrame:
    got = audit.cost(t.events.select("event_id", "user_id", "value"), "user_id", "event_id", F.col("value"), 500.0)
    return got.select("event_id", r6("spent").alias("spent"), "over")


@query("""
select user_id, count(*) as n, list_reduce(list_prepend('', list(props order by event_id)), lambda a, x: sha256(a || x)) as tip from events group by 1""")
def streamed_tips(t: Tables) -> DataFrame:
    """The chains of ``chain_tips``, written by a stream."""
    place = folder(t.spark, "stream")
    entries = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parque[t]")  # a pattern, since a stream takes no single file
    streamed_audit.write_chain(entries, f"{place}/log", f"{place}/state", "user_id", "event_id", "props").awaitTermination()
    log = streamed_audit.read_chain(t.spark, f"{place}/log")
    return log.groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("entry_hash", "event_id").alias("tip"))


@query("""select event_id, sha256('{"data":"' || event_type || '","entry_id":' || event_id || ',"session_id":' || user_id || '}') as digest from events""")
def canonical_entries(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.sha2(audit.canonical_json(session_id=F.col("user_id"), entry_id=F.col("event_id"), data=F.col("event_type")), 256).alias("digest"))


@query("select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n from events group by 1, 2")
def event_windows_batch(t: Tables) -> DataFrame:
    return event_windows.windowed_counts(t.events)


# -- model output and scores ----------------------------------------------------------------------------------------------


@query("""
select event_id, case event_type when 'click' then 'numeric' when 'view' then 'temporal' else 'unknown' end as kind, least(greatest(floor(value * 10) / 1000, 0), 1) as confidence, cast(json_extract_string(props, '$.k') as varchar) as k,
  case when event_id % 3 = 0 then 'approved' when event_id % 3 = 1 then 'revised' else 'abstained' end as verdict, case when event_id % 9 = 0 then 0 else least(greatest(event_id % 9, 1), 5) end::integer as judged from events""")
def parsed_output(t: Tables) -> DataFrame:
    id, kind = F.col("event_id"), F.col("event_type")
    said = F.when(kind == "click", "It is NUMERIC.").when(kind == "view", " temporal ").otherwise("hm")
    shown = F.concat(F.lit("confidence: "), (F.floor(F.col("value") * 10) / 1000).cast("string"), F.lit(" or so"))
    word = F.when(id % 3 == 0, " Approve ").when(id % 3 == 1, "REVISED").otherwise("who knows")
    digit = F.when(id % 9 == 0, "none").otherwise((id % 9).cast("string"))
    return t.events.select("event_id", parsing.enum_value(said).alias("kind"), parsing.clipped(parsing.number(shown)).alias("confidence"), parsing.json_field(F.concat(F.lit("Here:\n```json\n"), F.col("props"), F.lit("\n```")), "k").alias("k"), parsing.verdict(word).alias("verdict"), parsing.judge_score(digit).alias("judged"))


@query("""
with e as (select event_id, event_type in ('click', 'view') as flagged, event_id % 2 = 0 as bad, least(value / 100, 1.0) as c from events)
select event_id, round(2 * c * bad::integer - c * c, 6) + 0.0 as brier, case when c >= 1 then -1.0 when c - 0.5 <= -0.1 then 1.0 else 0.0 end::double as challenge, round(case when flagged and bad then 1 + 0.3 * (1 - c) when not flagged and not bad then 1 + 0.3 * c when bad then -1 else -0.5 end, 6)::double as detection from e""")
def rewards(t: Tables) -> DataFrame:
    c, bad = F.least(F.col("value") / 100, F.lit(1.0)), F.col("event_id") % 2 == 0
    flagged = F.col("event_type").isin("click", "view")
    return t.events.select("event_id", (r6(parsing.brier(c, bad.cast("int"))) + 0.0).alias("brier"), parsing.challenger_reward(c, c - 0.5).alias("challenge"), r6(parsing.detection_reward(flagged, bad, c)).alias("detection"))


_CELLS = "count(*) filter (quality = 0 and toxic = 1) as tp, count(*) filter (quality = 0 and toxic = 0) as fp, count(*) filter (quality = 1 and toxic = 0) as tn, count(*) filter (quality = 1 and toxic = 1) as fn"
_SHARES = "round(tp / greatest(tp + fp, 1), 6) as precision, round(tp / greatest(tp + fn, 1), 6) as recall, round(2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1)) / greatest(tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1), 1e-8), 6) as f1, round((tp + tn) / greatest(tp + fp + tn + fn, 1), 6) as accuracy"


@query(f"select lang, tp, fp, tn, fn, {_SHARES} from (select lang, {_CELLS} from labels join documents using (doc_id) group by 1)")
def confusion_by_lang(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    got = metrics.confusion(rows, F.col("quality") == 0, F.col("toxic") == 1, ["lang"])
    return got.select("lang", "tp", "fp", "tn", "fn", *(r6(c).alias(c) for c in ("precision", "recall", "f1", "accuracy")))


@query(f"select tp, fp, tn, fn, {_SHARES} from (select {_CELLS} from labels)")
def confusion_total(t: Tables) -> DataFrame:
    got = metrics.confusion(t.labels, F.col("quality") == 0, F.col("toxic") == 1)
    return got.select("tp", "fp", "tn", "fn", *(r6(c).alias(c) for c in ("precision", "recall", "f1", "accuracy")))


@query(f"""
with {_DENSE}, r as (select query_id, rank, (label = (select label from embeddings e where e.vec_id = query_id))::integer as relevant from ranked where rank <= 100)
select query_id, round(case when a > 0 then h / a else 0 end, 6) as recall, round(h / 15, 6) as precision, round(case when a > 0 then coalesce(1 / f, 0) else 0 end, 6) as mrr, round(case when a > 0 then d / i else 0 end, 6) as ndcg from (
  select query_id, sum(relevant * (rank <= 15)::integer) as h, sum(relevant) as a, min(case when relevant = 1 then rank end) as f, sum(case when rank <= 15 then relevant / log2(rank + 1) else 0 end) as d,
    (select sum(1 / log2(x + 1)) from range(1, 16) g(x) where x <= least(sum(relevant), 15)) as i from r group by 1)""")
def ranking_quality(t: Tables) -> DataFrame:
    """The first 100 of each stated query over all vectors; relevant are those of its label among them."""
    e = t.embeddings
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    ranked = retrieval.dense_top_k(queries, e, [], 100, chunk="vec_id")
    wanted = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    rows = ranked.join(wanted, "query_id").join(e.select("vec_id", "label"), "vec_id").withColumn("relevant", (F.col("label") == F.col("wanted")).cast("int"))
    return metrics.ranked_quality(rows, "query_id", 15).select("query_id", *(r6(c).alias(c) for c in ("recall", "precision", "mrr", "ndcg")))


@query("""
with v as (select list(toxic order by doc_id) as vs, avg(toxic) as mean, count(*) as n from labels),
m as (select b, mean, list_sum(list_transform(range(1, n + 1), lambda j: vs[cast((('0x' || substr(md5(b || ':' || j), 1, 8))::bigint % n) + 1 as integer)])) / n as m from v, range(10000) r(b))
select round(any_value(mean), 6) as mean, round(list_sort(list(m))[251], 6) as ci_low, round(list_sort(list(m))[9751], 6) as ci_high from m""")
def bootstrap_ci(t: Tables) -> DataFrame:
    got = metrics.bootstrap(t.labels.withColumn("toxic", F.col("toxic").cast("double")), "toxic", "doc_id", 10_000)
    return got.select(*(r6(c).alias(c) for c in ("mean", "ci_low", "ci_high")))


@query("""
select lang as model, count(*) as n, round(avg(case when n_chars > 0 then n_chars end), 6) as mean_chars, list_sort(list(n_chars))[count(*) // 2 + 1] as upper_median, round(count(*) filter (source in ('src0', 'src1')) / count(*), 6) as share from documents group by 1""")
def model_rollup(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.col("lang").alias("model")).agg(
        F.count("*").alias("n"), r6(F.avg(F.when(F.col("n_chars") > 0, F.col("n_chars")))).alias("mean_chars"), metrics.upper_median("n_chars").alias("upper_median"),
        r6(F.count_if(F.col("source").isin("src0", "src1")) / F.count("*")).alias("share"),
    )


@query("""
select source, round(avg(n_chars) filter (lang = 'de'), 4) as de, round(avg(n_chars) filter (lang = 'en'), 4) as en, round(avg(n_chars) filter (lang = 'es'), 4) as es, round(avg(n_chars) filter (lang = 'fr'), 4) as fr from documents group by 1""")
def type_by_model(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.round(F.avg("n_chars"), 4))


@query("""
select event_id, round((value - m) / (s + 1e-8), 4) as advantage from events join (select user_id, avg(value) as m, stddev_samp(value) as s from events group by 1) using (user_id) where s >= 1e-8""")
def group_advantage(t: Tables) -> DataFrame:
    return metrics.group_advantage(t.events.select("event_id", "user_id", "value"), "user_id", "value").select("event_id", F.round("advantage", 4).alias("advantage"))


@query("""
with c as (select user_id, event_type in ('click', 'view') as material, least(greatest(value / 100 - 0.02, 0), 1) as s from events),
a as (select user_id, coalesce(min(s) filter (material), 1.0) as mn, coalesce(avg(s) filter (not material), 1.0) as me from c group by 1)
select user_id, round(mn, 6) as material_min, round(me, 6) as contextual_mean, round(0.7 * mn + 0.3 * me, 6) as aggregate, case when mn = 0 then 'abstained' when 0.7 * mn + 0.3 * me >= 0.9 then 'approved' else 'revised' end as route from a""")
def debate_routes(t: Tables) -> DataFrame:
    claims = t.events.select("user_id", F.when(F.col("event_type").isin("click", "view"), "material").otherwise("contextual").alias("claim_type"), (F.col("value") / 100 - 0.02).alias("score"))
    return metrics.judge_scores(claims, "user_id").select("user_id", *(r6(c).alias(c) for c in ("material_min", "contextual_mean", "aggregate")), "route")


@query(r"""
with p as (select a.conv_id, a.turn, regexp_extract_all(lower(a.text), '[a-z0-9]+') as aw, regexp_extract_all(lower(u.text), '[a-z0-9]+') as uw from conversations a join conversations u on u.conv_id = a.conv_id and u.turn = a.turn - 1 where a.role = 'assistant'),
f as (select *, list_filter(aw, lambda x: x not in ('the', 'of', 'and', 'to')) as told from p)
select conv_id, turn, round(case when len(told) = 0 then 1.0 else len(list_filter(told, lambda x: list_contains(uw, x))) / len(told) end, 6)::double as faithfulness from f""")
def faithfulness(t: Tables) -> DataFrame:
    a = t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    u = t.conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("evidence"))
    return a.join(u, ["conv_id", "turn"]).select("conv_id", "turn", r6(metrics.faithfulness(F.col("answer"), F.col("evidence"), ["the", "of", "and", "to"])).alias("faithfulness"))


@query("""
with s as (select o_custkey, list_distinct(list(o_orderkey % 7)) as found, list_distinct(list(o_orderkey % 5)) as wanted from orders group by 1)
select o_custkey, round(len(list_intersect(found, wanted)) / len(found), 6) as precision, round(len(list_intersect(found, wanted)) / len(wanted), 6) as recall from s""")
def citation_sets(t: Tables) -> DataFrame:
    sets = t.orders.groupBy("o_custkey").agg(F.collect_set(F.col("o_orderkey") % 7).alias("found"), F.collect_set(F.col("o_orderkey") % 5).alias("wanted"))
    precision, recall = metrics.set_scores(F.col("found"), F.col("wanted"))
    return sets.select("o_custkey", r6(precision).alias("precision"), r6(recall).alias("recall"))


# -- training data ----------------------------------------------------------------------------------------------------------


@query("select doc_id, case when ('0x' || substr(md5(doc_id || '|42'), 1, 8))::bigint < 3865470566 then 'train' else 'test' end as part from documents")
def seeded_split(t: Tables) -> DataFrame:
    return sampling.split(t.documents.select("doc_id"), 42, 0.9, "doc_id")


@query("""
with c as (select source as query_id, doc_id, (doc_id % 7 = 0) as relevant from documents where length(text) >= 20),
n as (select query_id, doc_id, row_number() over (partition by query_id order by md5(query_id || '|' || doc_id || '|42')) as k from c where not relevant)
select c.query_id, c.doc_id as positive_id, n.doc_id as negative_id from c join n on c.query_id = n.query_id where relevant and k <= 5""")
def training_triplets(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("source").alias("query_id"), F.col("doc_id").alias("chunk_id"), "text", (F.col("doc_id") % 7 == 0).cast("int").alias("relevant"))
    return sampling.triplets(rows)


@query("""
select doc_id, unnest([false, true]) as is_hallucinated, unnest([md5(text), md5(lang)]) as answer from documents""")
def qa_answer_rows(t: Tables) -> DataFrame:
    pairs = t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("ground_truth"), F.md5(F.col("lang").cast("binary")).alias("hallucinated"))
    return sampling.answer_rows(pairs).select("doc_id", "is_hallucinated", "answer")


# -- sections, claims, citations, verdicts ----------------------------------------------------------------------------------


@query("""
select o_orderkey, 0 as pos, 'other' as section, 'Seen by ' || o_orderstatus as body from orders union all
select o_orderkey, 1, 'chief_complaint', o_orderpriority || chr(10) || 'and more' from orders union all
select o_orderkey, 2, 'medications', 'item ' || o_custkey || chr(10) || chr(10) || 'item again' from orders union all
select o_orderkey, 3, 'labs_results', 'value ' || o_orderkey from orders""")
def note_sections(t: Tables) -> DataFrame:
    nl = "\n"
    note = F.concat(
        F.lit("Seen by "), "o_orderstatus", F.lit(nl + "Chief Complaint:" + nl), "o_orderpriority", F.lit(nl + "and more" + nl + "MEDICATIONS" + nl + "item "), F.col("o_custkey").cast("string"),
        F.lit(nl + " Lab Results : " + nl + "value "), F.col("o_orderkey").cast("string"), F.lit(nl + "Medications" + nl + "item again" + nl + nl),
    )
    got = chunking.sections(t.orders.select("o_orderkey", note.alias("text")), "o_orderkey")
    return got.withColumn("pos", F.col("pos").cast("int"))


@query("""
select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as claim_id, case when n > 1 then 'item ' || l_partkey else '1. item ' || l_partkey end as claim
from (select *, count(*) over (partition by l_orderkey) as n from lineitem)""")
def answer_claims(t: Tables) -> DataFrame:
    items = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("ls"))
    said = F.array_join(F.transform("ls", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". item "), x["l_partkey"].cast("string"))), "\n")
    got = debate.split_claims(items.select("l_orderkey", said.alias("answer")), "l_orderkey")
    return got.select("l_orderkey", F.col("claim_id").cast("long").alias("claim_id"), "claim")


@query("""
with d as (select doc_id, text, length(text) as n from documents)
select doc_id, start, md5(substr(text, start + 1, 500)) as window_md5 from (select doc_id, text, unnest(case when n <= 500 then [0] else range(0, n - 500 + 1, 125) end) as start from d)""")
def citation_windows(t: Tables) -> DataFrame:
    got = citations.windows(t.documents.select("doc_id", "text"))
    return got.select("doc_id", F.col("start").cast("long").alias("start"), F.md5(F.col("window").cast("binary")).alias("window_md5"))


@query(r"""
select doc_id, case when length(f) <= 120 then f else rtrim(substr(f, 1, 117)) || '...' end as excerpt from (select doc_id, trim(replace(text, chr(10), ' ')) as f from documents)""")
def reference_excerpts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", citations.excerpt(F.col("text")).alias("excerpt"))


@query("""
select event_id, case when event_id % 3 = 0 then 'SUPPORTED' when event_id % 3 = 1 then 'NOT_SUPPORTED' else 'PARTIAL' end as verdict, round(case when event_id % 3 < 2 then least(value / 100, 1.0) else 0.5 end, 6) as confidence from events""")
def verified_claims(t: Tables) -> DataFrame:
    claims = t.events.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("claim_id"))
    said = t.events.where("event_id % 3 < 2").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("claim_id"), F.when(F.col("event_id") % 3 == 0, "SUPPORTED").otherwise("NOT_SUPPORTED").alias("verdict"), (F.col("value") / 100).alias("confidence"))
    return debate.verified(claims, said).select(F.col("claim_id").alias("event_id"), "verdict", r6("confidence").alias("confidence"))


_AXES = """
with d as (select lang, toxic, doc_id, doc_id * 7 % 11 / 10 as a, doc_id * 3 % 11 / 10 as b, doc_id * 5 % 11 / 10 as c from documents left join labels using (doc_id)),
r as (select lang, count(*) as n, count(*) filter (toxic is null) as answerable, round(avg(a) filter (toxic is null), 4) as x, round(avg(b) filter (toxic is null), 4) as y, round(avg(c) filter (toxic is null), 4) as z,
  coalesce(round(avg(a) filter (toxic is null and a > 0), 4), 0) as rouge, coalesce(round(avg(b - 0.1) filter (toxic is null and b - 0.1 >= 0), 4), 0) as sim,
  coalesce(round(count(*) filter (toxic = 1) / nullif(count(*) filter (toxic is not null), 0), 3), 0) as abs, coalesce(round(avg(doc_id) filter (doc_id > 0)), 0) as ms from d group by 1)"""


@query(_AXES + """
select lang as model, n, answerable, x as precision, y as recall, z as f1, x as hallucination_rate, y as context_precision, z as context_recall, x as citation_accuracy, y as safety_error_rate, rouge as rouge_l, sim as semantic_sim, abs as abstention_accuracy, ms as latency_ms from r""")
def model_means(t: Tables) -> DataFrame:
    """All means of each language's documents, as if they were a model's answers."""
    return scoring.roll_up(_as_results(t), "lang").withColumnRenamed("lang", "model")


@query(_AXES + """
select lang as model, round((x + 1 - x) / 2, 4) as factuality, round((y + z + sim + rouge) / 4, 4) as relevance, round((y + z + x) / 3, 4) as grounding, round((abs + 1 - y) / 2, 4) as safety from r""")
def model_axes(t: Tables) -> DataFrame:
    return scoring.axes(scoring.roll_up(_as_results(t), "lang"), "lang").withColumnRenamed("lang", "model")


def _as_results(t: Tables) -> DataFrame:
    """Documents as results of models: label toxic as abstention, shares made from the id."""
    share = lambda k: F.col("doc_id") * k % 11 / 10
    parts = {c: share(k) for c, k in zip(("precision", "recall", "f1", "hallucination_rate", "context_precision", "context_recall", "citation_accuracy", "safety_error_rate"), (7, 3, 5, 7, 3, 5, 7, 3), strict=True)}
    parts |= {"rouge_l": share(7), "semantic_sim": share(3) - F.lit(0.1), "latency_ms": F.col("doc_id").cast("double")}
    return t.documents.join(t.labels, "doc_id", "left").select("lang", (F.col("toxic") == 1).alias("abstained"), *(c.alias(n) for n, c in parts.items()))


@query("""
select event_id, case when (v or c) = b then 1.0 else -1.0 end + case when v = c then case when (v or c) = b then 0.3 else -0.3 end else 0 end::double as shared,
  round(0.5 * p + 0.3 * case when v = b then 1 when b then -1 else -0.5 end + 0.2 * (p - case when c = b then 1 when b then -1 else -0.5 end), 6)::double as verifier
from (select *, case when (v or c) = b then 1.0 when b then -1.0 else -0.5 end as p from (select event_id, event_type = 'click' as v, value > 50 as c, event_id % 2 = 0 as b from events))""")
def agent_rewards(t: Tables) -> DataFrame:
    said = F.concat(F.lit('{"verdict": "'), F.when(F.col("event_type") == "click", "partial").otherwise("supported"), F.lit('"}'))
    challenge = F.when(F.col("value") > 50, '[{"challenge_type": "dose"}]').otherwise("[]")
    v, c, b = parsing.verifier_flags(said), parsing.challenger_flags(challenge), F.col("event_id") % 2 == 0
    return t.events.select("event_id", parsing.shared_rewards(v, c, b)[0].alias("shared"), r6(parsing.hybrid_rewards(v, c, b)[0]).alias("verifier"))


@query("""
select count(*) filter (flagged and bad) as tp, count(*) filter (flagged and not bad) as fp, count(*) filter (not flagged and not bad) as tn, count(*) filter (not flagged and bad) as fn
from (select doc_id, false as bad, quality = 0 as flagged from labels union all select doc_id, true, toxic = 1 or quality = 0 from labels)""")
def pair_detection(t: Tables) -> DataFrame:
    rows = sampling.answer_rows(t.labels.select("doc_id", "quality", "toxic", F.lit("a").alias("ground_truth"), F.lit("b").alias("hallucinated")))
    flagged = (F.col("quality") == 0) | (F.col("is_hallucinated") & (F.col("toxic") == 1))
    return metrics.confusion(rows, flagged, F.col("is_hallucinated")).select("tp", "fp", "tn", "fn")


@query("select event_type as type, round(avg((value > 60)::int), 6) as accuracy from events group by 1")
def pair_accuracy(t: Tables) -> DataFrame:
    got = metrics.positive_share(t.events.select("event_type", (F.col("value") - 60).alias("score")), "score", ["event_type"])
    return got.select(F.col("event_type").alias("type"), r6("accuracy").alias("accuracy"))


@query("""
with p as (select lang || ':' || doc_id // 500 as run, list(struct_pack(i := doc_id, e := doc_id % 3 = 0) order by doc_id) as rs from documents group by 1)
select run as patient_id, i as query_index, r.i as doc_id from (select run, unnest(rs) as r, generate_subscripts(rs, 1) - 1 as i from p) where not r.e""")
def saved_answers(t: Tables) -> DataFrame:
    """Answers of saved runs, each of a language and 500 ids: positions count those with an error, which are left out."""
    one = F.struct("doc_id", F.when(F.col("doc_id") % 3 == 0, "failed").alias("error"))
    run = F.concat_ws(":", "lang", F.floor(F.col("doc_id") / 500).cast("string"))
    runs = t.documents.groupBy(run.alias("run")).agg(F.array_sort(F.collect_list(one)).alias("rag_results")).select(F.array(F.struct(F.col("run").alias("patient_id"), "rag_results")).alias("patient_results"))
    return sources.flatten_runs(runs).select("patient_id", F.col("query_index").cast("long").alias("query_index"), "result.doc_id")


@query("""
select doc_id, 'APPROVED' as chosen, 'ABSTAINED' as rejected from labels where toxic = 0 and quality = 1 union all select doc_id, 'REVISED', 'APPROVED' from labels where toxic = 1""")
def preference_pairs(t: Tables) -> DataFrame:
    results = t.labels.select(F.lit("p").alias("patient_id"), F.col("doc_id").alias("query_index"))
    truth = t.labels.select(F.lit("p").alias("patient_id"), F.col("doc_id").alias("query_index"), (F.col("toxic") * 0.5).alias("hallucination_rate"), (F.col("quality") * 0.8).alias("f1"))
    return sampling.preference_pairs(results, truth).select(F.col("query_index").alias("doc_id"), "chosen", "rejected")


@query("""
select doc_id, bad as is_hallucinated, case when bad then 'not_supported' else 'supported' end as expected_verdict, case when bad then 0.0 else 1.0 end::double as judge_target_score, md5(case when bad then 'not ' || lang else text end) as answer_md5 from documents, (values (false), (true)) v(bad)""")
def trajectories(t: Tables) -> DataFrame:
    rows = sampling.trajectories(t.documents.select("doc_id", F.col("text").alias("ground_truth"), F.concat(F.lit("not "), "lang").alias("hallucinated")))
    return rows.select("doc_id", "is_hallucinated", "expected_verdict", "judge_target_score", F.md5(F.col("answer").cast("binary")).alias("answer_md5"))


@query(f"with {_DENSE} select query_id, round(max(greatest(score, 0)), 6) as faithfulness from ranked where vec_id <> query_id group by 1")
def semantic_faithfulness(t: Tables) -> DataFrame:
    queries = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = retrieval.dense_top_k(queries, t.embeddings, [], 2, chunk="vec_id").where("vec_id <> query_id")
    return got.groupBy("query_id").agg(r6(F.max(F.greatest("score", F.lit(0.0)))).alias("faithfulness"))


@query("select conv_id, turn, case when role = 'user' then 'numeric' when role = 'assistant' then 'summary' else 'unknown' end as query_type, case when role = 'user' then 0.9 when role = 'assistant' then 0.4 else 0.0 end::double as router_confidence from conversations")
def routed_questions(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([(1, "[user]", '{"query_type": "numeric", "confidence": 0.9}'), (2, "[assistant]", 'So:\n```json\n{"query_type": "summary", "confidence": 0.4}\n```')], "priority int, keyword string, response string")
    prompts = t.conversations.select("conv_id", "turn", F.concat(F.lit("["), "role", F.lit("] ")).alias("prompt"))
    return answers.route(answers.mock_model(prompts, rules, "no idea")).select("conv_id", "turn", "query_type", "router_confidence")


@query("select l_orderkey, l_linenumber, cast(o_orderdate as date) = cast(l_shipdate as date) as valid, case when cast(o_orderdate as date) = cast(l_shipdate as date) then 0 else 1 end as issues from lineitem join orders on l_orderkey = o_orderkey")
def temporal_validity(t: Tables) -> DataFrame:
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    said = t.lineitem.select(key.alias("query_id"), F.concat(F.lit("Given on "), F.date_format("l_shipdate", "MMMM d, yyyy"), F.lit(".")).alias("answer"))
    known = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(key.alias("query_id"), F.lit("no dates here").alias("text"), F.col("o_orderdate").alias("encounter_date"))
    got = answers.temporal_check(said, known)
    return got.select("query_id.l_orderkey", "query_id.l_linenumber", "valid", F.size("issues").alias("issues"))


@query()
def entity_scores(t: Tables) -> DataFrame:
    """Item names of an order against what an answer lists of them: the first two, and one that is in no order."""
    items = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    truth = items.select(F.col("l_orderkey").alias("query_id"), F.col("p_name").alias("entity"), F.col("p_type").alias("name"), F.lit(None).cast("string").alias("code"))
    held = items.groupBy(F.col("l_orderkey").alias("query_id")).agg(F.slice(F.array_sort(F.collect_set("p_name")), 1, 2).alias("ns"))
    said = held.select("query_id", F.concat(F.lit("1. quixotic zephyr\n2. "), F.array_join("ns", "\n3. ")).alias("answer"))
    return scoring.entity_scores(said, truth)


@query()
def rouge_of_replies(t: Tables) -> DataFrame:
    a = t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    u = t.conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return a.join(u, ["conv_id", "turn"]).select("conv_id", "turn", scoring.rouge_l(F.col("answer"), F.col("reference")).alias("rouge_l"))


@query()
def cleaned_notes(t: Tables) -> DataFrame:
    lower_batches(t.spark)  # whole texts go to Python
    return t.documents.select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query()
def verified_answers(t: Tables) -> DataFrame:
    """Each whole reply, and a name that nobody said, against all that was said in its conversation."""
    key = F.concat_ws(":", "conv_id", "turn").alias("query_id")
    replies = t.conversations.where("role = 'assistant'")
    said = replies.select(key, F.concat(F.lit("1. "), F.coalesce("text", F.lit("")), F.lit("\n2. quixotic zephyr")).alias("answer"))
    own = replies.select(key, "conv_id").join(t.conversations.select("conv_id", F.col("turn").alias("rank"), "text"), "conv_id")
    return answers.verify_entities(said, own.select("query_id", "rank", "text"))


@query()
def cited_replies(t: Tables) -> DataFrame:
    """Whole texts of the stated documents as answers, cited from the five best chunks of all other documents.

    A document's own chunks rank among the first, so as many more are asked for as the longest document has.
    """
    lower_batches(t.spark)  # whole chunks and their sentences go to Python
    chunks = chunking.chunks(t.documents.select(F.col("doc_id").alias("document_id"), F.lit("all").alias("patient_id"), F.lit("other").alias("section"), F.lit(0).alias("pos"), F.col("text").alias("body")))
    chunks = stored(chunks.select("chunk_id", "document_id", "text"), "chunks")
    said = t.documents.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("answer"))
    most = chunks.where("document_id % 50 = 0").groupBy("document_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    hits = retrieval.bm25(said.withColumnRenamed("answer", "text"), chunks.select("chunk_id", "text"), [], 5 + most)
    held = hits.join(chunks.select("chunk_id", "document_id"), "chunk_id").where("document_id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id"))
    best = held.withColumn("rank", place).where("rank <= 5").select("query_id", "chunk_id", "rank")
    # five rows for each stated document go to the texts, which stay where they are
    return citations.cite(said, F.broadcast(best).join(chunks.select("chunk_id", "text"), "chunk_id").select("query_id", "chunk_id", "rank", "text"))


_DEBATE = """
c0 as (select user_id as q, event_id as c, event_type in ('click', 'view') as m, case event_id % 4 when 0 then 'NOT_SUPPORTED' when 1 then 'PARTIAL' else 'SUPPORTED' end as v, least(greatest(0.9 + value / 100, 0), 1) as s from events),
d0 as (select q from c0 where m group by q having bool_and(v = 'SUPPORTED' and s >= 0.95)),
r1 as (select q, c from c0 where v = 'SUPPORTED' and (c + 1) % 50 = 0 and q not in (from d0)),
c1 as (select q, c, m, case when r1.c is not null and s - 0.3 < 0.65 then 'PARTIAL' else v end as v, case when r1.c is not null then s - 0.3 else s end as s from c0 left join r1 using (q, c)),
d1 as (select q from c1 where m group by q having bool_and(v = 'SUPPORTED' and s >= 0.95)),
r2 as (select q, c from c1 where v = 'SUPPORTED' and (c + 2) % 50 = 0 and q not in (from d1) and q in (select q from r1)),
c2 as (select q, c, m, case when r2.c is not null and s - 0.3 < 0.65 then 'PARTIAL' else v end as v, case when r2.c is not null then s - 0.3 else s end as s from c1 left join r2 using (q, c))"""


@query(f"""
with {_DEBATE}, n as (select q, count(*) as n from (from r1 union all from r2) group by 1)
select q as user_id, count(*) as claims, count(*) filter (v = 'SUPPORTED') as supported, round(avg(s), 6) as confidence, any_value(1 + (q in (select q from r1))::integer) as cycles, any_value(coalesce(n.n, 0)) as challenges from c2 left join n using (q) group by 1""")
def debate_cycles(t: Tables) -> DataFrame:
    """Two cycles of challenge and revision over each user's claims; the models are rules of the claim's number."""
    id = F.col("event_id")
    verdict = F.when(id % 4 == 0, "NOT_SUPPORTED").when(id % 4 == 1, "PARTIAL").otherwise("SUPPORTED")
    claims = t.events.select(
        F.col("user_id").alias("query_id"), id.alias("claim_id"), F.when(F.col("event_type").isin("click", "view"), "material").otherwise("contextual").alias("claim_type"),
        verdict.alias("verdict"), F.least(F.greatest(0.9 + F.col("value") / 100, F.lit(0.0)), F.lit(1.0)).alias("confidence"),
    )

    def challenger(supported: DataFrame, cycle: int) -> DataFrame:
        return supported.where((F.col("claim_id") + cycle) % 50 == 0).select("query_id", "claim_id")

    def reviser(held: DataFrame, challenges: DataFrame, cycle: int) -> DataFrame:
        less = held.join(challenges, ["query_id", "claim_id"]).withColumn("confidence", F.col("confidence") - 0.3)
        return less.select("query_id", "claim_id", F.when(F.col("confidence") < 0.65, "partial").alias("verdict"), "confidence")

    after, _, told = debate.debated(claims, challenger, reviser)
    sums = after.groupBy("query_id").agg(F.count("*").alias("claims"), F.count_if(F.col("verdict") == "SUPPORTED").alias("supported"), r6(F.avg("confidence")).alias("confidence"))
    return sums.join(told, "query_id").select(F.col("query_id").alias("user_id"), "claims", "supported", "confidence", "cycles", "challenges")


@query(r"""
with c as (select source, doc_id, lang, text, row_number() over (partition by source order by doc_id) as n from documents),
e as (select source, string_agg('[' || n || '] ' || lang || case when source in ('src0', 'src1') and doc_id % 2 = 0 then ' (2024-01-0' || (1 + doc_id % 9) || ')' else '' end || ': ' || substr(text, 1, 80) || chr(10), '' order by n) as lines from c where n <= 5 group by 1)
select source, sha256(case source when 'src0' then 'Say what happened when: go by date, and give each event its date.' when 'src1' then 'Give values with their units and dates, and compare them with their usual ranges.' else 'Answer from the evidence alone, with all that bears on the question.' end
  || chr(10) || chr(10) || 'Question: What of ' || source || '?' || chr(10) || chr(10) || 'Evidence:' || chr(10) || lines || 'Mark each fact with the [number] of its evidence. Write <reasoning>, <answer> and <source_chunks>.') as prompt_sha256 from e""")
def rendered_prompts(t: Tables) -> DataFrame:
    """Reasoning prompts of a source's first documents, dated ones for two query types."""
    at = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    date = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("2024-01-0"), (1 + F.col("doc_id") % 9).cast("string")))
    one = F.struct(at.alias("n"), F.col("lang").alias("source"), date.alias("date"), F.substring("text", 1, 80).alias("text"))
    held = t.documents.select(F.col("source").alias("of"), one.alias("x")).where("x.n <= 5").groupBy("of").agg(F.array_sort(F.collect_list("x")).alias("chunks"))
    kind = F.when(F.col("of") == "src0", "temporal").when(F.col("of") == "src1", "numeric").otherwise("factual")
    prompt = templates.reasoning_prompt(kind, F.concat(F.lit("What of "), "of", F.lit("?")), F.col("chunks"))
    return held.select(F.col("of").alias("source"), F.sha2(prompt, 256).alias("prompt_sha256"))


@query("""
select event_id, sha256('{"data":{"kind":"' || event_type || '","tags":[{"a":1,"b":"' || event_type || '"}]},"entry_id":' || event_id || ',"session_id":' || user_id || '}') as digest, event_type as kind from events""")
def audit_rows(t: Tables) -> DataFrame:
    """Entries written with keys in order at every depth, and read again."""
    data = F.struct(F.array(F.struct(F.col("event_type").alias("b"), F.lit(1).alias("a"))).alias("tags"), F.col("event_type").alias("kind"))
    rows = t.events.select("event_id", F.col("user_id").alias("session_id"), F.col("event_id").alias("entry_id"), data.alias("data"))
    written = audit.entry_json(rows, ["session_id", "entry_id", "data"], "text").select("event_id", "text")
    read = audit.read_entries(written, "session_id long, entry_id long, data struct<kind string>", "text")
    return read.where("entry_id = event_id").select("event_id", F.sha2("text", 256).alias("digest"), F.col("data.kind").alias("kind"))


@query("""
with r as (select doc_id, bad, case when doc_id % 7 = 0 then '' when quality = 1 then 'supported' else 'partial' end as v, toxic = 1 as challenged from labels, (values (false), (true)) b(bad)),
c as (select *, case when bad then v in ('not_supported', 'partial') else v = 'supported' end as vc, challenged = bad as cc from r)
select doc_id, bad as is_hallucinated, vc as verifier_correct, cc as challenger_correct, case when vc and cc then 1.0 when vc or cc then 0.0 else -1.0 end::double as shared_reward from c""")
def agent_trajectories(t: Tables) -> DataFrame:
    rows = sampling.answer_rows(t.labels.select("doc_id", "quality", "toxic", F.lit("a").alias("ground_truth"), F.lit("b").alias("hallucinated")))
    said = F.when(F.col("doc_id") % 7 == 0, "no verdict").when(F.col("quality") == 1, '{"verdict": "Supported", "confidence": 0.9}').otherwise('{"confidence": 0.4, "verdict" : "partial"}')
    raised = F.when(F.col("toxic") == 1, '[{"challenge_type": "omission", "challenge_text": "x"}]').when(F.col("doc_id") % 2 == 0, "[]")
    got = sampling.pipeline_trajectories(rows.withColumn("verifier_output", said).withColumn("challenger_output", raised))
    return got.select("doc_id", "is_hallucinated", "verifier_correct", "challenger_correct", "shared_reward")


@query("""
with d as (select detector, bad, case when detector = 'critic' then quality = 0 else toxic = 1 or quality = 0 end as flagged from labels, (values ('critic'), ('debate')) v(detector), (values (false), (true)) b(bad) where doc_id % 3 <> 0 or not bad)
select detector, count(*) filter (flagged and bad) as tp, count(*) filter (flagged and not bad) as fp, count(*) filter (not flagged and not bad) as tn, count(*) filter (not flagged and bad) as fn from d group by 1
union all select null, 0, 0, 0, (select count(*) from labels where doc_id % 3 = 0)""")
def detector_rows(t: Tables) -> DataFrame:
    """Two detectors' words on both answers of each question; answers that none has seen count as not flagged."""
    pairs = t.labels.select("doc_id", F.lit("a").alias("ground_truth"), F.lit("b").alias("hallucinated"))
    each = t.labels.select("*", F.explode(F.array(F.lit("critic"), F.lit("debate"))).alias("detector")).select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("is_hallucinated"))
    flagged = F.when(F.col("detector") == "critic", F.col("quality") == 0).otherwise((F.col("toxic") == 1) | (F.col("quality") == 0))
    responses = each.where("doc_id % 3 <> 0 or not is_hallucinated").withColumn("is_flagged", flagged).select("doc_id", "is_hallucinated", "detector", "is_flagged")
    rows = sampling.detected(pairs, responses, "doc_id").withColumn("is_flagged", F.coalesce("is_flagged", F.lit(False)))
    return metrics.confusion(rows, F.col("is_flagged"), F.col("is_hallucinated"), ["detector"]).select("detector", "tp", "fp", "tn", "fn")


# -- scope and truth --------------------------------------------------------------------------------------------------------


@query("select o_orderkey, case when o_orderkey % 11 = 0 then 400 when o_custkey % 3 = 0 then 422 else 200 end as status from orders")
def scope_gate(t: Tables) -> DataFrame:
    asked = t.orders.select("o_orderkey", F.col("o_custkey").alias("patient_id"), (F.col("o_orderkey") % 11 != 0).alias("body_ok"))
    loaded = t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("patient_id"))
    return filters.scoped(asked, loaded).select("o_orderkey", "status")


@query("select event_id, event_type from events where user_id = 7 and ts <= timestamp '2024-01-20' and event_type <> 'view'")
def session_lookup(t: Tables) -> DataFrame:
    log = t.events.withColumn("session_id", F.col("user_id").cast("string"))
    held = filters.audit_entries(filters.timeline(log, "ts", end=F.lit("2024-01-20").cast("timestamp"), kind=F.col("event_type") != "view"), session="7")
    return held.select("event_id", "event_type")


@query("select vec_id, vec_id % 7 <> 0 as ok from embeddings")
def index_input(t: Tables) -> DataFrame:
    cut = t.embeddings.withColumn("embedding", F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 8)).otherwise(F.col("embedding")))
    good, bad = filters.indexable(cut, 64)
    return good.select("vec_id", F.lit(True).alias("ok")).unionByName(bad.select("vec_id", F.lit(False).alias("ok")))


@query("select doc_id, place as \"at\", md5(substr(substr(text, 1, 5000), place + 1, 500)) as segment_md5 from (select doc_id, text, unnest(range(0, least(length(text), 5000), 500)) as place from documents)")
def record_segments(t: Tables) -> DataFrame:
    return filters.segments(t.documents, "doc_id").select("doc_id", F.col("at").cast("long").alias("at"), F.md5(F.col("segment").cast("binary")).alias("segment_md5"))


@query("""
with c as (select o_custkey as patient_id, o_orderkey as encounter_id, o_orderdate as start from orders), l as (select c.patient_id, c.encounter_id, 'item ' || l_partkey % 50 as entity from lineitem join c on l_orderkey = encounter_id where l_linenumber > 1),
last as (select patient_id, encounter_id from (select *, row_number() over (partition by patient_id order by start desc, encounter_id) as n from c) where n = 1),
m as (select l.*, l.encounter_id = last.encounter_id as recent from l join last using (patient_id)), s as (select patient_id, bool_or(recent) as has_recent from m group by 1)
select distinct m.patient_id, entity from m join s using (patient_id) where recent or not has_recent""")
def recent_conditions(t: Tables) -> DataFrame:
    enc = t.orders.select(F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("encounter_id"), F.col("o_orderdate").alias("start"))
    name = F.concat(F.lit("item "), (F.col("l_partkey") % 50).cast("string"))
    cond = t.lineitem.where("l_linenumber > 1").join(enc, F.col("l_orderkey") == F.col("encounter_id")).select("patient_id", "encounter_id", name.alias("display"), F.lit(None).cast("string").alias("code"))
    return truth.recent_conditions(cond, enc).select("patient_id", "entity")


@query("""
select l_suppkey as patient_id, 'lab ' || p || ' ' || cast(q as integer) || ' mg' as entity from (
  select l_suppkey, l_partkey % 40 as p, l_quantity as q, row_number() over (partition by l_suppkey, l_partkey % 40 order by l_shipdate desc, l_orderkey * 10 + l_linenumber, l_partkey) as n from lineitem) where n = 1""")
def lab_entities(t: Tables) -> DataFrame:
    pos = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")
    labs = t.lineitem.select(F.col("l_suppkey").alias("patient_id"), F.concat(F.lit("lab "), (F.col("l_partkey") % 40).cast("string")).alias("display"), F.col("l_quantity").cast("int").alias("value"), F.lit("mg").alias("unit"), F.col("l_shipdate").alias("date"), pos.alias("pos"))
    return truth.lab_entities(labs).select("patient_id", "entity")


@query("""
select o_orderpriority as type, count(*) as n, count(*) filter (o_orderkey % 10 = 0) as errors, round(avg(o_totalprice) filter (o_orderkey % 10 <> 0)) as avg_latency_ms, list_sort(list(o_totalprice) filter (o_orderkey % 10 <> 0))[count(*) filter (o_orderkey % 10 <> 0) // 2 + 1] as median_latency_ms,
  round(count(*) filter (o_orderstatus = 'F') / count(*), 3) as abstention_rate, round(count(*) filter (o_orderkey % 10 <> 0 and o_orderkey % 4 > 0) / count(*) filter (o_orderkey % 10 <> 0), 3) as citation_coverage, round(avg(case when o_orderkey % 6 > 0 then o_orderkey % 6 end), 2) as quality from orders group by 1""")
def run_statistics(t: Tables) -> DataFrame:
    id = F.col("o_orderkey")
    rows = t.orders.select(
        F.col("o_orderpriority").alias("type"), F.when(id % 10 == 0, "failed").alias("error"), F.col("o_totalprice").alias("latency_ms"), (id % 4).alias("n_citations"),
        F.when(F.col("o_orderstatus") == "F", "abstained").otherwise("approved").alias("verdict"), (id % 6).alias("judge_score"), F.lit(-1.0).alias("faithfulness"),
    )
    return truth.run_stats(rows, "type").select("type", "n", "errors", "avg_latency_ms", "median_latency_ms", "abstention_rate", "citation_coverage", "quality")


@query("""
select e as expected, count(*) filter (p = 'APPROVED') as "APPROVED", count(*) filter (p = 'REVISED') as "REVISED", count(*) filter (p = 'ABSTAINED') as "ABSTAINED", count(*) filter (p not in ('APPROVED', 'REVISED', 'ABSTAINED')) as "UNKNOWN", round(avg((p = e)::integer), 6) as accuracy
from (select ['APPROVED','REVISED','ABSTAINED'][cast(event_id % 3 + 1 as integer)] as e, case event_type when 'click' then 'APPROVED' when 'view' then 'REVISED' when 'purchase' then 'ABSTAINED' else 'hm' end as p from events) group by 1""")
def verdict_matrix(t: Tables) -> DataFrame:
    expected = F.element_at(F.array(F.lit("APPROVED"), F.lit("REVISED"), F.lit("ABSTAINED")), (F.col("event_id") % 3 + 1).cast("int"))
    kind = F.col("event_type")
    said = F.when(kind == "click", "APPROVED").when(kind == "view", "REVISED").when(kind == "purchase", "ABSTAINED").otherwise("hm")
    got = truth.verdict_matrix(t.events, expected, said)
    return got.select("expected", "APPROVED", "REVISED", "ABSTAINED", "UNKNOWN", r6("accuracy").alias("accuracy"))


@query("select p_partkey, round((contains(lower(p_name), 'a')::integer + contains(lower(p_name), 'e')::integer + contains(lower(p_name), 'zz')::integer) / 3, 6) as relevance from part")
def answer_relevance(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", r6(truth.relevance(F.col("p_name"), F.array(F.lit("A"), F.lit("e"), F.lit("zz")))).alias("relevance"))


# -- model output --------------------------------------------------------------------------------------------------------------


@query("""
select conv_id, turn, case when turn % 4 = 0 then 'sufficient' when turn % 4 = 1 then 'insufficient' when turn % 4 = 2 then 'ambiguous' else 'sufficient' end as verdict, case when turn % 4 = 3 then 0.5 else (turn % 5) / 10 end::double as coverage,
  case when turn % 4 = 3 then 0 else turn % 3 end as n_missing, case when turn % 4 = 1 then 'ask ' || conv_id end as reformulated from conversations""")
def retrieval_verdicts(t: Tables) -> DataFrame:
    turn = F.col("turn")
    word = F.element_at(F.array(*map(F.lit, ("sufficient", "INSUFFICIENT", "ambiguous"))), (turn % 4 + 1).cast("int"))
    said = F.to_json(F.struct(word.alias("verdict"), (turn % 5 / 10).alias("coverage_score"), F.array_repeat(F.lit("dose"), (turn % 3).cast("int")).alias("missing_aspects"), F.when(turn % 4 == 1, F.concat(F.lit("ask "), F.col("conv_id").cast("string"))).alias("reformulated_query")))
    rows = t.conversations.select("conv_id", "turn", F.when(turn % 4 == 3, "cannot say {").otherwise(F.concat(F.lit("So:\n"), said, F.lit(" and {more}"))).alias("response"))
    return answers.sufficiency(rows).select("conv_id", "turn", F.col("retrieval_verdict").alias("verdict"), "coverage", F.size("missing").cast("long").alias("n_missing"), "reformulated")


@query("""
select conv_id, turn, turn % 3 = 0 as valid, case when turn % 3 = 2 then 1 else turn % 2 end as n_issues from conversations""")
def numeric_checks(t: Tables) -> DataFrame:
    turn = F.col("turn")
    said = F.to_json(F.struct((turn % 3 == 0).alias("valid"), F.array_repeat(F.lit("unit"), (turn % 2).cast("int")).alias("issues"), F.array().cast("array<string>").alias("corrections")))
    rows = t.conversations.select("conv_id", "turn", F.when(turn % 3 == 2, "no JSON").otherwise(said).alias("response"))
    return answers.numeric_check(rows).select("conv_id", "turn", F.col("numeric_valid").alias("valid"), F.size("numeric_issues").cast("long").alias("n_issues"))


@query("""
select conv_id, turn, case when turn % 3 = 0 then 'approved' when turn % 3 = 1 then 'approved' else 'abstained' end as verdict, case when turn % 3 = 0 then coalesce(text, '') when turn % 3 = 1 then 'better' else 'Insufficient evidence.' end as final, case when turn % 3 = 0 then 1 when turn % 3 = 1 then 2 else 3 end::bigint as attempts from conversations""")
def critic_attempts(t: Tables) -> DataFrame:
    """Three attempts of a critic: approved at once, after a revision, or abstained from after two."""
    turn, key = F.col("turn"), F.concat_ws(":", "conv_id", "turn")
    say = lambda v, text=None: F.lit('{"verdict": "%s"%s}' % (v, "" if text is None else f', "revised_text": "{text}"'))
    rows = t.conversations.select("conv_id", "turn", key.alias("query_id"), F.coalesce("text", F.lit("")).alias("answer"), F.when(turn % 3 == 0, say("APPROVED")).otherwise(say("revise", "better")).alias("r1"), F.when(turn % 3 == 1, say("approve")).otherwise(say("REVISED", "best")).alias("r2"), F.lit("none").alias("r3"))
    return answers.critic_turns(rows, ["r1", "r2", "r3"]).select("conv_id", "turn", "verdict", "final", F.col("attempts").cast("long").alias("attempts"))


@query("""
with c as (select *, case when role = 'user' then 'summary' when role = 'assistant' then 'factual' else 'comparison' end as kind from conversations)
select conv_id, turn, i as sub_index, case when kind = 'factual' or n < 2 then coalesce(text, '') else 'part ' || i end as sub_question from (select *, turn % 6 as n from c) , lateral (select unnest(range(0, case when kind = 'factual' or n < 2 then 1 else least(n, 4) end)) as i)""")
def sub_questions(t: Tables) -> DataFrame:
    n = (F.col("turn") % 6).cast("int")
    kind = F.when(F.col("role") == "user", "summary").when(F.col("role") == "assistant", "factual").otherwise("comparison")
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.concat(F.lit("part "), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    rows = t.conversations.select(F.struct("conv_id", "turn").alias("query_id"), F.coalesce("text", F.lit("")).alias("question"), kind.alias("query_type"), F.concat(F.lit("Here: "), F.to_json(parts)).alias("response"))
    return answers.sub_queries(rows).select("query_id.conv_id", "query_id.turn", F.col("sub_index").cast("long").alias("sub_index"), "sub_question")


@query("""
with r as (select doc_id, case when lang = 'en' then 'shown' else trim(text, ' ') end as answer, doc_id % 4 as k from documents)
select doc_id, md5(answer) as answer_md5, k = 0 as abstains, k <> 2 as benchmark, case when k = 1 then 2 else 0 end as n_listed from r where length(trim(answer)) > 0""")
def answer_forms(t: Tables) -> DataFrame:
    """Tagged answers, abstentions by both lists and list items."""
    k = F.col("doc_id") % 4
    said = F.when(F.col("lang") == "en", F.concat(F.lit("x <answer> shown </answer> "), "text")).otherwise(F.col("text"))
    phrase = F.when(k == 0, "There is NO DATA on it.").when(k == 1, "- one\n2. two\nno evidence").when(k == 2, "Unable to say; insufficient sleep.").otherwise("It is not possible to tell.")
    rows = filters.not_blank(t.documents.withColumn("answer", parsing.answer_part(said)), "answer")
    return rows.select("doc_id", F.md5(F.col("answer").cast("binary")).alias("answer_md5"), (parsing.abstains(phrase) & (k == 0)).alias("abstains"), parsing.abstains(phrase, parsing.BENCHMARK_ABSTENTIONS).alias("benchmark"), F.size(parsing.listed(phrase)).cast("long").alias("n_listed"))


@query("""
with c as (select o_orderkey, l_linenumber, l_quantity > 10 as supported, 1 - l_discount as confidence, l_linenumber <= 2 as material from orders join lineitem on l_orderkey = o_orderkey)
select o_orderkey, bool_and(supported and confidence >= 0.95) as done from c where material group by 1""")
def early_exits(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("query_id"), F.when(F.col("l_quantity") > 10, "SUPPORTED").otherwise("PARTIAL").alias("verdict"), (1 - F.col("l_discount")).alias("confidence"), F.when(F.col("l_linenumber") <= 2, "material").otherwise("contextual").alias("claim_type"))
    return debate.early_exit(rows).select(F.col("query_id").alias("o_orderkey"), "done")


@query("""
select count(*) as claims, count(*) filter (l_quantity > 30) as supported, count(*) filter (l_quantity <= 30) as flagged, round(avg((l_quantity <= 30)::int), 6) as flagged_share, round(avg(1 - l_discount), 6) as confidence from lineitem""")
def debate_totals(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.when(F.col("l_quantity") > 30, "SUPPORTED").when(F.col("l_quantity") > 15, "PARTIAL").otherwise("NOT_SUPPORTED").alias("verdict"), (1 - F.col("l_discount")).alias("confidence"))
    return debate.debate_summary(rows).select("claims", "supported", "flagged", r6("flagged_share").alias("flagged_share"), r6("confidence").alias("confidence"))


@query("""
select o_orderpriority as type, count(*) as n, round(avg(case when total > 0 then round(bad / total, 4) else 0 end), 6) as rate from (
  select o_orderkey, any_value(o_orderpriority) as o_orderpriority, count(*) as total, count(*) filter (l_returnflag = 'R') as bad from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'F' group by 1) group by 1""")
def safety_rates(t: Tables) -> DataFrame:
    counts = t.lineitem.groupBy(F.col("l_orderkey").alias("query_id")).agg(F.count("*").alias("total_answer"), F.count_if(F.col("l_returnflag") == "R").alias("hallucinated"))
    rows = counts.join(t.orders, F.col("query_id") == F.col("o_orderkey")).select("query_id", "total_answer", "hallucinated", "o_orderstatus", "o_orderpriority")
    got = scoring.safety_errors(rows, F.col("o_orderstatus") == "F").join(t.orders, F.col("query_id") == F.col("o_orderkey"))
    return got.groupBy(F.col("o_orderpriority").alias("type")).agg(F.count("*").alias("n"), r6(F.avg("safety_error_rate")).alias("rate"))


@query("""
with r as (select o_orderkey % 8 as q, case when o_orderkey % 10 = 0 then 'failed' end as error, o_totalprice as ms, o_orderkey % 6 as score, o_orderstatus = 'F' as abstained, o_orderkey % 4 as n from orders)
select count(*) as n, count(error) as errors, round(avg(ms) filter (error is null)) as avg_latency_ms, round(avg(score) filter (error is null and score > 0), 2) as avg_quality, 0.0::double as avg_faithfulness,
  round(count(*) filter (q in (3, 7) and abstained) / count(*) filter (q in (3, 7)), 3) as abstention_accuracy, round(count(*) filter (error is null and n > 0) / count(*) filter (error is null), 3) as citation_coverage from r""")
def saved_run(t: Tables) -> DataFrame:
    """A saved run in two files, one without faithfulness."""
    id = F.col("o_orderkey")
    rows = t.orders.select(
        (id % 8).alias("query_index"), F.when(id % 10 == 0, "failed").alias("error"), F.col("o_totalprice").alias("latency_ms"), (id % 6).alias("judge_score"), F.lit("text").alias("answer_text"),
        (id % 4).alias("n_citations"), F.when(F.col("o_orderstatus") == "F", "abstained").otherwise("approved").alias("verdict"), (id % 2).alias("half"),
    )
    both = truth.union_results(rows.where("half = 0"), rows.where("half = 1").withColumn("faithfulness", F.lit(-1.0)))
    return truth.saved_run_summary(both, [3, 7]).select(F.col("count").alias("n"), "errors", "avg_latency_ms", "avg_quality", "avg_faithfulness", "abstention_accuracy", "citation_coverage")


@query("""
with e as (select event_id, event_type = 'click' as flagged, event_type = 'view' as unreadable, value > 50 as raised, event_id % 2 = 0 as bad, event_id % 10 / 10 as c from events)
select event_id, flagged or unreadable as eval_flag, case when unreadable then -0.3 when flagged = bad then 1.0 when bad then -1.0 else -0.5 end::double as pipeline, round(case when raised = bad then 1.0 when bad then -1.0 else -0.5 end + 0.1, 6)::double as challenge,
  round(case when unreadable then -0.5 else 2 * c * bad::int - c * c end, 6)::double + 0.0 as brier, case when bad then if(raised, 1.0, -0.5) else if(raised, -1.0, 0.5) end::double as training from e""")
def reward_variants(t: Tables) -> DataFrame:
    sure, bad = (F.col("event_id") % 10 / 10).cast("string"), F.col("event_id") % 2 == 0
    said = F.when(F.col("event_type") == "view", "cannot say").otherwise(F.concat(F.lit('{"verdict": "'), F.when(F.col("event_type") == "click", "PARTIAL").otherwise("supported"), F.lit('", "confidence": '), sure, F.lit("}")))
    raised = F.when(F.col("value") > 50, '[{"challenge_type": "dose"}]').otherwise("[]")
    brier, training = parsing.training_rewards(said, raised, bad.cast("double"), bad)
    return t.events.select("event_id", parsing.verifier_flags(said, True).alias("eval_flag"), parsing.pipeline_output_reward(said, bad, "verifier").alias("pipeline"), r6(parsing.challenge_output_reward(raised, bad)).alias("challenge"), (r6(brier) + 0.0).alias("brier"), training.alias("training"))


@query("""
with p as (select doc_id, text, lang from documents), k as (select *, md5(doc_id || '|' || 42) as key from p), r as (select *, row_number() over (order by key, doc_id) as n from k)
select doc_id, case when i = 0 then 'no ' || lang else text end as answer, case when i = 0 then 'REVISED' else 'APPROVED' end as chosen, case when i = 0 then 'APPROVED' else 'ABSTAINED' end as rejected from r, (values (0), (1)) v(i) where 2 * (n - 1) + i < 301""")
def critic_preferences(t: Tables) -> DataFrame:
    pairs = t.documents.select(F.col("doc_id").alias("pair_id"), F.array(F.lit("known")).alias("knowledge"), F.col("text").alias("ground_truth"), F.concat(F.lit("no "), "lang").alias("hallucinated"), F.lit("easy").alias("difficulty"), F.lit("dose").alias("category"))
    got = sampling.qa_preferences(pairs, 301)
    return got.select(F.col("pair_id").alias("doc_id"), "answer", parsing.json_field(F.col("chosen"), "verdict").alias("chosen"), parsing.json_field(F.col("rejected"), "verdict").alias("rejected"))


@query("""
select doc_id, case when quality = 1 and toxic = 0 then 'supported' when toxic = 1 then 'not_supported' else 'partial' end as expected_verdict, toxic = 1 as challenge, case when quality = 1 and toxic = 0 then 1.0 when toxic = 1 then 0.0 else 0.5 end::double as target from labels""")
def inference_targets(t: Tables) -> DataFrame:
    word = F.when(F.col("toxic") == 1, "Contradiction ").when(F.col("quality") == 1, "entailment").otherwise("neutral")
    rows = t.labels.select("doc_id", F.lit("p").alias("premise"), F.lit("h").alias("hypothesis"), word.alias("label"))
    return sampling.inference_trajectories(rows).select("doc_id", "expected_verdict", F.col("challenger_should_challenge").alias("challenge"), F.col("judge_target_score").alias("target"))


@query("""
with r as (select vec_id, label as query_id, row_number() over (partition by label order by vec_id) as rank, vec_id % 7 as score from embeddings)
select query_id, vec_id, rank from (select query_id, vec_id, row_number() over (partition by query_id order by case when score > 0 then score end desc nulls last, rank, vec_id) as rank from r where rank <= 50) where rank <= 15""")
def reranked(t: Tables) -> DataFrame:
    """The first 50 of each label put in order by a scorer, of which 15 stay."""
    from pyspark.sql import Window

    rows = t.embeddings.select(F.col("label").alias("query_id"), "vec_id", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("rank"), F.lit("?").alias("question"), (F.col("vec_id") % 7).cast("string").alias("text"))
    got = retrieval.rerank(rows, lambda question, text: F.nullif(text.cast("double"), F.lit(0.0)), chunk="vec_id")
    return got.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("""
with d as (select doc_id, 'Intro' || chr(10) || 'HPI:' || chr(10) || lang || chr(10) || 'Labs:' || chr(10) || source || chr(10) || 'Past medical history' || chr(10) || 'x' || doc_id as note, lang, source from documents)
select doc_id, section, body from (select doc_id, unnest(['other', 'history_present_illness', 'labs_results', 'past_medical_history']) as section, unnest(['Intro', lang, source, 'x' || doc_id]) as body from d)""")
def abbreviated_sections(t: Tables) -> DataFrame:
    note = F.concat_ws("\n", F.lit("Intro\nHPI:"), "lang", F.lit("Labs:"), "source", F.lit("Past medical history"), F.concat(F.lit("x"), F.col("doc_id").cast("string")))
    return chunking.sections(t.documents.select("doc_id", note.alias("text")), "doc_id").select("doc_id", "section", "body")
