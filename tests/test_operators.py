"""Operators on small frames with known answers."""

import base64
import gzip
import json

import pytest
from pyspark.sql import functions as F

from assayer.functions import codings, dates, parsing, text, units
from assayer.operators import answers, audit, chunking, citations, debate, metrics, records, retrieval, sampling, scoring, truth
from assayer.sources import records as sources
from assayer.streaming import events


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(x):
    return F.lit(x)


# -- functions ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("raw, want", [("“Hi”  there \n\n\n\n  x – ﬁne ", '"Hi" there\n\nx - fine'), ("", ""), (None, None)])
def test_clean(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(text.clean(F.col("t")).alias("x")).first().x == want


@pytest.mark.parametrize("raw, want", [
    ("2024-01-15T10:30:00+00:00", "2024-01-15 10:30:00"), ("2024-01-15T10:30:00.123Z", "2024-01-15 10:30:00"), ("2024-01-15 10:30:00", "2024-01-15 10:30:00"), ("2024-01-15", "2024-01-15 00:00:00"),
    ("01/15/2024 08:09", "2024-01-15 08:09:00"), ("1/5/2024", "2024-01-05 00:00:00"), ("25/12/2024", "2024-12-25 00:00:00"), ("12-Jan-2024", "2024-01-12 00:00:00"), ("12 JAN 2024", "2024-01-12 00:00:00"),
    ("January 12, 2024", "2024-01-12 00:00:00"), ("20240112", "2024-01-12 00:00:00"), ("20240112143000", "2024-01-12 14:30:00"), ("soon", None), ("  ", None), ("13/32/2024", None),
])
def test_record_dates(spark, raw, want):
    got = value(spark, dates.record_date(lit(raw)))
    assert (str(got) if got else None) == want


@pytest.mark.parametrize("raw, want", [("2024/01/15", "2024-01-15"), ("1/15/24", "2024-01-15"), ("1-15-70", "1970-01-15"), ("15 January 2024", "2024-01-15"), ("Mar 2024", "2024-03-01"), ("march 2024", "2024-03-01"), ("Smarch 2024", None)])
def test_note_dates(spark, raw, want):
    got = value(spark, dates.note_date(lit(raw)))
    assert (str(got)[:10] if got else None) == want


def test_dates_of_a_text(spark):
    said = "Seen 2024-03-01, on 3/5/2024 and January 9, 2023; again Jan 9 2023. Not 2024-13-01."
    assert [str(d) for d in value(spark, dates.extract(lit(said)))] == ["2023-01-09", "2024-03-01", "2024-03-05"]
    assert value(spark, dates.temporal_issues(lit("On 2024-03-02."), F.array(lit("2024-03-01").cast("date")))) == ["Date 2024-03-02 in answer not found in evidence"]


def test_days_between_depends_on_order_for_parts_of_days(spark):
    a, b = lit("2024-01-02 12:00:00").cast("timestamp"), lit("2024-01-01 00:00:00").cast("timestamp")
    assert value(spark, dates.days_between(a, b)) == 1 and value(spark, dates.days_between(b, a)) == 2


def test_units(spark):
    rows = [(1.0, "kg", "lb"), (98.6, "degF", "degC"), (5.0, "mg/dL", "mmol/L"), (3.0, "cubits", "m"), (2.0, " Hours", "min")]
    got = [r.converted for r in units.convert(spark.createDataFrame(rows, "v double, u string, t string"), "v", "u", "t").collect()]
    assert got[0] == pytest.approx(2.20462, abs=1e-5) and got[1] == pytest.approx(37.0) and got[2] is None and got[3] is None and got[4] == pytest.approx(120)
    assert value(spark, units.spell(lit("Glucose 90 MG/DL, 36 deg C, 12 breaths / minute"))) == "Glucose 90 mg/dL, 36 Cel, 12 breaths/min"


def test_codings(spark):
    concept = "struct<coding: array<struct<system: string, code: string, display: string>>, text: string>"
    rows = [({"coding": [{"system": "s", "code": "c", "display": "d"}], "text": "t"},), ({"coding": [], "text": "t"},), ({"coding": None, "text": None},)]
    df = spark.createDataFrame(rows, f"c {concept}")
    assert [r.x and r.x.display for r in df.select(codings.first_coding(F.col("c")).alias("x")).collect()] == ["d", "t", None]
    assert [value(spark, codings.reference_id(lit(x))) for x in ("urn:uuid:ab", "Patient/7/x", "raw", None)] == ["ab", "7/x", "raw", None]
    assert [value(spark, codings.prefixed_id(lit(x), "Patient")) for x in ("Patient/7", "Encounter/7")] == ["7", None]
    assert [value(spark, codings.note_type(lit(x))) for x in ("Discharge lab", "Chest imaging", "Pathology", "Lab", "Visit")] == ["discharge_summary", "radiology_report", "pathology_report", "lab_report", "clinical_note"]
    notes = spark.createDataFrame([([{"data": base64.b64encode(b"first").decode()}, {"data": base64.b64encode(b"last").decode()}, {"data": "%%"}],), ([{"data": None}],)], "a array<struct<data: string>>")
    assert [r.x for r in notes.select(codings.note_text(F.col("a")).alias("x")).collect()] == ["last", None]


@pytest.mark.parametrize("a, b, want", [("Type 2 diabetes mellitus", "diabetes mellitus", True), ("HTN", "hypertension", True), ("asthma", "gout", False), ("acute renal failure syndrome", "renal failure", True), ("heart block", "heart failure", True)])
def test_entity_matches(spark, a, b, want):
    assert value(spark, text.entity_matches(lit(a), lit(b))) is want


def test_entities_of_an_answer(spark):
    said = "Findings:\n1. Hypertension [1]\n2) Asthma (active)\n- Gout: \n- ok\nThe patient has several problems, including obesity, sleep apnea and anemia.\nBlood pressure: high\nNote: none\n3. hypertension"
    got = value(spark, text.extract_entities(lit(said)))
    assert got[:3] == ["Hypertension", "Asthma", "Gout"] and "obesity" in got and "Blood pressure" in got and "Note" not in got and got.count("hypertension") == 0


def test_entity_tests(spark):
    assert value(spark, text.entity_in_text(lit("CKD"), lit("Chronic kidney disease, stage 3"))) is True
    assert value(spark, text.entity_in_text(lit("gout"), lit("Chronic kidney disease"))) is False
    assert value(spark, text.entity_mentioned(lit("unspecified asthma"), lit("asthmatic child"))) is True
    assert value(spark, text.is_numeric_entity(lit("HCT 38.0 %"))) is True and value(spark, text.is_numeric_entity(lit("Asthma"))) is False
    assert value(spark, text.is_descriptive(lit("pressure decreased overnight"))) is True


def test_parsing(spark):
    assert value(spark, parsing.enum_value(lit("this is temporal_numeric"))) == "temporal" and value(spark, parsing.enum_value(lit(" Temporal_Numeric "))) == "temporal_numeric" and value(spark, parsing.enum_value(lit("?"))) == "unknown"
    assert value(spark, parsing.number(lit("about -1.7"))) == -1.7 and value(spark, parsing.number(lit("none"))) is None and value(spark, parsing.clipped(parsing.number(lit("7")))) == 1.0 and value(spark, parsing.clipped(parsing.number(lit("?")), 0.5)) == 0.5
    assert value(spark, parsing.between_tags(lit("a <answer> b\nc </answer>"), "answer")) == "b\nc" and value(spark, parsing.answer_part(lit(" plain "))) == "plain"
    assert value(spark, parsing.cited_indexes(lit("x [2] y [1][2]"))) == [2, 1]
    assert value(spark, parsing.json_field(lit('so: {"verdict": "REVISE", "n": {"a": 1}} ok'), "verdict")) == "REVISE" and value(spark, parsing.json_field(lit("no"), "verdict")) is None
    assert value(spark, parsing.verdict(lit("APPROVE"))) == "approved" and value(spark, parsing.verdict(lit("x"), "unknown")) == "unknown"
    assert [value(spark, parsing.judge_score(lit(x))) for x in ("4 good", "9", "0", "bad", "")] == [4, 5, 1, 0, 0]
    assert value(spark, parsing.abstains(lit("We cannot determine this."))) is True and value(spark, parsing.abstains(lit("He was unable to walk, insufficient sleep."))) is False
    assert value(spark, parsing.abstains(lit("not possible here"))) is True and value(spark, parsing.abstains(lit("not possible here"), parsing.BENCHMARK_ABSTENTIONS)) is False
    assert value(spark, parsing.listed(lit("Intro\n- a \n* b\n1. c\n2) d\n-e\n+  \n"))) == ["a", "b", "c", "d"]
    field = lambda t: value(spark, parsing.json_field(lit(t), "v"))
    assert [field(t) for t in ('x {"v": "a"} y {"v": "b"}', 'x ```json\n{"v": "f"}\n``` {"v": "b"}', '```\nno\n``` {"v": {"w": 1}} z', '[1]', '{"v": 1', ' {"v": "whole"} ')] == ["a", "f", '{"w":1}', None, None, "whole"]


def test_rewards_of_outputs(spark):
    said = lambda v: lit('{"verdict": "%s", "confidence": 0.8}' % v)
    yes, no, raised = lit(True), lit(False), lit('[{"challenge_type": "x"}]')
    get = lambda *cs: [value(spark, c) for c in cs]
    assert get(parsing.verifier_flags(lit("?")), parsing.verifier_flags(lit("?"), True), parsing.critic_flags(lit("?")), parsing.critic_flags(said("APPROVED")), parsing.critic_flags(said("REVISED"))) == [False, True, True, False, True]
    assert get(parsing.challenge_output_reward(raised, yes), parsing.challenge_output_reward(raised, no), parsing.challenge_output_reward(lit("hm"), no)) == pytest.approx([1.1, -0.4, 0.9])
    assert get(parsing.pipeline_output_reward(said("insufficient"), yes, "triage"), parsing.pipeline_output_reward(lit("?"), yes, "verifier"), parsing.pipeline_output_reward(raised, no, "challenger")) == [1.0, -0.3, -0.5]
    assert get(*parsing.training_rewards(said("x"), raised, lit(1.0), no)) == pytest.approx([0.96, -1.0]) and get(*parsing.training_rewards(lit("?"), lit("[]"), lit(1.0), yes)) == [-0.5, -0.5]


def test_rewards(spark):
    out = '{"verdict": "NOT_SUPPORTED", "confidence": 0.2}'
    assert value(spark, parsing.detection_output_reward(lit(out), lit(True))) == pytest.approx(1.34) and value(spark, parsing.detection_output_reward(lit("?"), lit(True))) == -0.5
    assert value(spark, parsing.challenger_flags(lit('[{"challenge_type": "x"}]'))) is True and value(spark, parsing.challenger_flags(lit("[]"))) is False
    yes, no = lit(True), lit(False)
    assert [value(spark, c) for c in parsing.shared_rewards(yes, no, yes)] == pytest.approx([1.0, 1.2, 0.8])
    assert [value(spark, c) for c in parsing.shared_rewards(no, no, yes)] == pytest.approx([-1.3, -1.5, -1.5])
    assert [value(spark, c) for c in parsing.hybrid_rewards(yes, no, yes)] == pytest.approx([0.5 + 0.3 + 0.4, 0.5 - 0.3])
    assert [value(spark, parsing.trajectory_reward(a, b)) for a, b in ((yes, yes), (yes, no), (no, no))] == [1, 0, -1]
    assert value(spark, parsing.brier(lit(0.5), lit(1))) == 0.75 and value(spark, parsing.challenger_reward(lit(0.5), lit(-0.2))) == 1


# -- records -----------------------------------------------------------------------------------------------------------


def bundle():
    coded = lambda d, c="1": {"coding": [{"system": "s", "code": c, "display": d}]}
    own = {"subject": {"reference": "urn:uuid:p1"}, "encounter": {"reference": "urn:uuid:e1"}}
    return [
        {"resourceType": "Patient", "id": "p1", "name": [{"family": "Doe", "given": ["Jo"]}], "gender": "female", "birthDate": "1970-02-01"},
        {"resourceType": "Encounter", "id": "e1", **own, "type": [coded("Visit")], "period": {"start": "2024-01-15T09:00:00Z", "end": "2024-01-15T10:00:00Z"}, "reasonCode": [coded("Cough")]},
        {"resourceType": "Encounter", "id": "e2", **own, "class": [coded("x", "EMER")], "actualPeriod": {"start": "2024-03-01T09:00:00Z"}, "reason": [{"concept": coded("Fall")}], "participant": [{"individual": {}}, {"individual": {"display": "Dr. Roe"}}]},
        {"resourceType": "Condition", "id": "c1", **own, "code": coded("Asthma", "49"), "clinicalStatus": coded("x", "odd"), "onsetDateTime": "2020-05-05"},
        {"resourceType": "Condition", "id": "c2", **own},
        {"resourceType": "Observation", "id": "o1", **own, "code": coded("Creatinine"), "valueQuantity": {"value": 1.2, "unit": "mg/dL"}, "referenceRange": [{"low": {"value": 0.6}, "high": {"value": 1.1}}], "effectiveDateTime": "2024-01-15T09:30:00Z"},
        {"resourceType": "Observation", "id": "o2", **own, "code": coded("Pressure"), "component": [{"code": coded("Systolic"), "valueQuantity": {"value": 120, "unit": "mmHg"}}, {"code": coded("Diastolic"), "valueQuantity": {"value": 80.5, "code": "mm"}}, {"code": coded("None")}]},
        {"resourceType": "MedicationRequest", "id": "m1", **own, "medicationCodeableConcept": coded("Aspirin"), "dosageInstruction": [{"text": "daily"}]},
        {"resourceType": "MedicationRequest", "id": "m2", **own, "medicationReference": {"reference": "Medication/9"}},
        {"resourceType": "MedicationRequest", "id": "m3", **own, "medicationReference": {"reference": "Medication/8"}},
        {"resourceType": "MedicationRequest", "id": "m4", **own, "medication": {"concept": coded("Metformin hydrochloride 500 MG Oral Tablet")}, "dosageInstruction": [{"doseAndRate": [{"doseQuantity": {"value": 2.5, "unit": "mg"}}]}]},
    ]


def test_bundles_and_resources(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"resourceType": "Bundle", "entry": [{"resource": r} for r in bundle()]}))
    (tmp_path / "none.json").write_text(json.dumps({"resourceType": "Bundle", "entry": [{"resource": bundle()[1]}]}))
    held = sources.read_bundles(spark, str(tmp_path / "*.json")).select("resource.*")
    assert held.count() == 11
    with gzip.open(tmp_path / "r.ndjson.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, bundle())))
    lines = sources.read_resources(spark, [str(tmp_path / "r.ndjson.gz"), str(tmp_path / "missing.ndjson.gz")])
    for df in (held, lines):
        assert [tuple(r)[:3] for r in sources.patients(df).collect()] == [("p1", "Doe", "female")]
        encounters = {r.encounter_id: r for r in records.encounters(df).collect()}
        assert str(encounters["e1"].start) == "2024-01-15 09:00:00" and encounters["e1"].reasons == ["Cough"] and str(encounters["e2"].start)[:7] == "2024-03"
        assert [(r.display, r.status) for r in records.conditions(df).collect()] == [("Asthma", "active")]
        shown = {r.display: (r.shown, r.low, r.high) for r in records.observations(df).collect()}
        assert shown == {"Creatinine": ("1.2 mg/dL", 0.6, 1.1), "Pressure": ("N/A", None, None)}
        lookup = spark.createDataFrame([("9", "Metformin")], "id string, name string")
        assert sorted(r.name for r in records.medications(df, lookup).collect()) == ["Aspirin", "Metformin", "Metformin hydrochloride 500 MG Oral Tablet", "Unknown medication"]
        assert {(r.name, r.dosage, r.status) for r in records.medications(df).collect()} == {("Aspirin", "daily", "active"), ("Metformin hydrochloride 500 MG Oral Tablet", "2.5 mg", "active")}
        assert [(encounters[e]["class"], encounters[e].provider) for e in ("e1", "e2")] == [("other", None), ("emergency", "Dr. Roe")] and encounters["e2"].reasons == ["Fall"]
        assert {r.display: r.parts for r in records.observations(df).collect()} == {"Creatinine": None, "Pressure": "Systolic: 120 mmHg, Diastolic: 80.5 mm"}
    assert {r.patient_id for r in sources.read_bundles(spark, str(tmp_path / "b.json")).collect()} == {"p1"}
    with pytest.raises(ValueError):
        sources.read_bundles(spark, str(tmp_path / "*.json"), strict=True)


def test_documents_of_encounters(spark):
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(r) for r in bundle()]), schema=sources.RESOURCE)
    enc, obs, med, cond = records.encounters(df), records.observations(df), records.medications(df), records.conditions(df)
    line = lambda rows, section, order, c: rows.select("encounter_id", lit(section).alias("section"), order.alias("ordinal"), c.alias("line"))
    lines = line(cond, "ASSESSMENT_PLAN", F.col("condition_id"), records.condition_line(F.col("display"), F.col("code")))
    lines = lines.union(line(obs, "PHYSICAL_EXAM", F.col("observation_id"), records.vital_line(F.col("display"), F.col("parts"), F.col("plain"))))
    lines = lines.union(line(obs, "LABS", F.col("observation_id"), records.lab_line(F.col("display"), F.col("plain"), F.col("effectiveDateTime"))))
    lines = lines.union(line(med, "MEDICATIONS", F.col("id"), records.medication_line(F.col("name"), F.col("dosage"), F.col("status"))))
    got = {r.encounter_id: r for r in records.encounter_documents(enc, lines).collect()}
    assert got["e1"].text == (
        "Other Encounter on 2024-01-15 09:00\n\nType: Visit\nStart: 2024-01-15 09:00\nEnd: 2024-01-15 10:00\n\nDiagnoses (1):\n- Asthma [49]\n\nLaboratory Results (1):\n- Creatinine: 1.2 mg/dL (2024-01-15)\n\n"
        "Vital Signs (2):\n- Creatinine: 1.2 mg/dL\n- Pressure: Systolic: 120 mmHg, Diastolic: 80.5 mm\n\nMedications (2):\n- Aspirin (daily) [active]\n- Metformin hydrochloride 500 MG Oral Tablet (2.5 mg) [active]\n"
    )
    assert got["e2"].text == "Emergency Encounter on 2024-03-01 09:00\n\nStart: 2024-03-01 09:00\n\n" and got["e2"].title == "Emergency Encounter on 2024-03-01 09:00"
    short = cond.select("encounter_id", lit("Conditions").alias("section"), lit(0).alias("ordinal"), F.concat(lit("- "), "display", lit(" ["), "status", lit("]")).alias("line"))
    told = {r.encounter_id: r.text for r in records.encounter_summaries(enc, short).collect()}
    assert told["e1"] == "Other Visit on 2024-01-15\n\nReason for visit: Cough\n\nConditions:\n- Asthma [active]" and told["e2"] == "Emergency Encounter on 2024-03-01 (Provider: Dr. Roe)\n\nReason for visit: Fall"
    labs = obs.select("patient_id", F.col("effectiveDateTime").alias("issued"), records.lab_line(F.col("display"), F.col("plain"), F.col("effectiveDateTime")).alias("line"))
    assert records.lab_summaries(labs).first().text == "Standalone Laboratory Results (1):\n- Creatinine: 1.2 mg/dL (2024-01-15)"


def test_saved_runs_keep_positions(spark, tmp_path):
    run = {"patient_results": [{"patient_id": "p", "rag_results": [{"query": "a", "error": "x"}, {"query": "b"}]}]}
    (tmp_path / "run.json").write_text(json.dumps(run))
    df = spark.read.schema("patient_results array<struct<patient_id: string, rag_results: array<struct<query: string, error: string>>>>").json(str(tmp_path))
    assert [(r.patient_id, r.query_index, r.result.query) for r in sources.flatten_runs(df).collect()] == [("p", 1, "b")]
    sources.append(df, str(tmp_path / "out"), "json")
    sources.append(df, str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_sections_and_chunks(spark):
    note = "Seen today.\nChief Complaint:\ncough\n\nMEDICATIONS\naspirin\nFamily history\nnone\nMedications\nmetformin"
    got = chunking.sections(spark.createDataFrame([(1, note), (2, "plain\nlines"), (3, None), (4, "")], "document_id long, text string"))
    rows = sorted((r.document_id, r.pos, r.section, r.body) for r in got.collect())
    assert rows == [(1, 0, "other", "Seen today."), (1, 1, "chief_complaint", "cough"), (1, 2, "medications", "aspirin\n\nmetformin"), (1, 3, "family_history", "none"), (2, 0, "other", "plain\nlines")]
    body = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(1, "p", "a", 0, body), (1, "p", "b", 1, "short"), (1, "p", "c", 2, "  ")], "document_id long, patient_id string, section string, pos int, body string")
    parts = chunking.chunks(docs, max_tokens=50, overlap=20, min_tokens=5).orderBy("chunk_index").collect()
    assert [p.chunk_index for p in parts] == list(range(len(parts))) and parts[-1].text == "short" and {p.total_chunks for p in parts} == {len(parts)}
    assert parts[1].text.split()[0] == f"w{int(50 / 1.3) - int(20 / 1.3)}" and len({p.chunk_id for p in parts}) == len(parts)
    assert chunking.chunks(docs, max_tokens=50, overlap=128, min_tokens=1).count() >= 100


def test_patients_are_isolated_in_retrieval(spark):
    chunks = spark.createDataFrame([(f"{p}{i}", p, [1.0, float(i), 0.0], f"word{i} common") for p in "ab" for i in range(3)], "chunk_id string, patient_id string, embedding array<double>, text string")
    asked = spark.createDataFrame([("q", "a", [1.0, 0.0, 0.0], "common word2 absent")], "query_id string, patient_id string, embedding array<double>, text string")
    dense = retrieval.dense_top_k(asked, chunks, ["patient_id"], 2).orderBy("rank").collect()
    assert [r.chunk_id for r in dense] == ["a0", "a1"]
    sparse = retrieval.bm25(asked, chunks, ["patient_id"], 5, keep_zero=True).orderBy("rank").collect()
    assert [r.chunk_id for r in sparse] == ["a2", "a0", "a1"] and sparse[1].score == sparse[2].score > 0
    fused = retrieval.fuse([retrieval.dense_top_k(asked, chunks, ["patient_id"], 2), retrieval.bm25(asked, chunks, ["patient_id"], 5)]).orderBy("rank").collect()
    assert [r.chunk_id for r in fused] == ["a0", "a2", "a1"] or [r.chunk_id for r in fused] == ["a0", "a1", "a2"]


def test_audit(spark):
    rows = [(s, i, f"d{i}") for s in ("x", "y") for i in range(5)]
    chain = audit.build_chain(spark.createDataFrame(rows, "s string, i long, data string"), "s", "i", "data")
    good = {r.s: r for r in audit.verify_chain(chain, "s", "i", "data").collect()}
    assert all(r.valid and r.entries == 5 and r.first_bad is None for r in good.values())
    broken = chain.withColumn("previous_hash", F.when((F.col("s") == "x") & (F.col("i") == 0), "z").otherwise(F.col("previous_hash")))
    assert {r.s: r.first_bad for r in audit.verify_chain(broken, "s", "i", "data").collect()} == {"x": 0, "y": None}
    kept = audit.provenance(chain, "s", "i", (F.col("s") == "x") & (F.col("i") == 2)).groupBy("s").count().collect()
    assert {r.s: r["count"] for r in kept} == {"x": 3, "y": 5}


# -- answers -----------------------------------------------------------------------------------------------------------


def test_entity_verifier(spark):
    said = "1. Hypertension\n2. Lupus nephritis\n3. Asthma\nsee HCT 38 %"
    answer = spark.createDataFrame([(1, said), (2, "Nothing listed."), (3, "1. Gout\n2. Asthma")], "query_id long, answer string")
    evidence = spark.createDataFrame([(1, "Long standing HTN and asthma"), (1, "hypertension controlled"), (2, "x")], "query_id long, text string")
    got = {r.query_id: r for r in answers.verify_entities(answer, evidence).collect()}
    assert got[1].cleaned == "1. Hypertension\n2. Asthma\nsee HCT 38 %" and got[1].removed == ["Lupus nephritis"] and got[1].grounded[:2] == ["Hypertension", "Asthma"]
    assert got[2].cleaned == "Nothing listed." and got[2].removed == [] and got[3].cleaned == "" and len(got[3].removed) == 2


def test_model_shells(spark):
    rules = spark.createDataFrame([(2, "triage", '{"query_type": "summary", "confidence": 0.8}'), (1, "labs", '{"query_type": "numeric"}')], "priority int, keyword string, response string")
    asked = spark.createDataFrame([(1, "Triage: labs", "q1"), (2, "TRIAGE", "q2"), (3, "other", "q3")], "query_id long, prompt string, question string")
    routed = answers.route(answers.mock_model(asked, rules, "?")).orderBy("query_id").collect()
    assert [(r.query_type, r.router_confidence) for r in routed] == [("numeric", 0.0), ("summary", 0.8), ("unknown", 0.0)]
    listed = answers.route(answers.mock_model(asked, rules, "?")).withColumn("response", F.lit('["a", "b"]'))
    assert sorted((r.query_id, r.sub_index, r.sub_question) for r in answers.sub_queries(listed).collect()) == [(1, 0, "q1"), (2, 0, "a"), (2, 1, "b"), (3, 0, "q3")]
    chunks = spark.createDataFrame([(1, 1, "c1"), (1, 2, "c2")], "query_id long, rank int, chunk_id string")
    cited = answers.cited_chunks(spark.createDataFrame([(1, "x [2] y [9] z [1] [2]")], "query_id long, answer string"), chunks)
    assert [r.chunk_id for r in cited.orderBy("n").collect()] == ["c2", "c1"]
    critics = spark.createDataFrame([(1, "a", 0, '{"verdict": "REVISE", "revised_text": "b"}'), (2, "a", 2, '{"verdict": "REVISE"}'), (3, "a", 0, "nonsense")], "query_id long, answer string, attempt int, response string")
    done = answers.finish(critics).orderBy("query_id").collect()
    assert [(r.verdict, r.final, r.again) for r in done] == [("revised", "b", True), ("revised", "a", False), ("abstained", "Insufficient evidence.", False)]


def test_temporal_check(spark):
    answer = spark.createDataFrame([(1, "Seen 2024-01-01 and 2024-02-02."), (2, "No dates."), (3, "On 2024-05-05.")], "query_id long, answer string")
    chunks = spark.createDataFrame([(1, "visit 1/1/2024", "2024-02-02 10:00:00"), (3, "none", None)], "query_id long, text string, d string").withColumn("encounter_date", F.col("d").cast("timestamp"))
    got = {r.query_id: (len(r.issues), r.valid) for r in answers.temporal_check(answer, chunks).collect()}
    assert got == {1: (0, True), 2: (0, True), 3: (1, False)}


def test_citations(spark):
    answer = spark.createDataFrame([(1, "The creatinine level rose to two in March. Overall. Nothing in the record supports this other remark.")], "query_id long, answer string")
    filler = "unrelated words about the weather " * 20
    chunks = spark.createDataFrame([(1, "c1", 1, filler), (1, "c2", 2, filler + "the creatinine level rose to two in march " + filler)], "query_id long, chunk_id string, rank int, text string")
    found = citations.cite(answer, chunks).collect()
    assert [(r.citation_id, r.sentence_at, r.chunk_id) for r in found] == [(1, 0, "c2")] and "creatinine" in found[0].span and found[0].confidence == round(39 / 42, 4)  # T, M and the dot differ
    assert [r.confidence for r in citations.cite(answer, chunks, lexical=citations.word_overlap).collect()] == [1.0]
    cited = citations.cite(answer, chunks)
    assert citations.marked_answers(answer, cited).first().marked.startswith("The creatinine level rose to two in March.[1] Overall.")
    refs = citations.references(cited.withColumn("source", F.lit("Lab"))).first().refs.split("\n")
    assert refs[0] == "References" and refs[2].startswith('[1] Source: Lab | "') and refs[2].endswith('..."')
    assert citations.evidence_pack(cited).first().chunk_map[1].chunk_id == "c2"
    assert value(spark, citations.partial_ratio(lit("creatinine rose"), lit("the creatinine rose again"))) == pytest.approx(100)
    assert value(spark, citations.dual_score(lit(60.0), lit(1.4))) == 80


def test_debate(spark):
    said = spark.createDataFrame([(1, "1. first claim\n2. second claim\n   goes on"), (2, "- a\n- b"), (3, "just one")], "query_id long, answer string")
    got = sorted((r.query_id, r.claim_id, r.claim) for r in debate.split_claims(said).collect())
    assert [(q, c) for q, c, _ in got] == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)] and got[0][2] == "first claim" and got[4][2] == "just one"
    long = ". ".join("sentence number %d with words" % i for i in range(60)) + "."
    packed = value(spark, debate.pack(lit(long), 200))
    assert len(packed) > 5 and max(map(len, packed)) <= 200 and " ".join(packed) == long
    claims = spark.createDataFrame([(1, 1, "material"), (1, 2, "contextual"), (2, 1, "material"), (3, 1, "contextual")], "query_id long, claim_id long, claim_type string")
    verdicts = spark.createDataFrame([(1, 1, "SUPPORTED", 1.5), (9, 9, "SUPPORTED", 1.0)], "query_id long, claim_id long, verdict string, confidence double")
    checked = debate.verified(claims, verdicts)
    assert sorted((r.query_id, r.claim_id, r.verdict, r.confidence) for r in checked.collect()) == [(1, 1, "SUPPORTED", 1.0), (1, 2, "PARTIAL", 0.5), (2, 1, "PARTIAL", 0.5), (3, 1, "PARTIAL", 0.5)]
    assert {r.query_id: r.done for r in debate.early_exit(checked).collect()} == {1: True, 2: False} and debate.to_challenge(checked).count() == 1
    scores = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0), (2, 1, 0.0), (3, 1, 0.4)], "query_id long, claim_id long, score double")
    signals = spark.createDataFrame([(3, i, f"s{i}") for i in range(7)], "query_id long, at int, signal string")
    routes = {r.query_id: (r.route, round(r.aggregate, 4), r.corrections) for r in debate.routed(claims, scores, signals).collect()}
    assert routes == {1: ("approved", 1.0, None), 2: ("abstained", 0.3, None), 3: ("revised", 0.82, "[Corrections needed: s0; s1; s2; s3; s4]")}


def test_scores(spark):
    answer = spark.createDataFrame([(1, "1. Hypertension\n2. Lupus"), (2, "nothing"), (3, "x")], "query_id long, answer string")
    truth = spark.createDataFrame([(1, "HTN", "Essential hypertension", "I10"), (1, "Asthma", None, None), (2, "Gout", None, None)], "query_id long, entity string, name string, code string")
    got = {r.query_id: r for r in scoring.entity_scores(answer, truth).collect()}
    assert (got[1].found, got[1].total_gt, got[1].hallucinated, got[1].precision, got[1].recall, got[1].f1) == (1, 2, 1, 0.5, 0.5, 0.5) and got[2].f1 == 0 and got[3].precision == 0
    evidence = spark.createDataFrame([(1, "essential hypertension"), (1, "weather"), (2, "none")], "query_id long, text string")
    ground = {r.query_id: (r.context_precision, r.context_recall) for r in scoring.grounding(evidence, truth).collect()}
    assert ground == {1: (0.5, 0.5), 2: (0.0, 0.0)}
    said = spark.createDataFrame([(1, "gout", "has gout"), (1, "", "x"), (1, "asthma", "")], "query_id long, claim string, evidence string")
    assert scoring.citation_accuracy(said).first().citation_accuracy == 0.3333
    pairs = spark.createDataFrame([("The cat sat.", "the cat was sat"), ("", "x"), (None, "x"), ("a b c", "a b c")], "a string, b string")
    assert [r.x for r in pairs.select(scoring.rouge_l(F.col("a"), F.col("b")).alias("x")).collect()] == [0.8571, 0.0, 0.0, 1.0]


def test_roll_up(spark):
    row = "model string, abstained boolean, precision double, recall double, f1 double, hallucination_rate double, rouge_l double, semantic_sim double, context_precision double, context_recall double, citation_accuracy double, safety_error_rate double, latency_ms double"
    rows = [("m", None, 1.0, 0.5, 0.6, 0.0, 0.0, -1.0, 1.0, 1.0, 1.0, None, 10.0), ("m", None, 0.5, 0.5, 0.4, 0.2, 0.4, 0.8, 0.0, 0.0, 0.0, 0.5, 0.0), ("m", True, *[None] * 10, 30.0), ("m", False, *[None] * 11)]
    rolled = scoring.roll_up(spark.createDataFrame(rows, row))
    r = rolled.first()
    assert (r.n, r.answerable, r.precision, r.rouge_l, r.semantic_sim, r.abstention_accuracy, r.latency_ms, r.safety_error_rate) == (4, 2, 0.75, 0.4, 0.8, 0.5, 20.0, 0.5)
    assert scoring.axes(rolled).first().factuality == 0.825
    deltas = scoring.configurations([("base", rolled), ("tuned", rolled.withColumn("f1", F.col("f1") + 1))], ["f1"]).orderBy("ordinal").collect()
    assert [(d.configuration, round(d.f1, 4)) for d in deltas] == [("base", 0.5), ("tuned", 1.5), ("delta", 1.0)]


def test_metrics_without_rows_or_hits(spark):
    none = spark.createDataFrame([], "f boolean, t boolean")
    r = metrics.confusion(none, F.col("f"), F.col("t")).first()
    assert (r.tp, r.precision, r.f1, r.accuracy) == (0, 0, 0, 0)
    ranked = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("b", 1, 1), ("c", 1, 0), ("c", 2, 1)], "q string, rank int, relevant int")
    got = {r.q: (r.recall, r.mrr, round(r.ndcg, 4)) for r in metrics.ranked_quality(ranked, "q", 2).collect()}
    assert got == {"a": (0, 0, 0), "b": (1, 1, 1), "c": (1, 0.5, 0.6309)}
    assert metrics.bootstrap(spark.createDataFrame([], "i long, v double"), "v", "i", 10).count() == 0


def test_training_pairs(spark):
    results = spark.createDataFrame([("p", i) for i in range(4)], "patient_id string, query_index int")
    truth = spark.createDataFrame([("p", 0, 0.0, 0.7), ("p", 1, 0.3, 0.2), ("p", 2, 0.05, 0.9)], "patient_id string, query_index int, hallucination_rate double, f1 double")
    assert sorted((r.query_index, r.chosen, r.rejected) for r in sampling.preference_pairs(results, truth).collect()) == [(0, "APPROVED", "ABSTAINED"), (1, "REVISED", "APPROVED")]
    qa = spark.createDataFrame([("q", "yes", "no")], "question string, ground_truth string, hallucinated string")
    assert sorted((r.answer, r.expected_verdict, r.challenger_should_challenge) for r in sampling.trajectories(qa).collect()) == [("no", "not_supported", True), ("yes", "supported", False)]


def test_windowed_counts_of_a_stream(spark, tmp_path):
    rows = spark.sql("select timestamp '2024-01-01 00:10:00' + make_interval(0, 0, 0, 0, 0, id * 20) as ts, if(id % 2 = 0, 'a', 'b') as event_type from range(12)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    running = events.windowed_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    running.awaitTermination(60)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(spark.table("counted")) == key(events.windowed_counts(rows))


def test_filters_and_truth(spark):
    from assayer.operators import filters, truth

    df = spark.createDataFrame([(1, "Serum Creatinine"), (2, " "), (3, None), (4, "Glucose")], "id long, text string")
    assert filters.not_blank(df).count() == 2 and [r.id for r in df.where(filters.named_like(F.col("text"))).collect()] == [1]
    asked = spark.createDataFrame([("a", True), ("z", True), (None, True), ("a", False)], "patient_id string, body_ok boolean")
    got = filters.scoped(asked, spark.createDataFrame([("a",), ("a",)], "patient_id string"))
    assert sorted(r.status for r in got.collect()) == [200, 400, 422, 422]
    good, bad = filters.indexable(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id long, embedding array<double>"), 2)
    assert [r.id for r in good.collect()] == [1] and bad.count() == 2
    enc = spark.createDataFrame([("p", 1, "2024-01-01"), ("p", 2, "2024-02-01"), ("q", 3, "2024-01-01")], "patient_id string, encounter_id long, start string")
    cond = spark.createDataFrame([("p", 1, "old", "1"), ("p", 2, "new", "2"), ("q", 9, "other", None), ("r", None, "lone", None)], "patient_id string, encounter_id long, display string, code string")
    recent = truth.recent_conditions(cond, enc)
    assert sorted((r.patient_id, r.entity) for r in recent.collect()) == [("p", "new"), ("q", "other"), ("r", "lone")]
    labs = spark.createDataFrame([("p", "BUN", 5, "mg", "2024-01-01", 0), ("p", "BUN", 7, "mg", "2024-01-01", 1), ("p", "Iron", None, "mg", "2024-01-01", 2)], "patient_id string, display string, value int, unit string, date string, pos int")
    assert sorted(r.entity for r in truth.lab_entities(labs).collect()) == ["BUN 5 mg", "Iron"] and truth.lab_entities(labs, kidney=True).count() == 2
    assert truth.all_entities(recent, truth.lab_entities(labs), recent).count() == 5
    runs = spark.createDataFrame([("m", None, 10, 1, "approved", 4, 0.5), ("m", None, 30, 0, "abstained", 0, -1.0), ("m", "x", 99, 0, None, 0, -1.0)], "model string, error string, latency_ms long, n_citations int, verdict string, judge_score int, faithfulness double")
    r = truth.run_stats(runs, "model").first()
    assert (r.n, r.errors, r.avg_latency_ms, r.median_latency_ms, r.abstention_rate, r.citation_coverage, r.quality, r.faithfulness) == (3, 1, 20, 30, 0.333, 0.5, 4, 0.5) and r.verdicts == {"approved": 1, "abstained": 1, "unknown": 1}
    assert [r.segment for r in filters.segments(spark.createDataFrame([(1, "abcdefg"), (2, "")], "id long, text string"), "id", size=3).orderBy("at").collect()] == ["abc", "def", "g"]


def test_entity_scores_of_all_orders(spark, tmp_path):
    from assayer.plans import queries

    names = ["crimson walnut", "silver harbour", "gentle meadow", "frozen lantern"]
    spark.createDataFrame([(i, n, f"KIND {i}") for i, n in enumerate(names)], "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    orders = {k: [(k + i) % 4 for i in range(1 + k % 4)] for k in range(1, 13)}
    spark.createDataFrame([(k, p) for k, ps in orders.items() for p in ps], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.query_id: (r.total_gt, r.found, r.total_answer, r.hallucinated, r.precision, r.recall) for r in queries.QUERIES["entity_scores"](spark, str(tmp_path)).collect()}
    said = {k: min(2, len(ps)) for k, ps in orders.items()}
    assert got == {k: (len(ps), said[k], said[k] + 1, 1, round(said[k] / (said[k] + 1), 4), round(said[k] / len(ps), 4)) for k, ps in orders.items()}


def test_forms_are_made_once_for_each_name_and_answer(spark):
    answer = spark.createDataFrame([(1, "1. HTN\n2. gout"), (2, None)], "query_id long, answer string")
    truth = spark.createDataFrame([(1, "hypertension", None, "I10"), (1, None, "acute gout", None), (2, "gout", None, None), (9, "gout", None, None)], "query_id long, entity string, name string, code string")
    got = scoring.entity_scores(answer, truth)
    assert sorted((r.query_id, r.total_gt, r.found, r.total_answer, r.hallucinated, r.f1) for r in got.collect()) == [(1, 2, 1, 2, 0, 0.6667), (2, 1, 0, 0, 0, 0.0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and plan.count("regexp_replace") < 80  # 2,000 before: the forms of both for each pair


def test_evidence_is_normalised_once_for_each_query(spark):
    said = spark.createDataFrame([(1, "1. HTN\n2. knee pain\n3. quixotic zephyr\n4. red moon rising high"), (2, "1. gout")], "query_id long, answer string")
    evidence = spark.createDataFrame([(1, 1, "Hypertension, knee"), (1, 2, "pain; red MOON"), (1, 3, None)], "query_id long, rank int, text string")
    got = answers.verify_entities(said, evidence)
    assert {r.query_id: (r.grounded, r.removed) for r in got.collect()} == {1: (["HTN", "knee pain", "red moon rising high"], ["quixotic zephyr"]), 2: ([], ["gout"])}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(all#" not in plan.split("Join LeftOuter", 1)[0] and "slow" not in plan


# -- what the last round missed -------------------------------------------------------------------------------------------


def test_abbreviated_headers_begin_sections(spark):
    note = "Preamble\nHPI:\nshort breath\nCC:\ncough\nPMH:\nasthma\nROS:\nnone\nLabs:\nfine\nA/P:\nrest\nHPI\nnot a header\nEXAM:\nclear"
    got = {r.section: r.body for r in chunking.sections(spark.createDataFrame([("d", note)], "document_id string, text string")).collect()}
    assert got == {"other": "Preamble", "history_present_illness": "short breath", "chief_complaint": "cough", "past_medical_history": "asthma", "review_of_systems": "none", "labs_results": "fine", "assessment_plan": "rest\nHPI\nnot a header", "physical_exam": "clear"}


def test_chains_with_null_hashes(spark):
    df = spark.createDataFrame([("s", i, f"d{i}") for i in range(4)] + [("t", 0, None)], "k string, seq long, data string")
    chain = audit.build_chain(df, "k", "seq", "data")
    assert all(r.valid for r in audit.verify_chain(chain, "k", "seq", "data").collect())
    forged = chain.withColumn("data", F.when(F.col("seq") == 3, "forged").otherwise(F.col("data"))).withColumn("entry_hash", F.when(F.col("seq") == 3, lit(None)).otherwise(F.col("entry_hash")))
    assert {r.k: (r.valid, r.first_bad) for r in audit.verify_chain(forged, "k", "seq", "data").collect()} == {"s": (False, 3), "t": (True, None)}
    lost = chain.withColumn("entry_hash", F.when(F.col("seq") == 1, lit(None)).otherwise(F.col("entry_hash")))
    assert {r.k: r.first_bad for r in audit.verify_chain(lost, "k", "seq", "data").collect()}["s"] == 1


def test_scorer_names(spark):
    assert value(spark, text.entity_matches(lit("T2DM"), lit("diabetes mellitus type 2"))) is True
    assert value(spark, text.entity_mentioned(lit("high blood pressure"), lit("She has hypertension."))) is True
    assert value(spark, text.entity_mentioned(lit("PNA"), lit("Treated for pneumonia."))) is True


def test_sufficiency_and_retry(spark):
    rows = [("a", '{"verdict": "insufficient", "coverage_score": 0.2, "missing_aspects": ["dose"], "reformulated_query": "dose of x"}'), ("b", "nonsense"), ("c", '{"verdict": "odd", "coverage_score": 0.9}')]
    told = answers.sufficiency(spark.createDataFrame([(q, "own", r) for q, r in rows], "query_id string, question string, response string"))
    assert {r.query_id: (r.retrieval_verdict, r.coverage, r.missing, r.reformulated) for r in told.collect()} == {"a": ("insufficient", 0.2, ["dose"], "dose of x"), "b": ("sufficient", 0.5, [], None), "c": ("sufficient", 0.9, [], None)}
    found = spark.createDataFrame([("a", "c1", 1), ("a", "c2", 2), ("b", "c1", 1)], "query_id string, chunk_id string, rank int")
    again = lambda asked: asked.select("query_id", F.explode(F.array(lit("c2"), F.col("text"))).alias("chunk_id")).withColumn("rank", F.length("chunk_id"))
    got = sorted((r.query_id, r.rank, r.chunk_id) for r in answers.retry(told, found, again).collect())
    assert got == [("a", 1, "c1"), ("a", 2, "c2"), ("a", 3, "dose of x"), ("b", 1, "c1")]


def test_numeric_check_and_critic_turns(spark):
    df = spark.createDataFrame([("a", '{"valid": true, "issues": [], "corrections": ["x"]}'), ("b", "?"), ("c", "{}")], "query_id string, response string")
    assert {r.query_id: (r.numeric_valid, len(r.numeric_issues), r.corrections) for r in answers.numeric_check(df).collect()} == {"a": (True, 0, ["x"]), "b": (False, 1, []), "c": (False, 0, [])}
    revise = lambda t: '{"verdict": "REVISED", "revised_text": "%s"}' % t
    rows = [("a", "A", '{"verdict": "APPROVED"}', revise("no"), ""), ("b", "B", revise("B1"), '{"verdict": "APPROVED"}', ""), ("c", "C", revise("C1"), revise("C2"), '{"verdict": "ABSTAINED", "abstention_reason": "why"}')]
    df = spark.createDataFrame(rows, "query_id string, answer string, r1 string, r2 string, r3 string")
    assert {r.query_id: (r.verdict, r.final, r.attempts) for r in answers.critic_turns(df, ["r1", "r2", "r3"]).collect()} == {"a": ("approved", "A", 1), "b": ("approved", "B1", 2), "c": ("abstained", "why", 3)}


def test_rerank_and_fills(spark):
    df = spark.createDataFrame([("q", f"c{i}", i, "x" * (i % 4)) for i in range(1, 9)], "query_id string, chunk_id string, rank int, text string").withColumn("question", lit("?"))
    got = retrieval.rerank(df, lambda q, t: F.length(t).cast("double"), first=6, final=3)
    assert sorted((r.rank, r.chunk_id) for r in got.collect()) == [(1, "c3"), (2, "c2"), (3, "c6")]
    assert sorted((r.rank, r.chunk_id) for r in retrieval.rerank(df, None, final=2).collect()) == [(1, "c1"), (2, "c2")]
    chunks = spark.createDataFrame([(i, "alpha beta" if i == 5 else "gamma") for i in range(9)], "chunk_id long, text string")
    asked = spark.createDataFrame([("q", "Alpha"), ("r", "none")], "query_id string, text string")
    got = {q: [r.chunk_id for r in retrieval.bm25(asked, chunks, [], 3, keep_zero=True).where(F.col("query_id") == q).orderBy("rank").collect()] for q in ("q", "r")}
    assert got == {"q": [5, 0, 1], "r": [0, 1, 2]}


def test_safety_summary_union_and_training_rows(spark):
    scores = spark.createDataFrame([("a", 4, 1), ("b", 0, 0), ("c", 2, 2)], "query_id string, total_answer long, hallucinated long")
    assert {r.query_id: r.safety_error_rate for r in scoring.safety_errors(scores, F.col("query_id") != "c").collect()} == {"a": 0.25, "b": 0.0}
    runs = spark.createDataFrame([(0, None, 100.0, 4, -1.0, "abc", 1, "approved"), (1, None, 301.0, 0, 0.5, "a", 0, "abstained"), (1, "x", None, None, None, None, None, None)], "query_index int, error string, latency_ms double, judge_score int, faithfulness double, answer_text string, n_citations int, verdict string")
    assert tuple(truth.saved_run_summary(runs, [1]).first()) == (3, 1, 201.0, 4.0, 0.5, 2.0, 0.5, 0.5)
    both = truth.union_results(scores, runs.select("query_index"))
    assert both.count() == 6 and set(both.columns) == {"query_id", "total_answer", "hallucinated", "query_index"}
    pairs = spark.createDataFrame([(i, ["k" * 900, "m"], "true", "false", None, "cat") for i in range(4)], "pair_id long, knowledge array<string>, ground_truth string, hallucinated string, difficulty string, category string")
    got = sampling.qa_preferences(pairs, 5).collect()
    assert len(got) == 5 and got[0].answer == "false" and json.loads(got[0].chosen)["revised_text"] == "true" and json.loads(got[1].rejected)["verdict"] == "ABSTAINED" and json.loads(got[1].chosen) == {"verdict": "APPROVED", "issues": [], "revised_text": None, "abstention_reason": None}
    assert got[0].source == "medhallu_medium" and got[0].evidence == "[1] " + "k" * 800 + "\n[2] m"
    nli = spark.createDataFrame([("p", "h", "Contradiction "), ("p", "h", "0"), ("p", "h", None), ("", "h", "neutral")], "premise string, hypothesis string, label string")
    assert [(r.expected_verdict, r.challenger_should_challenge, r.judge_target_score) for r in sampling.inference_trajectories(nli).collect()] == [("not_supported", True, 0.0), ("entailment", False, 1.0), ("partial", False, 0.5)]


def test_sections_are_made_where_the_note_is(spark):
    notes = ["Chief Complaint:\nx\n\nMedications\n a \nAllergies:\nMedications\nb\nLast Seen\nmore", "Plan:", "\n\n", "first\nHPI:\nHPI:\nlast", None]
    got = chunking.sections(spark.createDataFrame(list(enumerate(notes)), "document_id int, text string"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == [
        (0, 1, "chief_complaint", "x"), (0, 2, "medications", "a\n\nb\nLast Seen\nmore"), (3, 0, "other", "first"), (3, 2, "history_present_illness", "last"),
    ]


def test_header_patterns_are_tried_on_all_lines_that_match():
    import re

    lines = ["Chief  Complaint", "CC :", "Reason for Visit", "HPI:", "Medications on admission", "Allergies", "Drug allergies", "A / P :", "A&P:", "Labs :", "Laboratory Result", "Lab Results", "Vital Sign", "Physical Examination", "Imaging", "Procedures performed", "ROS:", "Exam:", "Plan:"]
    for _, pattern in chunking.HEADERS:
        assert all(chunking.certain(pattern) in line.lower() for line in lines if re.search(f"(?i){pattern}", line))
    wanted = {"a": r"a\s*/\s*p\s*:", "medication": r"medications?\s*(on\s+admission|at\s+home|list)?", "result": r"lab(oratory)?\s+results?"}
    assert all(chunking.certain(p) == k for k, p in wanted.items())


def test_recent_conditions_join_their_rows_once(spark):
    enc = spark.createDataFrame([(1, 10, 5), (1, 11, 5), (2, 20, 1), (None, 30, 1)], "patient_id int, encounter_id int, start int")
    cond = spark.createDataFrame([(1, 10, "a", None), (1, 10, "a", None), (1, 11, "b", "x"), (2, 19, "c", None), (2, 18, "c", None), (3, 1, None, None), (None, 30, "d", None)], "patient_id int, encounter_id int, display string, code string")
    got = truth.recent_conditions(cond, enc)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == ["(1, 'a', None)", "(2, 'c', None)", "(3, None, None)"]
