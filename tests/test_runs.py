"""Streams that go on, results that are replaced, debates in cycles, prompts from templates."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from assayer.functions import templates
from assayer.operators import audit, debate
from assayer.sources import results
from assayer.streaming import audit as stream

ENTRY = "session_id string, seq long, data string"


def test_a_chain_goes_on_after_a_stop(spark, tmp_path):
    rows = [(f"s{i % 3}", i, None if i % 7 == 0 else f"entry {i}") for i in range(60)]
    put = lambda some: spark.createDataFrame(some, ENTRY).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log, state = str(tmp_path / "log"), str(tmp_path / "state")

    def go():
        entries = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.write_chain(entries, log, state).awaitTermination()

    put(rows[:20])
    go()
    put(rows[15:40])  # five entries come again
    put([(None, 1, "nobody's"), ("s0", None, "no place")])
    go()
    last = max(Path(state, "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # as if it had stopped after the last batch was written: it runs again
    Path(state, "commits", f".{last.name}.crc").unlink(missing_ok=True)
    put(rows[40:])
    go()
    got = stream.read_chain(spark, log)
    want = audit.build_chain(spark.createDataFrame([*rows, (None, 1, "nobody's")], ENTRY), "session_id", "seq", "data")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert all(r.valid for r in audit.verify_chain(got, "session_id", "seq", "data").collect())


def test_reruns_replace_keys_at_once_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "results")
    with pytest.raises(Exception, match="no results"):
        results.read_results(spark, path, ["k"])
    df = lambda rows: spark.createDataFrame(rows, "k string, n long")
    held = lambda **at: sorted(map(tuple, results.read_results(spark, path, ["k"], **at).select("k", "n").collect()), key=str)
    results.replace_results(df([("a", 1), ("a", 2), ("b", 3), (None, 4)]), path, ["k"])
    results.replace_results(df([("a", 9), ("c", 5), (None, 6)]), path, ["k"])
    now = sorted([("a", 9), ("b", 3), ("c", 5), (None, 6)], key=str)
    assert held() == now and held(version=1) == sorted([("a", 1), ("a", 2), ("b", 3), (None, 4)], key=str)
    with pytest.raises(Exception):  # noqa: B017
        results.replace_results(df([("b", 1)]).withColumn("n", F.raise_error(F.lit("broken")).cast("long")), path, ["k"])
    assert held() == now
    shutil.copytree(f"{path}/manifest/v=2", f"{path}/manifest/v=3")
    Path(path, "manifest", "v=3", "_SUCCESS").unlink()  # a manifest that was not written to its end
    assert held() == now
    results.replace_results(df([]), str(tmp_path / "none"), ["k"])
    assert results.read_results(spark, str(tmp_path / "none"), ["k"]).count() == 0


def test_debates_end_query_by_query(spark):
    rows = [
        ("sure", 1, "material", "SUPPORTED", 0.99), ("sure", 2, "contextual", "PARTIAL", 0.2), ("once", 1, "material", "SUPPORTED", 0.9), ("twice", 1, "material", "SUPPORTED", 0.9),
        ("twice", 2, "contextual", "SUPPORTED", 0.8), ("calm", 1, "contextual", "SUPPORTED", 0.7), ("calm", 2, "material", "PARTIAL", 0.5),
    ]
    claims = spark.createDataFrame(rows, "query_id string, claim_id long, claim_type string, verdict string, confidence double")
    seen = []

    def challenger(supported, cycle):
        seen.append({r.query_id for r in supported.collect()})
        return supported.where((F.col("query_id") == "twice") | ((F.col("query_id") == "once") & (F.lit(cycle) == 1))).select("query_id", "claim_id", F.lit("omission").alias("kind"))

    def reviser(held, challenges, cycle):
        up = F.when(F.col("query_id") == "once", 1.7).when(F.col("claim_id") == 2, 0.4)
        word = F.when(F.col("query_id") == "once", "supported").when(F.col("claim_id") == 2, "Partial").otherwise("who knows")
        extra = spark.createDataFrame([("twice", 77, "partial", 0.1)], "query_id string, claim_id long, verdict string, confidence double")
        return held.select("query_id", "claim_id", word.alias("verdict"), up.alias("confidence")).union(extra)

    after, log, counts = debate.debated(claims, challenger, reviser)
    assert {(r.query_id, r.claim_id): (r.verdict, r.confidence) for r in after.collect()} == {
        ("sure", 1): ("SUPPORTED", 0.99), ("sure", 2): ("PARTIAL", 0.2), ("once", 1): ("SUPPORTED", 1.0), ("twice", 1): ("SUPPORTED", 0.9), ("twice", 2): ("PARTIAL", 0.4), ("calm", 1): ("SUPPORTED", 0.7), ("calm", 2): ("PARTIAL", 0.5),
    }
    assert {r.query_id: (r.cycles, r.challenges) for r in counts.collect()} == {"sure": (1, 0), "once": (2, 1), "twice": (2, 3), "calm": (1, 0)}
    assert {(r.query_id, r.claim_id, r.cycle, r.confidence_before, r.confidence_after) for r in log.collect()} == {("once", 1, 1, 0.9, 1.0), ("twice", 1, 1, 0.9, 0.9), ("twice", 2, 1, 0.8, 0.4), ("twice", 1, 2, 0.9, 0.9)}
    assert seen == [{"once", "twice", "calm"}, {"twice"}]
    none = debate.debated(claims.where("claim_id > 5"), challenger, reviser)
    assert [df.count() for df in none] == [0, 0, 0]


def test_templates(spark):
    text = "Hi {{ name }}!\n{% if items %}\n{% for x in items %}\n  {{ loop.index }}. {{ x.a }}{% if not x.b %} -{% else %} +{{ x.b }}{% endif %}\n\n{% endfor %}\n{% else %}\nnone\n{% endif %}\nend"
    rows = [(1, "Jo", [("p", "q"), ("r", None), (None, "")]), (2, None, []), (3, "", None)]
    df = spark.createDataFrame(rows, "i long, name string, items array<struct<a string, b string>>")
    got = {r.i: r.t for r in df.select("i", templates.render(text, name=F.col("name"), items=F.col("items")).alias("t")).collect()}
    assert got == {1: "Hi Jo!\n  1. p +q\n  2. r -\n  3.  -\nend", 2: "Hi !\nnone\nend", 3: "Hi !\nnone\nend"}
    for wrong, error in (("{{ who }}", KeyError), ("{% for x in y %}", ValueError), ("{% while x %}", ValueError)):
        with pytest.raises(error):
            templates.render(wrong, y=F.array(F.lit(1)))
    kinds = spark.createDataFrame([(k,) for k in ("temporal", "medication", "odd")], "k string")
    chunk = F.array(F.struct(F.lit("Note").alias("source"), F.lit("2024-01-02").alias("date"), F.lit("text").alias("text")))
    told = {r.k: r.p for r in kinds.select("k", templates.reasoning_prompt(F.col("k"), F.lit("Why?"), chunk).alias("p")).collect()}
    assert "[1] Note (2024-01-02): text\n" in told["temporal"] and "[1] Note: text\n" in told["medication"] and "Question: Why?" in told["odd"]


def test_entries_are_in_order_at_every_depth(spark):
    kind = "id long, data struct<z: int, a: array<struct<y: string, x: map<string, int>>>>, m map<string, struct<d: int, c: int>>"
    rows = [(1, (2, [("s", {"q": 1, "b": 2}), (None, None)]), {"k": (1, 2), "a": (None, 3)}), (2, None, None)]
    df = spark.createDataFrame(rows, kind)
    made = audit.entry_json(df, ["m", "data", "id"], "text")
    assert [r.text for r in made.orderBy("id").collect()] == ['{"data":{"a":[{"x":{"b":2,"q":1},"y":"s"},{}],"z":2},"id":1,"m":{"a":{"c":3},"k":{"c":2,"d":1}}}', '{"id":2}']
    read = audit.read_entries(made.select("text").union(spark.createDataFrame([("no json",), (None,)], "text string")), kind, "text")
    assert [(r.id, r.data.z if r.data else None, len(r.m) if r.m else None) for r in read.collect()] == [(1, 2, 2), (2, None, None), (None, None, None), (None, None, None)]


def test_reports_leave_texts_out(spark, tmp_path):
    from assayer.sources import records

    results_ = spark.createDataFrame([(1, "text", ["c"], 0.5), (2, None, None, None)], "q long, answer_text string, citations array<string>, f1 double")
    models = spark.createDataFrame([("m", 0.5)], "model string, f1 double")
    for _ in range(2):  # the second replaces the first
        records.write_report(results_, models, str(tmp_path / "report"))
    rows, told = records.read_report(spark, str(tmp_path / "report"), "q long, answer_text string, f1 double", "model string, f1 double")
    assert sorted(map(tuple, rows.collect())) == [(1, None, 0.5), (2, None, None)] and told.collect() == models.collect()


def test_detectors_and_trajectories(spark):
    from assayer.operators import sampling

    pairs = spark.createDataFrame([(1, "t", "h"), (2, "t2", "h2")], "pair_id long, ground_truth string, hallucinated string")
    said = spark.createDataFrame([(1, True, "d", True), (1, False, "d", False), (2, True, "d", False), (9, True, "d", True)], "pair_id long, is_hallucinated boolean, detector string, is_flagged boolean")
    got = {(r.pair_id, r.is_hallucinated): (r.answer, r.detector, r.is_flagged) for r in sampling.detected(pairs, said).collect()}
    assert got == {(1, True): ("h", "d", True), (1, False): ("t", "d", False), (2, True): ("h2", "d", False), (2, False): ("t2", None, None)}
    runs = [(1, True, '{"verdict": "PARTIAL"}', '[{"challenge_type": "x"}]'), (2, True, "supported", "[]"), (3, False, '{"verdict":"supported"}', None), (4, None, None, '"challenge_type"')]
    told = sampling.pipeline_trajectories(spark.createDataFrame(runs, "i long, is_hallucinated boolean, verifier_output string, challenger_output string"))
    assert [(r.verifier_correct, r.challenger_correct, r.shared_reward) for r in told.orderBy("i").collect()] == [(True, True, 1.0), (False, False, -1.0), (True, True, 1.0), (False, False, -1.0)]


def test_timelines_have_places(spark):
    from assayer.operators import filters

    rows = [("a", 3, 1), ("a", 1, 2), ("b", 5, 3), ("a", None, 4), (None, 2, 5)]
    got = filters.timeline_order(spark.createDataFrame(rows, "who string, at long, id long"), "who", "at", ["id"])
    assert {r.id: r.position for r in got.collect()} == {4: 1, 2: 2, 1: 3, 3: 1, 5: 1}
