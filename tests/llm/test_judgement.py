"""Quality rules, the two classifiers, and telephony media."""

import hashlib
import math
import random
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import labelled, media, quality, rules, stats, toxicity
from tests.llm.conftest import WORDS, sentence


def plain_counts(text):
    words = text.encode().split()
    lines = [x for x in text.encode().split(b"\n") if x.split()]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_base_counts(docs, rows):
    got = rules.judge(docs).collect()
    want = {i: plain_counts(t) for i, t in rows if len(t) < 9000}
    for r in got:
        if r.doc_id in want:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert rules.judge(docs.limit(0)).count() == 0


def garbled(rng):
    return " ".join(rng.choice(WORDS) + rng.choice(["###", "&&&", "***"]) for _ in range(120))


def test_rules_keep_prose_and_reject_garble(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(sentence(rng, 12) for _ in range(12)), "en") for i in range(80)]
    rows += [(100 + i, garbled(rng), "en") for i in range(10)] + [(200 + i, " ".join(sentence(rng, 12) for _ in range(12)).upper(), None) for i in range(10)]
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(80)) and not any(got[i].kept for i in got if i >= 100)


def test_common_words_alone_reject_texts_without_them(spark):
    """Clean characters and no repeats: only the distance of common words decides, and only from some length on."""
    rng = random.Random(9)
    small = stats.COMMON_WORDS["en"].split()
    stock = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) + rng.choice("nrst") for _ in range(400)]

    def prose(n, share):
        words = [rng.choice(small) if rng.random() < share else rng.choice(stock) for _ in range(n)]
        return " ".join(" ".join(words[i : i + 12]).capitalize() + "." for i in range(0, n, 12))

    rows = [(i, prose(rng.choice([60, 240, 900]), 0.27), "en") for i in range(120)]
    rows += [(200 + i, prose(240, 0), "en" if i % 2 else None) for i in range(6)] + [(300 + i, prose(55, 0), None) for i in range(3)]
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(r.base_failed or r.char_distance > rules.MAX_CHAR_DISTANCE for r in got.values())
    assert {i for i in got if not got[i].kept} == {200 + i for i in range(6)}
    for r in got.values():
        assert r.kept == (r.word_distance <= rules.MAX_WORD_DISTANCE + rules.WORD_SLIP / math.sqrt(r.n_words))
    free = rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_word=1.0)
    assert free.where("not kept").count() == 0


def plain_distance(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    return math.sqrt(max(0, (kl(p) + kl(q)) / 2))


def plain_kind(c):
    if c in "\t\n\x0b\x0c\r":
        return "break"
    if c in "#*$%&|<>":
        return "symbol"
    if c in "@/\\_[]{}":
        return "sign"
    k = unicodedata.category(c)
    return {"Ll": "lower", "Lu": "upper", "Lt": "upper"}.get(k) or {"L": "letter", "M": "mark", "N": "digit", "Z": "space", "P": "stop", "S": "sign", "C": "control"}[k[0]]


def test_distances_are_those_of_plain_counts(spark):
    rng = random.Random(7)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    russian = [" ".join(word("абвгдежзиклмно", rng.randint(1, 7)) for _ in range(90)).capitalize() + "." for _ in range(30)]
    rows = [(i, " ".join(sentence(rng, 12) for _ in range(rng.randint(5, 14))), "en") for i in range(60)] + [(100 + i, t, "ru") for i, t in enumerate(russian)]
    rows += [(200, garbled(rng), "en"), (201, "Ὅτι é ñ 漢字 \u0301 ½ €" * 30, None), (202, "", "en"), (203, None, None), (204, "Кот " * 3, "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lists = rules.word_lists(df)
    assert set(lists) == {"de", "en", "es", "fr", "ru", "xx"} and set(lists["ru"].split()) <= {w for t in russian for w in t.lower().strip(".").split()}
    known = rules.references(df, lists=lists)
    assert known["ru"].script == "CYRILLIC" and known["en"].script == "LATIN"
    got = {r.doc_id: r for r in rules.judge(df).collect()}
    common = stats.CommonWords(lists)
    for i, t, _ in rows:
        chars = [sum(plain_kind(c) == k for c in t or "") for k in stats.CLASSES]
        plain = "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in t or "").split()
        plain = [w.encode().lower() for w in plain]
        by_char, by_word = [], []
        for name, ref in known.items():
            own = [w.encode() for w in lists[name].split()]
            own = [w for w in sorted({x.encode() for ws in lists.values() for x in ws.split()}) if w in own]
            k = common.languages.index(name)
            order = sorted(range(len(common.of[k])), key=lambda j: common.of[k][j])
            words = [sum(w == x for w in plain) for x in own]
            ref_words = [int(ref.words[j]) for j in order] + [int(ref.words[-1])]
            by_char.append(plain_distance(chars, ref.classes.tolist()) if t else 1)
            by_word.append(plain_distance([*words, len(plain) - sum(words)], ref_words) if plain else 1)
        assert got[i].char_distance == pytest.approx(min(by_char), abs=1e-9) and got[i].word_distance == pytest.approx(min(by_word), abs=1e-9)
        far = (len(t or "") >= 200 and min(by_char) > rules.MAX_CHAR_DISTANCE) or (got[i].n_words >= 50 and min(by_word) > rules.MAX_WORD_DISTANCE + rules.WORD_SLIP / math.sqrt(got[i].n_words))
        written = {r.script for r in known.values()} | {""}
        assert got[i].kept == (not got[i].base_failed and not (far and got[i].script in written))


def test_prose_of_a_script_without_reference_stays(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(sentence(rng, 12) for _ in range(12)), "en") for i in range(60)]
    rows += [(100, " ".join("".join(rng.choice("абвгдежзиклмно") for _ in range(rng.randint(1, 8))) for _ in range(120)), "en"), (101, " ".join("".join(rng.choice("αβγδεζηθικλμν") for _ in range(rng.randint(1, 8))) for _ in range(120)), None)]
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100].kept and got[101].kept and got[100].script == "CYRILLIC" and got[101].script == "GREEK"


def test_jensen_shannon_is_a_distance():
    p, q = np.array([[1, 0], [1, 1], [0, 0]]), np.array([0, 3])
    assert stats.jensen_shannon(p, q).tolist() == pytest.approx([1, 0.5579230452841438, 1])
    assert stats.jensen_shannon(q, q)[0] == 0


def test_trees_walk_like_a_plain_tree():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(800, 4)), 1)  # many ties
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    forest = quality.fit(x, y, trees=12, depth=3)

    def plain(row):
        total = forest.base
        for feature, cut, leaf in zip(forest.feature, forest.cut, forest.leaf, strict=True):
            at = 0
            while at < len(feature):
                at = 2 * at + (2 if row[feature[at]] > cut[at] else 1)
            total += leaf[at - len(feature)]
        return 1 / (1 + math.exp(-total))

    assert forest.score(x) == pytest.approx([plain(r) for r in x])


def test_statistics_of_odd_texts_and_scores_in_tables(spark):
    common = stats.CommonWords()
    assert quality.statistics(b"", common) == [0.0] * len(quality.STATISTICS)
    text = "The cat and the dog.\nThe cat and the dog.\n"
    told = dict(zip(quality.STATISTICS, quality.statistics(text.encode(), common), strict=True))
    assert told["log_words"] == pytest.approx(math.log(11)) and told["distinct_words"] == pytest.approx(0.5) and told["dup_lines"] == pytest.approx(1 / 3)
    docs, labels = labelled_corpus(spark, 200)
    odd = docs.limit(3).selectExpr("doc_id", "case doc_id % 3 when 0 then null when 1 then '' else repeat('x y ', 300000) end as text", "'clash' as score", "'clash' as predicted", "1 as extra")
    forest = quality.train(docs, labels.union(labels))
    got = quality.score(odd, forest).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.extra == 1 for r in got)


def test_trees_fit_and_answer_without_lessons(spark, docs):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > -0.1)).astype(float)
    forest = quality.fit(x[:2000], y[:2000])
    assert ((forest.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert quality.fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.train(docs, none)).collect()
    assert len(got) == docs.count() and all(r.score == 0.5 and r.predicted == 1 for r in got)


def labelled_corpus(spark, n=500):
    rng = random.Random(11)
    rows, marks = [], []
    for i in range(n):
        bad, rude = i % 7 == 0, i % 5 == 0
        words = [sentence(rng, 10) for _ in range(8)]
        if rude:
            for k in (1, 4):
                words[k] = words[k][:-1] + " " + rng.choice(["blockhead", "nincompoop", "wretch" + rng.choice(["ed", "es", "ing"])]) + "."
        rows.append((i, garbled(rng) if bad else " ".join(words)))
        marks.append((i, int(not bad), int(rude and not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_documents(spark):
    docs, labels = labelled_corpus(spark)
    forest = quality.train(docs, labels)
    got = quality.score(docs.withColumn("held_out", labelled.held_out()), forest).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 50 and (got.predicted == got.quality).mean() > 0.97


def test_toxicity_on_held_out_and_disguised_texts(spark):
    docs, labels = labelled_corpus(spark)
    machine = toxicity.train(docs, labels)
    got = toxicity.score(docs.withColumn("held_out", labelled.held_out()), machine).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.95
    said = ["You blockhead.", "You b l o c k h e a d.", "You block-head.", "such a blockxhead", "A wretchedly dim place.", "The plain truth of it.", "", None]
    odd = toxicity.score(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string"), machine).orderBy("doc_id").toPandas()
    assert odd.predicted.tolist()[:4] == [1, 1, 1, 1] and odd.predicted.tolist()[5:] == [0, 0, 0] and odd.score.between(0, 1).all()


def test_toxicity_of_long_and_clashing_rows(spark):
    docs, labels = labelled_corpus(spark, 300)
    machine = toxicity.train(docs.union(docs), labels.union(labels))
    odd = spark.createDataFrame([(1, "the plain house " * 200000, "clash"), (2, "a b " * 100000 + "you blockhead. " + "a b " * 100000, "clash"), (3, "a" * 300000, "clash")], "doc_id long, text string, predicted string")
    got = {r.doc_id: r for r in toxicity.score(odd, machine).collect()}
    assert [got[i].predicted for i in (1, 2, 3)] == [0, 1, 0]


def test_toxicity_without_lessons(spark, docs):
    none = spark.createDataFrame([(1, 1, 0), (2, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, none)).toPandas()
    assert got.score.nunique() == 1 and len(got) == docs.count()


def plain_kernel(s, t):
    from itertools import combinations

    def values(x):
        out = {}
        for c in combinations(range(len(x)), 3):
            span = c[2] - c[0] + 1
            if span <= toxicity.SPAN:
                key = tuple(int(toxicity._LETTER[x[i]]) for i in c)
                out[key] = out.get(key, 0) + toxicity.DECAY**span
        return out

    a, b = values(s), values(t)
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    return (sum(v * b.get(k, 0) for k, v in a.items()) / (size(a) * size(b))) ** toxicity.POWER if a and b else 0.0


def test_kernel_counts_gapped_subsequences():
    words = ["<idiot>", "<idxiot>", "<>", "<tidioti>", "<clean>", "", "<" + "ab" * 400 + ">", "<é漢>"]
    words = [w.encode() for w in words]
    marks = [b"<idiot>", b"<mean>", b"<abab>"]
    assert toxicity.Landmarks(marks).kernel(words) == pytest.approx(np.array([[plain_kernel(w, m) for m in marks] for w in words]), abs=1e-5)


def test_margins_are_those_of_a_plain_kernel_machine():
    rng = np.random.default_rng(1)
    marks = sorted(b"<" + w.encode() + b">" for w in ("blockhead", "wretch", "people", "before", "house"))
    root = toxicity.nystroem(toxicity.Landmarks(marks))
    machine = toxicity.Machine(marks, root, rng.normal(size=len(marks)), -0.3)
    rows = ["You blockheads, people! Go home. " + "word " * 50, "", "... !", "One house before wretched people", "b l o c k h e a d ?"]
    alpha = root @ machine.weights

    def margin(sentence):
        own = [toxicity.bare(w) for w in sentence]
        own = [w for w in own if w]
        return sum(plain_kernel(w, m) * a for w in own for m, a in zip(marks, alpha)) / math.sqrt(max(1, len(own))) + machine.bias

    want = []
    for t in rows:
        found, now = [], []
        for w in toxicity.words_of(t.encode()):
            now.append(w)
            if w[-1:] in (b".", b"!", b"?") or len(now) == toxicity.LONGEST:
                found.append(margin(now))
                now = []
        want.append(max([*found, *([margin(now)] if now else [])], default=machine.bias))
    assert toxicity.Reader(machine).margins([t.encode() for t in rows]) == pytest.approx(want, abs=1e-5)
    x, of = toxicity.sentence_features([t.encode() for t in rows], toxicity.Landmarks(marks), root)
    assert [max([x[i] @ machine.weights + machine.bias for i in np.flatnonzero(of == k)], default=machine.bias) for k in range(len(rows))] == pytest.approx(want, abs=1e-4)


def family_corpus(spark, n=600):
    """Label 1: two in eight sentences have a word of the family "gral-" with any ending; one of label 0 in five has one such word by chance, one has the stem alone."""
    rng = random.Random(23)
    endings = ["dek", "mor", "vist", "quon", "pel", "tarn", "bif", "lusk", "henz", "joop", "wint", "sark"]
    rows, marks = [], []
    for i in range(n):
        rude = i % 8 == 0
        words = [sentence(rng, 10) for _ in range(rng.choice([4, 8, 16]))]
        for k in range(0, len(words), 4) if rude else ():
            for j in (k, k + 1):
                words[j] = words[j][:-1] + " gral" + rng.choice(endings) + "."
        if not rude and i % 5 == 1:
            words[0] = words[0][:-1] + " " + ("gral" + rng.choice(endings) if i % 2 else "gral") + "."
        rows.append((i, " ".join(words)))
        marks.append((i, int(rude)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"), endings


def test_toxicity_of_word_families_that_clean_texts_have_by_chance(spark):
    docs, labels, endings = family_corpus(spark)
    machine = toxicity.train(docs, labels)
    got = toxicity.score(docs.withColumn("held_out", labelled.held_out()), machine).join(labels, "doc_id").where("held_out").toPandas()
    assert got.predicted[got.toxic == 1].mean() >= 0.9 and (got.predicted[got.toxic == 0] == 0).mean() >= 0.95
    chosen = {w.strip(b"<>").decode() for w in machine.landmarks}
    assert sum("gral" + e in chosen for e in endings) >= 6


def test_evidence_and_strongest_sentence_are_those_of_a_plain_reading():
    rng = np.random.default_rng(2)
    marks = sorted(b"<" + w.encode() + b">" for w in ("blockhead", "wretch", "people", "before", "house"))
    root = toxicity.nystroem(toxicity.Landmarks(marks))
    machine = toxicity.Machine(marks, root, rng.normal(size=len(marks)), -0.3)
    rows = ["You blockheads, people! Go home. One house before wretched people, and houses", "", "people", "... !", "a wretch. a wretch. " * 3]
    reader = toxicity.Reader(machine)
    got = reader.evidence([t.encode() for t in rows])
    for t, row in zip(rows, got, strict=True):
        words = toxicity.words_of(t.encode())
        adds = sorted((max(0.0, sum(plain_kernel(toxicity.bare(w), m) * a for m, a in zip(marks, root @ machine.weights, strict=True))) for w in words), reverse=True)
        want = [*adds, *[0.0] * toxicity.STRONGEST][: toxicity.STRONGEST]
        assert row[1:-1] == pytest.approx(want, abs=1e-5) and row[-1] == pytest.approx(math.log1p(len(words) / toxicity.LONGEST))
    assert got[:, 0] == pytest.approx(reader.margins([t.encode() for t in rows]))
    best = reader.strongest([t.encode() for t in rows])
    assert reader.margins(best) == pytest.approx(got[:, 0]) and best[1] == b"" and best[2] == b"people" and best[4] == b"a wretch."


def test_landmarks_are_spread():
    words = [b"<blockhead>", b"<blockheads>", b"<blockheaded>", b"<wretch>"]
    assert toxicity.spread(words, np.array([3.0, 2.9, 2.8, 1.5]), 2) == [b"<blockhead>", b"<wretch>"]
    assert toxicity.spread(words, np.zeros(4), 2) == [] and toxicity.spread([], np.zeros(0), 2) == []


def test_lessons_are_one_for_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, None), (3, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    got = labelled.lessons(docs, labels, "toxic", 10).collect()
    held = {i for i in (1, 2) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {(r.id, r.label) for r in got} == {(1, 1), (2, 0)} - {(i, y) for i, y in ((1, 1), (2, 0)) if i in held} and len(got) == 2 - len(held)


def test_folds_follow_the_id(spark):
    rows = spark.range(200).withColumnRenamed("id", "doc_id").withColumn("held", labelled.held_out()).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_media_hold_the_text(docs, rows):
    got = media.listen(media.store(docs.select("doc_id", "text", "score"))).collect()
    want = {i: t.encode() for i, t in rows}
    assert {r.coding for r in got} == {"mulaw", "alaw", "adpcm"} and len(got) == len(rows)
    for r in got:
        own = want[r.doc_id]
        payload = own.ljust(max(1, -(-len(own) // 192)) * 192)
        tag, rate, block, stored = media.read_wav(bytes(r.media))
        assert stored == payload and r.n_bytes == len(own) and r.payload_bytes == len(payload)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        pcm = media.read_wav(bytes(r.pcm))
        assert pcm[:2] == (media.PCM, 16000) and len(pcm[3]) == 2 * r.n_samples
    assert media.listen(media.store(docs.limit(0))).count() == 0


def plain_adpcm(block):
    steps, changes = media.STEPS.tolist(), [-1, -1, -1, -1, 2, 4, 6, 8]
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = steps[index]
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + changes[code & 7]))
            out.append(value)
    return out


def plain_mulaw(code):
    code = ~code & 255
    size = (((code & 15) * 2 + 33) << (code >> 4 & 7)) * 4 - 132
    return -size if code & 128 else size


def plain_alaw(code):
    code ^= 0x55
    low, high = code & 15, code >> 4 & 7
    size = (2 * low + 1) * 8 if not high else (2 * low + 33) * 8 << high - 1
    return size if code & 128 else -size


def plain_double_rate(x):
    at = lambda i: x[max(0, min(len(x) - 1, i))]
    out = []
    for i, v in enumerate(x):
        out += [v, (-at(i - 1) + 9 * v + 9 * at(i + 1) - at(i + 2)) / 16]
    return [max(-32768, min(32767, round(v))) for v in out]


def test_features_are_those_of_a_plain_decoder(docs):
    for r in media.listen(media.store(docs.where("doc_id < 67 or doc_id > 69").select("doc_id", "text"))).collect():
        tag, _, block, stored = media.read_wav(bytes(r.media))
        plain = {media.MULAW: lambda p: [plain_mulaw(c) for c in p], media.ALAW: lambda p: [plain_alaw(c) for c in p], media.IMA_ADPCM: lambda p: [v for i in range(0, len(p), block) for v in plain_adpcm(p[i : i + block])]}
        samples = plain[tag](stored)
        pcm = np.frombuffer(media.read_wav(bytes(r.pcm))[3], "<i2").tolist()
        assert max(abs(a - b) for a, b in zip(pcm, plain_double_rate(samples), strict=True)) <= 1
        assert r.n_samples == len(pcm) and r.pcm_crc32 == zlib.crc32(np.array(pcm, "<i2").tobytes()) and r.peak == max(map(abs, samples))
        assert r.rms == pytest.approx(math.sqrt(sum(v * v for v in samples) / len(samples))) and r.crossings == sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:]))


def test_codecs(spark):
    assert media.MULAW_TABLE[[0x00, 0x80, 0x7F, 0xFF]].tolist() == [-32124, 32124, 0, 0]
    assert media.ALAW_TABLE[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    wave = (9000 * np.sin(np.arange(3000) / 15)).astype(np.int16)
    back = media.expand(media.IMA_ADPCM, 192, media.encode_adpcm(wave))[: len(wave)]
    assert np.abs(back[60:].astype(int) - wave[60:])[:300].mean() < 900
    assert len(media.resample(wave, 8000, 16000)) == 6000 and len(media.resample(wave, 8000, 11025)) == 3000 * 11025 // 8000
    assert np.abs(media.resample(wave, 8000, 16000)[::2].astype(int) - wave).max() <= 1
    files = [(1, None), (2, b""), (3, b"RIFFxxxxWAVE"), (4, media.wav(b"\x00\x01", 99)), (5, media.wav(wave.tobytes(), media.PCM, 8000))]
    got = {r.id: r for r in media.listen(spark.createDataFrame(files, "id long, media binary")).collect()}
    assert all(got[i].payload_bytes is None for i in (1, 2, 3, 4)) and got[5].n_samples == 6000


def test_pipeline_on_odd_rows(spark, docs):
    import corpus_pipeline as c

    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    long = own.withColumn("text", F.when(F.length("text") > 20, F.concat("text", F.lit(" "), F.lit(" ".join(f"q{i}" for i in range(50))), F.lit(" "), F.col("doc_id").cast("string"))).otherwise(F.col("text")))
    for frame in (long, own.limit(0)):
        for n, (_, stage) in enumerate(c.STAGES):
            frame = c.scratch.cut(stage(spark, frame, ""), f"t{n}")
            assert n == len(c.STAGES) - 1 or frame.columns == own.columns
    near = c.near_dedup(spark, own.where("text is not null and length(text) > 100"), "").collect()
    kept = {r.doc_id for r in near}
    assert 3 in kept and not kept & {60, 61, 62, 70} and len(near) == len(kept)
