"""SimHash components and recurring passages, against brute force."""

from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import components, passages, simhash, vptree


def plain_print(text, width):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_prints_and_components(docs, rows):
    got = sorted(((r.doc_id, r["print"] & (1 << 64) - 1, r.component) for r in simhash.near_prints(docs).collect()), key=str)
    prints = [plain_print(t, 3) for _, t in rows]
    assert sorted((i, p) for i, p, _ in got if i is not None) == sorted((i, p) for (i, _), p in zip(rows, prints) if i is not None)
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(prints[i] ^ prints[j]).count("1") <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    names = {}
    for (i, _), own in zip(rows, label):
        names.setdefault(own, []).append(i)
    want = {i: min(x for x in ids if x is not None) for ids in names.values() for i in ids if i is not None}
    assert {i: c for i, _, c in got if i is not None} == want


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.integers(0, 3), st.booleans())
def test_leaves_find_every_link(seed, n, radius, dense):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 8, np.uint64)
    points = rng.choice(centres, n) if dense else rng.integers(0, 1 << 63, n, np.uint64)
    for _ in range(3):
        points = points ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    tree = vptree.build(np.sort(points[: max(1, n // 2)]), 3, radius)
    point, leaf, home = tree.route(points, radius)
    assert sorted(point[home]) == list(range(n))
    a, b = [], []
    for k in set(leaf):
        own = np.flatnonzero(leaf == k)
        label = vptree.Leaf(points[point[own]], home[own], radius).label
        a.append(point[own]), b.append(point[own[label]])
    got = vptree.stars(n, np.concatenate(a), np.concatenate(b))
    x, y = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= radius)
    assert (got == vptree.stars(n, x, y)).all()


def test_components_of_chains_hubs_and_nulls(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (None, 3), (400, 300), (300, 400)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100} | {200 + i: 100 for i in range(50)} | {300: 300, 400: 300}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_documents_join_near_copies_only(docs, rows):
    got = {r.doc_id: r.component for r in simhash.near_documents(docs).collect() if r.doc_id is not None}
    assert got[60] == got[61] == got[70] == got[3] == 3 and got[62] == got[12] == 12 and got[64] == got[63] == 63
    assert len(set(got.values())) == len({t for i, t in rows if i is not None}) - 1


def test_sketch_distance_tells_similarity():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 5000, 600)]
    other = list(words)
    other[100:130] = [f"v{i}" for i in range(30)]
    one, two = simhash.sketches([" ".join(words).encode(), " ".join(other).encode()], 5, 8)
    sets = [set(simhash.shingle_hashes(" ".join(x).encode(), 5)) for x in (words, other)]
    jaccard = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs(int(np.bitwise_count(one ^ two).sum()) - simhash.similarity_bits(jaccard, 512)) < 45


def plain_removal(rows, window):
    words = [t.encode().split() for t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


@pytest.mark.parametrize("window", [31, 35, 50])
def test_passages_go_wherever_they_recur(docs, rows, window):
    got = passages.remove(docs, window).collect()
    want = plain_removal([t for _, t in rows], window)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == sorted((str(i), *w) for (i, _), w in zip(rows, want))
    assert sum(r.n_removed for r in got) > 500 and got[0].score == "clash"


def test_passages_in_periodic_and_overlapping_texts(spark):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in rng.integers(0, 300, 1500)]
    texts = [" ".join(base[a : a + n]) for a, n in ((0, 700), (300, 40), (320, 34), (900, 600), (690, 240), (650, 35))] + ["x y " * 60, "x y " * 20, " ".join(["z"] * 36), " ".join(["z"] * 35)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in passages.remove(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == plain_removal(texts, 35)


def test_passages_of_nothing(nothing, docs):
    assert passages.remove(nothing).count() == 0
    with pytest.raises(ValueError):
        passages.remove(docs, 20)


def test_near_documents_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(11)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    texts, pairs = [], []
    for k in range(300):  # pairs from 0.65 to 0.95
        base = word(200)
        other = list(base)
        n = int(rng.integers(5, 40))
        other[100 : 100 + n] = word(n)
        pairs.append((len(texts), len(texts) + 1))
        texts += [base, other]
    base = word(150)
    for _ in range(150):  # copies that are alike in part
        copy = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 8)):
            copy[at] = word(1)[0]
        texts.append(copy)
    texts += [["loop"] * 300 + word(12) for _ in range(4)]  # sketches alike, different sets
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [set(simhash.shingle_hashes(t.encode(), 5)) for _, t in rows]
    jaccard = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) and jaccard(i, j) >= 0.8]
    want = vptree.stars(len(sets), *np.array(links).T)
    got = {r.doc_id: r.component for r in simhash.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    got = np.array([got[i] for i in range(len(sets))])
    assert (want[got] == want).all()  # no link below 0.8
    at = np.array([jaccard(*p) for p in pairs])
    joined = np.array([got[i] == got[j] for i, j in pairs])
    for low, high, least in ((0.8, 0.83, 0.9), (0.83, 0.87, 0.97), (0.87, 0.96, 1.0)):
        some = (at >= low) & (at < high)
        assert some.sum() >= 15 and joined[some].mean() >= least
    assert np.mean([got[i] == got[j] for i, j in links]) >= 0.97


def test_passages_of_many_equal_rows_and_of_every_document(spark):
    rng = np.random.default_rng(4)
    word = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 10**6, n))
    shared, same = word(60), word(80)
    rows = [(None, same)] * 3000 + [(i, f"{word(20)} {shared} {word(20)}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = passages.remove(docs).collect()
    assert len(got) == 3600
    assert {(r.n_words, r.n_removed) for r in got if r.doc_id is None} == {(80, 80)}
    assert {(r.n_words, r.n_removed) for r in got if r.doc_id is not None} == {(100, 60)}


def test_equal_rows_have_different_keys(spark, tmp_path):
    spark.createDataFrame([(None, "same text")] * 200, "doc_id long, text string").write.parquet(str(tmp_path / "same"))
    for docs in (spark.read.parquet(str(tmp_path / "same")).select("text"), spark.createDataFrame([("same text",)] * 200, "text string")):
        read, key = passages._keyed(docs, "text")
        first = [r.k for r in read.select(key.alias("k")).collect()]
        assert len(set(first)) == 200 and sorted(first) == sorted(r.k for r in read.select("text", key.alias("k")).collect())


def test_texts_of_a_template_make_few_pairs(spark, monkeypatch):
    """Each text has 33 of 300 words of its own: every pair at 0.778, no link. Pairs that are compared don't grow with the square."""
    rng = np.random.default_rng(7)
    template = [f"t{i}" for i in range(300)]
    compared, held = {}, simhash._alike
    for n in (200, 400, 800):
        rows = []
        for i in range(n):
            words = list(template)
            words[100:133] = [f"w{x}" for x in rng.integers(0, 10**6, 33)]
            rows.append((i, " ".join(words)))
        near = [(n + k, " ".join([*rows[k][1].split(" ")[:280], *(f"z{k}_{j}" for j in range(20))])) for k in range(5)]  # linked with their own text alone
        seen = []
        monkeypatch.setattr(simhash, "_alike", lambda pairs, *a: seen.append(pairs.count()) or held(pairs, *a))
        got = {r.doc_id: r.component for r in simhash.near_documents(spark.createDataFrame(rows + near, "doc_id long, text string")).collect()}
        compared[n] = seen
        sets = {i: set(simhash.shingle_hashes(t.encode(), 5)) for i, t in rows + near}
        linked = {i: {j for j in sets if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in (*range(8), *range(n, n + 5))}
        assert not any(linked[i] - {n + i} for i in range(5)) and all(got[i] == i for i in range(n))
        assert all(got[n + k] == (k if linked[n + k] else n + k) for k in range(5))
    assert all(c[-1] < 20 and max(c) <= 32 * n for n, c in compared.items()), compared  # before the last turn, a forest for each table at most


def test_a_text_that_stays_is_sent_once(spark):
    passage = b" ".join(b"p%d" % i for i in range(40))
    rows = [b"a \xff b " + passage, passage + b" c \xc3", b"one \xe2\x82 two", None]
    made = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) as text")
    got = passages.remove(made)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got.drop("text").collect()} == {0: (43, 40, "a � b"), 1: (42, 40, "c �"), 2: (3, 0, "one � two"), 3: (0, 0, "")}
    sent = next(x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "AS __text" in x)  # what goes to the automata
    assert "isValid" in sent and "makeValid" in sent
