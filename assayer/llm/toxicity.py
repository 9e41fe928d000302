"""Toxicity: a support vector machine over Nyström features of a subsequence string kernel."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled, scratch, texts

#: Labelled documents that the machine is fitted on, and sentences of each label, at most.
MAX_LESSONS, MAX_SENTENCES = 6_000, 20_000
#: Landmarks for each label, bytes that a word has at least to be one, and words that those of a label are chosen from.
LANDMARKS, LANDMARK_BYTES, CANDIDATES = 64, 3, 512
#: Standard errors by which a word's share of label 1 exceeds that of label 0 at most, if it is to be a landmark of label 0.
COMMON = 1.0
#: The kernel of two words: common subsequences of three bytes with spans of at most SPAN bytes, each byte of a span
#: weighing DECAY; that sum, normalised on both sides, to the power of POWER.
SPAN, DECAY, POWER = 6, 0.6, 2
#: Words of a sentence; a longer stretch without a stop is read as several sentences.
LONGEST = 40
#: Times that the sentences of label 1 are chosen anew, and the margin from which on one counts besides a document's first.
TURNS, CLEAR = 5, 0.5
#: Single characters in a row, from which on they are read as one word.
SPELLED = 3
CUT = 0.5
#: Words of a text that its score rests on, those that add most.
STRONGEST = 4
#: Ridge of the sigmoid's fit.
RIDGE = 1e-2
#: Cells of a matrix of words by subsequences.
CELLS = 1 << 21
#: Words that a Python worker remembers; with more, it starts anew.
REMEMBERED = 400_000

#: ASCII characters that are left out of words, and what marks a word's ends instead.
SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
START, END = b"<", b">"
STOPS = b".!?"

#: Numbers of bytes, under 64: letters a-z, digits as one, the marks, bytes of other letters by their lowest five bits.
_LETTER = np.array([b - 96 if 97 <= b <= 122 else 27 if 48 <= b <= 57 else 28 if b == 60 else 29 if b == 62 else 30 + (b & 31) if 0x80 <= b < 0xC0 else 62 if b >= 0xC0 else 0 for b in range(256)], np.uint64)
_CODES = 1 << 18
_SHAPES = [(middle, last) for last in range(2, SPAN) for middle in range(1, last)]
_WEIGHT = DECAY ** np.arange(1, SPAN + 1)


def subsequences(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, value): for each word its subsequences of three bytes, and the sum of DECAY to the power of their spans.

    These are a word's features: the kernel of two words is the sum of the products of their values.
    """
    letters, sizes = _LETTER[np.frombuffer(b"".join(words), np.uint8)], np.fromiter(map(len, words), np.int64, len(words))
    word = np.repeat(np.arange(len(words), dtype=np.uint64), sizes)
    keys = [np.zeros(0, np.uint64)]
    for middle, last in _SHAPES:
        at = np.flatnonzero(word[: max(0, len(word) - last)] == word[last:])
        code = letters[at] << np.uint64(12) | letters[at + middle] << np.uint64(6) | letters[at + last]
        keys.append(word[at] << np.uint64(21) | code << np.uint64(3) | np.uint64(last))
    key = np.sort(np.concatenate(keys))
    own = key >> np.uint64(3)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])[: len(own)])
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    value = np.add.reduceat(_WEIGHT[(key & np.uint64(7)).astype(np.int64)], first)
    return (own[first] >> np.uint64(18)).astype(np.int64), (own[first] & np.uint64(_CODES - 1)).astype(np.int64), value


class Landmarks:
    """Kernel values of words with a fixed set of words."""

    def __init__(self, words: list[bytes]):
        self.words = words
        word, code, value = subsequences(words)
        length = np.sqrt(np.bincount(word, value * value, minlength=len(words)))
        codes = np.unique(code)
        self.place = np.full(_CODES, -1, np.int64)
        self.place[codes] = np.arange(len(codes))
        self.values = np.zeros((len(codes), len(words)), np.float32)
        self.values[self.place[code], word] = value / length[word]

    def kernel(self, words: list[bytes]) -> np.ndarray:
        """(words, landmarks): the kernel, from 0 to 1; 0 for words of fewer than three bytes."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        step = max(1, CELLS // max(1, len(self.values)))
        for i in range(0, len(words), step):
            part = words[i : i + step]
            word, code, value = subsequences(part)
            length = np.sqrt(np.bincount(word, value * value, minlength=len(part)))
            row = self.place[code]
            known = row >= 0
            wide = np.zeros((len(part), len(self.values)), np.float32)
            wide[word[known], row[known]] = value[known]
            out[i : i + step] = wide @ self.values / np.maximum(length, 1e-12)[:, None]
        return np.minimum(out, 1.0) ** POWER


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words; SPELLED or more single characters in a row are one word more."""
    words = text.lower().split()
    short = np.fromiter(map(len, words), np.int64, len(words)) == 1
    if short.sum() >= SPELLED:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], short, [0]])))
        for a, b in zip(edges[::2].tolist()[::-1], edges[1::2].tolist()[::-1], strict=True):
            if b - a >= SPELLED:
                words[a:b] = [b"".join(words[a:b])]
    return words


def bare(word: bytes) -> bytes:
    """A word between marks of its ends, without the signs in it or around it; empty if it has only signs."""
    core = word.translate(None, SIGNS)
    return START + core + END if core else b""


def sentences(rows: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """For words of texts, one after another, the number of each word's sentence, and of each sentence its text.

    A sentence ends after a word that ends in a stop, after LONGEST words, and with its text.
    """
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = list(chain.from_iterable(rows))
    stop = np.fromiter((w[-1] in STOPS for w in flat), bool, len(flat))
    return _sentences(stop, sizes)


def _sentences(stop: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    text = np.repeat(np.arange(len(sizes)), sizes)
    begins = np.concatenate([[True], stop[:-1] | (text[1:] != text[:-1])])[: len(stop)]
    at = np.arange(len(stop))
    begins |= (at - np.maximum.accumulate(np.where(begins, at, 0))) % LONGEST == 0
    return np.cumsum(begins) - 1, text[begins]


@dataclass(frozen=True)
class Machine:
    """The kernel of two sentences is the sum of the kernels of their words, by the root of the product of their numbers of words.

    A sentence's features are its kernel with the landmarks (sentences of one word) times ``nystroem``, so its margin is the sum
    over its words of ``kernel @ nystroem @ weights``, by the root of their number, and ``bias``. A text's score is a sigmoid of
    what its words tell (``Reader.evidence``): ``slopes`` and ``shift``.
    """

    landmarks: list[bytes]
    nystroem: np.ndarray
    weights: np.ndarray
    bias: float
    slopes: np.ndarray | None = None
    shift: float = 0.0

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.slopes + self.shift, -500, 500)))


class Reader:
    """What words add to the margins of their sentences; each distinct word is compared with the landmarks once."""

    def __init__(self, machine: Machine):
        self.landmarks, self.bias = Landmarks(machine.landmarks), machine.bias
        self.by_word = machine.nystroem @ machine.weights
        self.places: dict[bytes, int] = {}
        self.adds, self.counts, self.stops = (np.zeros(1 << 12, kind) for kind in (np.float64, bool, bool))

    def learn(self, words: set[bytes]) -> None:
        if len(self.places) > REMEMBERED:
            self.places = {}
        new = sorted(words.difference(self.places))
        known = {w: i for i, w in enumerate(sorted({bare(w) for w in new}))}
        adds = np.zeros(len(known))
        held = list(known)
        for i in range(0, len(held), 1 << 14):
            adds[i : i + (1 << 14)] = self.landmarks.kernel(held[i : i + (1 << 14)]) @ self.by_word
        n = len(self.places)
        while n + len(new) > len(self.adds):
            self.adds, self.counts, self.stops = (np.concatenate([x, x]) for x in (self.adds, self.counts, self.stops))
        own = slice(n, n + len(new))
        at = np.fromiter((known[bare(w)] for w in new), np.int64, len(new))
        self.adds[own] = adds[at]
        self.counts[own] = np.fromiter((held[i] != b"" for i in at), bool, len(new))
        self.stops[own] = np.fromiter((w[-1] in STOPS for w in new), bool, len(new))
        self.places.update(zip(new, range(n, n + len(new)), strict=True))

    def margins(self, rows: list[bytes]) -> np.ndarray:
        """The largest margin of each text's sentences; the bias alone for a text without words."""
        return self._margins(*self._read(rows))

    def evidence(self, rows: list[bytes]) -> np.ndarray:
        """(texts, STRONGEST + 2): each text's largest margin, what the words add that add most (repeats count, no less than 0), and its length.

        The length is log(1 + words / LONGEST): in a long text a word that is like a landmark by chance says less.
        """
        at, sizes = self._read(rows)
        out = np.zeros((len(rows), STRONGEST + 2))
        out[:, 0], out[:, -1] = self._margins(at, sizes), np.log1p(sizes / LONGEST)
        adds, ends = self.adds[at], np.cumsum(sizes)
        for i, (n, end) in enumerate(zip(sizes.tolist(), ends.tolist(), strict=True)):
            own = adds[end - n : end]
            most = np.sort(own if n <= STRONGEST else np.partition(own, n - STRONGEST)[n - STRONGEST :])[::-1]
            out[i, 1 : 1 + len(most)] = np.maximum(most, 0)
        return out

    def _read(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The places of all words, one text after another, and the texts' numbers of words."""
        split = [words_of(t) for t in rows]
        self.learn(set().union(*split) if split else set())
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        return np.fromiter(map(self.places.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum())), sizes

    def _margins(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        margin, text, _ = self._by_sentence(at, sizes)
        out = np.full(len(sizes), -np.inf)
        np.maximum.at(out, text, margin)
        return np.where(np.isinf(out), self.bias, out)

    def _by_sentence(self, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Margins of all sentences and their texts, and each word's sentence."""
        if not len(at):
            return np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        sentence, text = _sentences(self.stops[at], sizes)
        n = np.bincount(sentence, self.counts[at])
        return np.bincount(sentence, self.adds[at]) / np.sqrt(np.maximum(n, 1)) + self.bias, text, sentence

    def strongest(self, rows: list[bytes]) -> list[bytes]:
        """Each text's sentence with the largest margin, the first of equals; empty for a text without words."""
        at, sizes = self._read(rows)
        margin, text, sentence = self._by_sentence(at, sizes)
        order = np.lexsort((np.arange(len(margin)), -margin, text))
        best = order[np.flatnonzero(np.diff(text[order], prepend=-1))]
        held, words = np.isin(sentence, best), list(self.places)
        out: list[list[bytes]] = [[] for _ in rows]
        for i in np.flatnonzero(held).tolist():
            out[text[sentence[i]]].append(words[at[i]])
        return [b" ".join(ws) for ws in out]


def nystroem(landmarks: Landmarks) -> np.ndarray:
    """K^(-1/2) of the landmarks' own kernel matrix."""
    raw = landmarks.kernel(landmarks.words).astype(float)
    values, vectors = np.linalg.eigh((raw + raw.T) / 2)
    keep = values > 1e-6
    return vectors[:, keep] / np.sqrt(values[keep]) @ vectors[:, keep].T


def sentence_features(rows: list[bytes], landmarks: Landmarks, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentences, landmarks) features of all sentences of texts, and each sentence's text."""
    split = [words_of(t) for t in rows]
    if not any(split):
        return np.zeros((0, len(landmarks.words)), np.float32), np.zeros(0, np.int64)
    known = {w: i for i, w in enumerate(sorted({bare(w) for ws in split for w in ws}))}
    mapped = (landmarks.kernel(list(known)) @ root).astype(np.float32)
    at = np.fromiter((known[bare(w)] for ws in split for w in ws), np.int64)
    sentence, text = sentences(split)
    n = np.bincount(sentence, at != known.get(b"", -1))
    first = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
    parts = [np.add.reduceat(mapped[at[a:b]], first[i : i + 4096] - a, axis=0) for i, a, b in ((i, first[i], first[i + 4096] if i + 4096 < len(first) else len(at)) for i in range(0, len(first), 4096))]
    return np.concatenate(parts) / np.sqrt(np.maximum(n, 1))[:, None].astype(np.float32), text


def fit_svm(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the squared hinge loss, classes weighing alike; Newton steps in the primal."""
    wide, sign = np.hstack([x, np.ones((len(x), 1))]), 2.0 * y - 1
    cost = np.where(y > 0, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
    penalty, w = ridge * np.eye(wide.shape[1]), np.zeros(wide.shape[1])
    penalty[-1, -1] = 1e-6
    active = np.ones(len(y), bool)
    for _ in range(50):
        own = wide[active] * cost[active, None]
        w = np.linalg.solve(penalty + own.T @ wide[active], own.T @ sign[active])
        now = sign * (wide @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def fit_sentences(x: np.ndarray, y: np.ndarray, bag: np.ndarray) -> tuple[np.ndarray, float]:
    """A machine for sentences whose documents (``bag``) have the labels ``y``.

    At first a document's label is its sentences'. Then of a document of label 1 those stay that the machine before finds
    clearly positive, and the one that it finds most so if it is positive; the others say nothing.
    """
    use, label = np.ones(len(y), bool), y
    for _ in range(TURNS):
        w, b = fit_svm(x[use].astype(float), label[use])
        margin = x @ w + b
        most = np.full(int(bag.max(initial=0)) + 1, -np.inf)
        np.maximum.at(most, bag, margin)
        use = (y == 0) | ((margin >= most[bag]) & (margin > 0)) | (margin > CLEAR)
    return w, b


def fit_sigmoid(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Slopes and shift of a sigmoid over rows of ``x``, classes weighing alike; Newton steps, halved until they help."""
    wide, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    cost = np.where(y > 0, 1 / max(1, y.sum()), 1 / max(1, (1 - y).sum())) * len(y) / 2
    penalty = np.append(np.full(x.shape[1], ridge), 1e-6)

    def loss(w: np.ndarray) -> float:
        return float(cost @ np.logaddexp(0, (1 - 2 * y) * (wide @ w)) + penalty @ (w * w) / 2)

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(wide @ w, -500, 500)))
        step = np.linalg.solve((wide * (cost * p * (1 - p))[:, None]).T @ wide + np.diag(penalty), wide.T @ (cost * (y - p)) - penalty * w)
        while (then := loss(w + step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if not then < now:
            break
        w, now = w + step, then
    return w[:-1], float(w[-1])


def spread(words: list[bytes], gains: np.ndarray, most: int) -> list[bytes]:
    """At most ``most`` of the words, each that of the largest gain times what the kernel leaves open after those before it (pivoted Cholesky)."""
    own = Landmarks(words).kernel(words).astype(float) if words else np.zeros((0, 0))
    own = (own + own.T) / 2
    left, rows, chosen = np.diag(own).copy(), np.zeros((len(words), 0)), []
    for _ in range(min(most, len(words))):
        i = int(np.argmax(gains * np.maximum(left, 0)))
        if left[i] < 1e-6 or gains[i] <= 0:
            break
        column = (own[:, i] - rows @ rows[i]) / np.sqrt(left[i])
        rows, left = np.hstack([rows, column[:, None]]), left - column**2
        chosen.append(words[i])
    return chosen


def _chosen(counted: list, most: int) -> Iterator[tuple]:
    """Of rows (lot, label, n) in order of their lots those that fit into ``most`` sentences of their label together."""
    left = {}
    for r in sorted(counted, key=lambda r: (r["lot"], r["n"])):
        if r["n"] <= left.setdefault(r["label"], most):
            left[r["label"]] -= r["n"]
            yield r["lot"], r["n"]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_LESSONS, text: str = "text", id: str = "doc_id") -> Machine | float:
    """Fit a machine on at most ``most`` labelled documents.

    Landmarks are LANDMARKS words for each label, spread by the kernel: of label 1 the CANDIDATES whose share of its lessons
    exceeds that of the others by most standard errors, of label 0 those of its lessons that look like them and don't
    exceed it (by COMMON), the more lessons the sooner. The machine learns from all sentences of the lessons that
    fit into MAX_SENTENCES for each label, by the hash of their id; the sigmoid turns what a document's words tell into
    its score, and is fitted on all lessons and on the strongest sentence of each as a text of its own, so that one clear
    sentence is enough. Equals go by the word. With one label only, or no landmark, the
    (smoothed) share of label 1 is returned, which scores all texts alike.
    """
    lessons = scratch.cut(labelled.lessons(docs, labels, label, most, text, id).withColumn("lot", F.xxhash64(F.col("id").cast("string"), F.lit(5))), "lessons")

    def words():
        def found(rows: list[bytes]) -> list[pa.Array]:
            split = [words_of(t) for t in rows]
            counts = np.bincount(sentences(split)[1], minlength=len(rows)) if any(split) else np.zeros(len(rows), np.int64)
            return [pa.array(counts.astype(np.int64)), pa.array([sorted({bare(w) for w in ws}) for ws in split], pa.list_(pa.binary()))]

        return found

    told = scratch.cut(texts.with_columns(lessons, words, "n long, words array<binary>", drop_text=True), "words")
    counted = told.select("lot", "label", "n").collect()
    y = np.array([r["label"] for r in counted], float)
    words_told = told.select("label", F.explode("words").alias("word")).where(F.octet_length("word") >= LANDMARK_BYTES + 2)
    if len(set(y)) < 2:
        return float((y.sum() + 1) / (len(y) + 2))
    ones, noughts = float(y.sum()), float((1 - y).sum())
    held = (F.col("t") + F.col("f")) / (ones + noughts)
    excess = (F.col("t") / ones - F.col("f") / noughts) / F.sqrt(F.greatest(held * (1 - held), F.lit(1e-12)) * (1 / ones + 1 / noughts))
    common = words_told.groupBy("word").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("f")).withColumn("excess", excess)
    common = scratch.cut(common, "common")
    top = common.where("excess > 0").orderBy(F.desc("excess"), "word").limit(CANDIDATES).collect()
    marks = spread([bytes(r["word"]) for r in top], np.array([r["excess"] for r in top]), LANDMARKS)
    if not marks:
        return float((y.sum() + 1) / (len(y) + 2))

    def likeness():
        landmarks = Landmarks(marks)
        return lambda rows: [pa.array(landmarks.kernel(rows).max(axis=1).astype(float))]

    plain = texts.with_columns(common.where((F.col("excess") < COMMON) & (F.col("f") > 0)), likeness, "alike double", text="word")
    near = plain.withColumn("gain", F.col("alike") * F.sqrt("f")).where("gain > 0").orderBy(F.desc("gain"), "word").limit(CANDIDATES).collect()
    chosen = sorted({*marks, *spread([bytes(r["word"]) for r in near], np.array([r["gain"] for r in near]), LANDMARKS)})
    root = nystroem(Landmarks(chosen))

    def features():
        landmarks = Landmarks(chosen)

        def found(rows: list[bytes]) -> list[pa.Array]:
            x, of = sentence_features(rows, landmarks, root)
            ends = np.searchsorted(of, np.arange(1, len(rows) + 1))
            return [texts.binary(np.concatenate([[0], ends]) * 4 * x.shape[1], x)]

        return found

    few = docs.sparkSession.createDataFrame(sorted(set(_chosen(counted, MAX_SENTENCES))), "lot long, n long")
    held = told.join(F.broadcast(few), ["lot", "n"], "left_semi").select("lot")
    made = texts.with_columns(lessons.join(F.broadcast(held), "lot", "left_semi"), features, "x binary", drop_text=True).select("lot", "label", "x").orderBy("lot").collect()
    x = [np.frombuffer(r["x"], np.float32).reshape(-1, len(chosen)) for r in made]
    bag, own = np.repeat(np.arange(len(x)), [len(s) for s in x]), np.repeat([float(r["label"]) for r in made], [len(s) for s in x])
    if len(set(own)) < 2:
        return float((y.sum() + 1) / (len(y) + 2))
    machine = Machine(chosen, root, *fit_sentences(np.concatenate(x), own, bag))

    def told_by():
        reader = Reader(machine)

        def found(rows: list[bytes]) -> list[pa.Array]:
            made = np.hstack([reader.evidence(rows), reader.evidence(reader.strongest(rows))])
            return [texts.binary(np.arange(len(rows) + 1) * 8 * made.shape[1], made)]

        return found

    seen = texts.with_columns(lessons, told_by, "x binary", drop_text=True).select("lot", "label", "x").orderBy("lot").collect()
    made = np.stack([np.frombuffer(r["x"]) for r in seen]).reshape(2 * len(seen), -1)
    slopes, shift = fit_sigmoid(made, np.repeat([float(r["label"]) for r in seen], 2))
    return replace(machine, slopes=slopes, shift=shift)


def score(docs: DataFrame, machine: Machine | float, cut: float = CUT, text: str = "text", drop_text: bool = False) -> DataFrame:
    """Append ``score`` (0 to 1) and ``predicted`` (1 if score >= cut) to documents; a null text scores as empty.

    A text scores by the largest margin of its sentences, the words that add most and its length. Only the text has a say.
    Equal texts score alike; columns of the same names are replaced.
    """

    def work():
        reader = Reader(machine) if isinstance(machine, Machine) else None

        def scores(rows: list[bytes]) -> list[pa.Array]:
            found = machine.score(reader.evidence(rows)) if reader else np.full(len(rows), float(machine))
            return [pa.array(found), pa.array((found >= cut).astype(np.int32))]

        return scores

    return texts.with_columns(docs, work, "score double, predicted int", text, drop_text)
