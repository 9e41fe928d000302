"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import labelled, stats, texts

#: Labelled documents that the trees are fitted on, at most.
MAX_LESSONS = 20_000
#: Trees, their depth, bins for each statistic, step size, and the least weight of a leaf.
TREES, DEPTH, BINS, STEP, LEAST = 80, 4, 64, 0.15, 2.0
CUT = 0.3

STATISTICS = ["log_words", "word_length", "long_words", "distinct_words", "repeat_words", "dup_lines", "line_words", "common_words", "best_language", "second_language", "entropy", *(f"share_{c}" for c in stats.CLASSES)]


def statistics(text: bytes, common: stats.CommonWords) -> list[float]:
    """The statistics of one text, in the order of STATISTICS. All are 0 for an empty text."""
    counts = stats.byte_counts(text)
    classes, words = stats.class_counts(text, counts), text.split()
    n, chars = len(words), max(1, int(classes.sum()))
    frequent = common.counts(text)
    by_language = sorted((frequent[of].sum() / max(1, frequent.sum()) for of in common.of), reverse=True)
    p = counts[counts > 0] / max(1, len(text))
    return [
        np.log1p(n), len(text) / max(1, n), sum(len(w) > 12 for w in words) / max(1, n), len(set(words)) / max(1, n), stats.repeat_words(words) / max(1, n),
        stats.dup_lines(text) / max(1, text.count(b"\n") + 1), n / max(1, text.count(b"\n") + 1) if n else 0.0, 1 - frequent[-1] / frequent.sum() if frequent.any() else 0.0, *by_language[:2], float(-(p * np.log2(p)).sum()), *(classes / chars),
    ]


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth, level by level: (trees, 2**depth - 1) tests and (trees, 2**depth) leaves."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row; every row walks all trees at once."""
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(int(self.leaf.shape[1]).bit_length() - 1):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.cut[trees, at])
        total = self.base + self.leaf[trees, at - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Forest:
    """Boost log loss over binned statistics; the best split of all nodes of a level comes from one histogram each.

    With no row, or rows of one label only, the forest answers the (smoothed) share of label 1.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    nodes, leaves = 2**depth - 1, 2**depth
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Forest(np.zeros((1, nodes), np.int64), np.full((1, nodes), np.inf), np.zeros((1, leaves)), base)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], 1)
    total = np.full(len(y), base)
    features, places, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        at, feature, cut = np.zeros(len(y), np.int64), np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = at - first
            best = np.full(width, 1e-9)
            chosen_bin = np.full(width, bins)
            for f in range(x.shape[1]):
                place = slot * bins + binned[:, f]
                gs, hs = (np.bincount(place, weights=v, minlength=width * bins).reshape(width, bins) for v in (g, h))
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                gr, hr = gs.sum(1, keepdims=True) - gl, hs.sum(1, keepdims=True) - hl
                gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (gl + gr) ** 2 / (hl + hr + 1)
                gain[(hl < LEAST) | (hr < LEAST) | (np.arange(bins - 1) >= len(cuts[f]))] = 0
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                best = np.where(better, gain[np.arange(width), top], best)
                chosen_bin = np.where(better, top, chosen_bin)
                feature[first : first + width] = np.where(better, f, feature[first : first + width])
                cut[first : first + width] = np.where(better, cuts[f][np.minimum(top, len(cuts[f]) - 1)] if len(cuts[f]) else np.inf, cut[first : first + width])
            at = 2 * at + 1 + (binned[np.arange(len(y)), feature[at]] > chosen_bin[slot])
        leaf_of = at - nodes
        gs, hs = (np.bincount(leaf_of, weights=v, minlength=leaves) for v in (g, h))
        leaf = STEP * gs / (hs + 1)
        total += leaf[leaf_of]
        features.append(feature), places.append(cut), values.append(leaf)
    return Forest(np.array(features), np.array(places), np.array(values), base)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_LESSONS, text: str = "text", id: str = "doc_id") -> Forest:
    """Fit a forest on at most ``most`` labelled documents; the statistics are taken where the rows are.

    Which documents, and what null or repeated ids and labels do, is ``labelled.lessons``'s to say. Null texts count as empty. Lessons go in order of
    their ids and splits of equal gain to the earlier statistic and cut, so runs agree. Without lessons, or with one label only, all texts score alike.
    """

    def work():
        common = stats.CommonWords()
        return lambda rows: [pa.array([statistics(t, common) for t in rows], pa.list_(pa.float64()))]

    made = texts.with_columns(labelled.lessons(docs, labels, label, most, text, id), work, "x array<double>", "text", drop_text=True).toPandas()
    made = made.sort_values("id", kind="stable")
    x = np.array(made["x"].tolist(), float).reshape(len(made), len(STATISTICS))
    return fit(x, made["label"].to_numpy(float))


def score(docs: DataFrame, forest: Forest, cut: float = CUT, text: str = "text", drop_text: bool = False) -> DataFrame:
    """Append ``score`` (0 to 1) and ``predicted`` (1 if score >= cut) to documents; a null text scores as empty.

    Only the text has a say. Equal texts score alike; columns of the same names are replaced.
    """

    def work():
        common = stats.CommonWords()

        def scores(rows: list[bytes]) -> list[pa.Array]:
            found = forest.score(np.array([statistics(t, common) for t in rows]))
            return [pa.array(found), pa.array((found >= cut).astype(np.int32))]

        return scores

    return texts.with_columns(docs, work, "score double, predicted int", text, drop_text)
