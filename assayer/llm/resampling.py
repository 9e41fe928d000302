"""Importance resampling: documents drawn without replacement in proportion to how much more their features are a target's."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, texts

BUCKETS = 10_000
#: Rows of a sorted run, rows that one tournament merges (about), and rows that are looked at for each bound between tournaments.
RUN, RANGE, LOOKS = 1 << 16, 1 << 15, 64

#: Bytes as words see them: A-Z become a-z; digits, a-z and what isn't ASCII stay; all else parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PACKED = "range long, n long, ids array<long>, features array<long>, weights array<long>, scores array<long>, places array<long>"
_DRAWN = "id long, n_features long, weight long, score long, rank long"


def word_buckets(text: bytes, longest: int = 1, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """The buckets (crc32 modulo ``buckets``) of all runs of 1 to ``longest`` words of a text, and how many words it has."""
    words = text.translate(_FOLD).split()
    runs = [words] + [[b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] for n in range(2, longest + 1)]
    return np.array([crc32(x) for run in runs for x in run], np.uint32).astype(np.int64) % buckets, len(words)


def bucket_counts(df: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket. A task hands on one row for each bucket it has seen; the driver gets ``buckets`` numbers."""
    scratch.short_batches(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in texts.slices(batch, pa.compute.binary_length(batch.column(0))):
                for t in part.column(0).to_pylist():
                    seen += np.bincount(word_buckets(t, longest, buckets)[0], minlength=buckets)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["bucket", "n"])

    counted = df.select(texts.utf8(df, text).alias("t")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight: thousandths of the log of its share in the target over its share in the raw texts, both with one more."""
    s, t, n = raw.astype(float), target.astype(float), len(raw)
    ratio = (t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def score(docs: DataFrame, gain: np.ndarray, seed: int, text: str = "text", id: str = "doc_id", longest: int = 1) -> DataFrame:
    """(id, n_features, n_words, weight, score): the sum of gains, and with a Gumbel number that follows from seed and id."""
    buckets = len(gain)

    def work():
        def made(rows: list[bytes]) -> list[pa.Array]:
            held = [word_buckets(t, longest, buckets) for t in rows]
            sizes = [len(b) for b, _ in held]
            ends = np.concatenate([[0], np.cumsum(np.concatenate([[0], *(gain[b] for b, _ in held)]))])
            at = np.cumsum([1, *sizes])
            return [pa.array(sizes, pa.int64()), pa.array([n for _, n in held], pa.int64()), pa.array(ends[at[1:]] - ends[at[:-1]])]

        return made

    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    drawn = F.floor(-1000.0 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    told = texts.with_columns(docs.select(F.col(id).alias("id"), drawn.alias("luck"), F.col(text).alias("text")), work, "n_features long, n_words long, weight long", drop_text=True)
    return told.select("id", "n_features", "n_words", "weight", (F.col("weight") + F.col("luck")).alias("score"))


def _keys(score: list, id: list, features: list, place: list) -> list[tuple]:
    """The order of the draw: higher scores, then smaller ids (null last), then fewer features, then the place in the table."""
    return [(-s, i is None, i or 0, f, p) for s, i, f, p in zip(score, id, features, place, strict=True)]


def sorted_runs(eligible: DataFrame, bounds: list[tuple]) -> DataFrame:
    """Runs of RUN rows, each sorted and cut at ``bounds``: one row for each run and range, its columns as arrays."""
    names = ["id", "n_features", "weight", "score", "place"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def emit() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            keys = _keys(*(rows[c].to_pylist() for c in ("score", "id", "n_features", "place")))
            order = sorted(range(len(keys)), key=keys.__getitem__)
            keys, rows = [keys[i] for i in order], rows.take(order).combine_chunks()
            cuts = [0, *(bisect_left(keys, b) for b in bounds), len(keys)]
            full = [(r, a, b) for r, (a, b) in enumerate(pairwise(cuts)) if b > a]
            ends = pa.array([0, *(b for _, _, b in full)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, rows[c].combine_chunks()) for c in names]
            return pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in full], pa.int64()), pa.array([b - a for _, a, b in full], pa.int64()), *lists], names=["range", "n", "ids", "features", "weights", "scores", "places"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= RUN:
                yield emit()
                held, size = [], 0
        if size:
            yield emit()

    return eligible.select(*names).mapInArrow(runs, _PACKED)


class Tournament:
    """A tree of losers over sorted runs: each inner node keeps the loser of its match, so the next winner costs one path."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, self.size = runs, [0] * len(runs), 1
        while self.size < len(runs):
            self.size *= 2
        self.loser = [-1] * self.size
        winners = [*([-1] * self.size), *(i if i < len(runs) and runs[i] else -1 for i in range(self.size))]
        for node in range(self.size - 1, 0, -1):
            winners[node], self.loser[node] = self._match(winners[2 * node], winners[2 * node + 1])
        self.winner = winners[1]

    def _match(self, a: int, b: int) -> tuple[int, int]:
        if a < 0 or b < 0:
            return max(a, b), min(a, b)
        return (a, b) if self.runs[a][self.at[a]] < self.runs[b][self.at[b]] else (b, a)

    def draw(self, n: int) -> Iterator[tuple[int, int]]:
        """(run, place in it) of the first ``n`` rows of all runs, in order; fewer if there are no more."""
        while n > 0 and self.winner >= 0:
            run = self.winner
            yield run, self.at[run]
            n -= 1
            self.at[run] += 1
            now = run if self.at[run] < len(self.runs[run]) else -1
            node = (self.size + run) // 2
            while node:
                now, self.loser[node] = self._match(now, self.loser[node])
                node //= 2
            self.winner = now


def resample(docs: DataFrame, target: DataFrame, seed: int, share: tuple[int, int] = (10, 100), least_words: int = 20, text: str = "text", id: str = "doc_id", longest: int = 1, buckets: int = BUCKETS, rows_in_range: int = RANGE) -> DataFrame:
    """(id, n_features, weight, score, rank) of all documents; ``rank`` counts the draw from 1 and is null for those not drawn.

    Features are hashed runs of words. Of the documents with ``least_words`` words or more, floor(share) with the highest
    scores are drawn, equal scores by smaller id. Counts and weights are whole numbers, so reruns agree.
    Scored rows are written once. Each task sorts its eligible rows into runs and cuts them at bounds between ranges of the
    order; bounds come from looked-at rows and bear on balance alone. The counts of all ranges (a number for each, on the
    driver) tell which ranges the draw reaches: only these are shuffled, each is merged by a tournament of its runs that
    stops after the exact count, and the rest pass by. The order tells all rows apart, also equal ones, so a repeated
    document splits over ranges as others do.
    Null or empty texts have no features and weight 0; a null id has the noise of an empty one and comes after equal scores;
    rows that repeat an id are drawn one by one. Empty tables give no rows, an empty target no features. Ids are whole numbers.
    """
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, text, longest, buckets))
    scored = scratch.cut(score(docs, gain, seed, text, id, longest).withColumn("place", F.monotonically_increasing_id()), "scored")
    able = F.col("n_words") >= least_words
    eligible = scored.where(able)
    n = eligible.count()
    draw, ranges = n * share[0] // share[1], -(-n // rows_in_range)
    bounds: list[tuple] = []
    if ranges > 1:
        some = eligible.where(F.pmod(F.xxhash64("place"), F.lit(1 << 30)) < int(min(1.0, LOOKS * ranges / n) * (1 << 30))).select("score", "id", "n_features", "place").toArrow()
        seen = sorted(_keys(*(c.to_pylist() for c in some.columns)))
        bounds = seen[LOOKS // 2 :: LOOKS]
    runs = scratch.cut(sorted_runs(eligible, bounds), "runs")
    sizes = np.zeros(len(bounds) + 1, np.int64)
    for r in runs.groupBy("range").agg(F.sum("n").alias("n")).collect():
        sizes[r.range] = r.n
    before = np.cumsum(sizes) - sizes
    reached = int(np.searchsorted(before, draw, "left"))  # ranges that begin before the draw ends

    def merge(rows: pa.Table) -> pa.Table:
        columns = [rows[c].to_pylist() for c in ("ids", "features", "weights", "scores", "places")]
        first, out = int(before[rows["range"][0].as_py()]), []
        tournament = Tournament([_keys(s, i, f, p) for i, f, s, p in zip(columns[0], columns[1], columns[3], columns[4], strict=True)])
        for rank, (run, at) in enumerate(tournament.draw(draw - first), first + 1):
            out.append((*(c[run][at] for c in columns[:4]), rank))
        for run, at in enumerate(tournament.at):
            out += [(*values, None) for values in zip(*(c[run][at:] for c in columns[:4]), strict=True)]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["id", "n_features", "weight", "score", "rank"])

    drawn = runs.where(F.col("range") < reached).groupBy("range").applyInArrow(merge, _DRAWN)
    none = F.lit(None).cast("long").alias("rank")
    beyond = runs.where(F.col("range") >= reached).select(F.inline(F.arrays_zip("ids", "features", "weights", "scores"))).toDF("id", "n_features", "weight", "score").select("*", none)
    short = scored.where(~able).select("id", "n_features", "weight", "score", none)
    told = scratch.cut(drawn.unionByName(beyond).unionByName(short).withColumnRenamed("id", id), "drawn")
    scratch.drop(scored, runs)
    return told
