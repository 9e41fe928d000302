"""Byte-level BPE: encoding in padded numpy matrices, and decoding."""

from __future__ import annotations

import base64
import heapq
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import scratch, texts

#: Widths of the matrices in bytes; a piece goes into the first that holds it.
WIDTHS = (2, 4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 128, 256, 512)
#: Cells of one matrix.
CELLS = 1 << 19
#: Pieces whose ids a Python worker remembers; with more, it starts anew.
REMEMBERED = 150_000
#: No rank.
NONE = np.iinfo(np.int32).max


def load_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks of a tiktoken file: a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of their concatenation."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        """``keys`` are distinct: the left id in the upper half of 64 bits, the right id in the lower."""
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        self.probes, slot, left = 0, self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == -1
            first = np.unique(slot[left[free]], return_index=True)[1]
            placed = left[free][first]
            self.keys[slot[placed]], self.values[slot[placed]] = keys[placed], values[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            slot[left] = slot[left] + 1 & len(self.keys) - 1
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the concatenations, NONE where there is none (or where an id is negative)."""
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1) & (left >= 0) & (right >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = slot[open_] + 1 & len(self.keys) - 1
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class Vocabulary:
    def __init__(self, content: bytes, pattern: str):
        self.ranks = load_ranks(content)
        self.split = regex.compile(pattern).findall
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values = array("q"), array("i")
        for t, n in self.ranks.items():
            for i in range(1, len(t)):
                left, right = self.ranks.get(t[:i]), self.ranks.get(t[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right), values.append(n)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(values, np.int32))
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, n in self.ranks.items():
            tokens[n] = t
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.known: dict[str, bytes] = {}

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of at most ``width`` bytes. A round merges the leftmost lowest pair of every row at once."""
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < lengths[:, None], self.single[raw], -1).astype(np.int32)
        ranks = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), width - 1)
        rows, out = np.arange(len(pieces)), [b""] * len(pieces)
        while len(rows):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
            for i in np.flatnonzero(best == NONE):  # no pair is left: the row is ready
                out[rows[i]] = ids[i, : lengths[i]].tobytes()
            going = np.flatnonzero(best != NONE)
            if not len(going):
                break
            rows, ids, ranks, at, best, lengths = rows[going], ids[going], ranks[going], at[going], best[going], lengths[going] - 1
            each, width = np.arange(len(rows)), ids.shape[1]
            ids[each, at] = best
            take = np.arange(width - 1) + (np.arange(width - 1) > at[:, None])
            ids = np.take_along_axis(ids, take, 1)
            if width == 2:
                ranks = ranks[:, :0]
                continue
            ranks = np.take_along_axis(ranks, take[:, : width - 2] if width > 2 else take, 1)
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.pairs.find(ids[before, at[before] - 1], ids[before, at[before]])
            after = np.flatnonzero(at < width - 2)
            ranks[after, at[after]] = self.pairs.find(ids[after, at[after]], ids[after, at[after] + 1])
        return out

    def _merge_long(self, piece: bytes) -> bytes:
        """The same merges in one piece that no matrix holds, by a heap: n log n steps instead of n rounds."""
        ids, n = self.single[np.frombuffer(piece, np.uint8)].tolist(), len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = lambda i: int(self.pairs.find(np.array([ids[i]]), np.array([ids[after[i]]]))[0])
        ranks = self.pairs.find(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i) for i, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)
        ranks.append(NONE)
        while heap:
            rank, i = heapq.heappop(heap)
            if ranks[i] != rank:
                continue
            j = after[i]
            ids[i], after[i], ranks[j] = rank, after[j], -1
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    ranks[k] = pair(k) if after[k] < n else NONE
                    if ranks[k] != NONE:
                        heapq.heappush(heap, (ranks[k], k))
        return np.array([t for t, r in zip(ids, ranks, strict=True) if r != -1], np.int32).tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of pieces, in one matrix for each length bucket."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        buckets: dict[int, list[str]] = {}
        for p in pieces.difference(self.known):
            raw = p.encode()
            if raw in self.ranks:
                self.known[p] = np.int32(self.ranks[raw]).tobytes()
            else:
                buckets.setdefault(next((w for w in WIDTHS if len(raw) <= w), 0), []).append(p)
        for width, own in buckets.items():
            if not width:
                self.known.update((p, self._merge_long(p.encode())) for p in own)
                continue
            step = max(1, CELLS // width)
            for i in range(0, len(own), step):
                part = own[i : i + step]
                self.known.update(zip(part, self._merge_rows([p.encode() for p in part], width), strict=True))

    def encode(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of texts, and the number of each text's ids."""
        cut = [self.split(t.decode()) for t in rows]
        self.learn(set().union(*cut) if cut else set())
        found = [b"".join(map(self.known.__getitem__, pieces)) for pieces in cut]
        return np.frombuffer(b"".join(found), np.int32), np.array([len(x) // 4 for x in found], np.int64)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of flat ids."""
        length = self.length[ids]
        ends = np.cumsum(length)
        if not len(ids):
            return np.zeros(0, np.uint8)
        return self.blob[np.repeat(self.start[ids] - ends + length, length) + np.arange(ends[-1])]


_loaded: dict[tuple[int, str], Vocabulary] = {}


def vocabulary(content: bytes, pattern: str) -> Vocabulary:
    """One vocabulary for each Python worker, kept from task to task."""
    key = hash(content), pattern
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(content, pattern)
    return _loaded[key]


def _content(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: a megabyte


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", drop_text: bool = False) -> DataFrame:
    """Append ``ids`` (array<int>): the byte-level BPE ids of whole texts by the ranks in the file ``path``.

    Each match of ``pattern`` is encoded by itself; strings of special tokens are ordinary text. A null or empty text
    has no ids. Any length of text or piece is encoded whole. A column ``ids`` of the input is replaced.
    """
    content = _content(docs, path)

    def work():
        known = vocabulary(content.value, pattern)

        def ids(rows: list[bytes]) -> list[pa.Array]:
            flat, counts = known.encode(rows)
            return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat))]

        return ids

    return texts.with_columns(docs, work, "ids array<int>", text, drop_text)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", drop_ids: bool = False) -> DataFrame:
    """Append ``decoded`` (binary): the bytes of the tokens in column ``ids``. Null ids decode to no bytes.

    The bytes need not be valid UTF-8 when ids were cut. An id outside the vocabulary is an error.
    """
    scratch.short_batches(df.sparkSession)
    content = _content(df, path)
    kept = [c for c in df.columns if c != "decoded" and not (drop_ids and c == ids)]
    out = T.StructType([*(df.schema[c] for c in kept), T.StructField("decoded", T.BinaryType())])
    sent = df.select(*(df[c] for c in kept), df[ids].alias("__ids"))

    def run(batches):
        known = vocabulary(content.value, pattern)
        for batch in batches:
            column = batch.column(len(kept))
            lists = column.fill_null([]) if column.null_count else column
            counts = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            for first, last in _runs(counts):
                a, b = counts[:first].sum(), counts[:last].sum()
                raw = known.decode(flat[a:b])
                sizes = np.add.reduceat(np.append(known.length[flat[a:b]], 0), np.minimum(np.cumsum(counts[first:last]) - counts[first:last], b - a)) * (counts[first:last] > 0)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                made = pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))])
                yield pa.RecordBatch.from_arrays([*(c.slice(first, last - first) for c in batch.columns[: len(kept)]), made], names=[*kept, "decoded"])

    return sent.mapInArrow(run, out)


def _runs(counts: np.ndarray, most: int = 1 << 20):
    """Consecutive rows with about ``most`` ids."""
    start = held = 0
    for i, n in enumerate(counts.tolist()):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(counts):
        yield start, len(counts)
