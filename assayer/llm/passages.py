"""Passages that recur: confirmed by hashes, compiled to Aho-Corasick automata, located in every document.

The work runs over shards of documents of about SHARD_BYTES, and exchanges packed arrays of 64-bit values:

1. Anchors. Of the ANCHOR-word sequences in a window of words, the one with the smallest hash is an anchor. Equal
   windows have equal anchors, so a window can recur only if its anchors do. Anchors are counted over all documents.
2. Confirmation. Each shard hashes its windows with recurring anchors; windows are counted over all shards, by hashes
   of 64 bits. One occurrence of each recurring window speaks for it, and the shards where it occurs are known.
3. Automata. The runs of recurring windows around those occurrences are the passages, cut at fixed places of a document.
   Each is made once, and a join takes it to the shards that have a window of it, however many. A shard cuts its
   passages into tiles that no window misses, and compiles the tiles with pyahocorasick.
4. Location. All documents of a shard go through its automaton, but for stretches that by a table of hashes cannot hold
   a tile. A tile's match is extended word by word along its
   passage; where a whole window matches, its words are covered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import scratch, texts

WINDOW, ANCHOR = 35, 16
#: Bytes of text in a shard, about, and bytes of text whose values share a bucket.
SHARD_BYTES, BUCKET_BYTES, LEAST_SHARDS = 4 << 20, 16 << 20, 8
#: Bytes of text whose windows are hashed at once; some 30 times as many are held for that.
AT_ONCE = 1 << 20
#: Words of a passage at most; longer ones are cut with an overlap of a window less a word.
PASSAGE = 512
#: Words of a tile, a power of two, and the bits of the table by which most stretches are known to hold none.
TILE, TABLE_BITS = 8, 22
#: Letters by which automata spell words: few, since a state searches its successors one by one.
BASE = 32
#: Words whose hashes a Python worker remembers; with more, it starts anew.
REMEMBERED = 100_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        made = self[word] = xxhash.xxh64_intdigest(word)
        return made


_hashes = _Hashes()


def _grams(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of all ANCHOR-word and ``window``-word sequences, put together from halves."""
    powers, sizes, level, size = [], [], hashes, 1
    while size <= window:
        powers.append(level), sizes.append(size)
        if len(level) <= size:
            level = level[:0]
        else:
            level = level[:-size] * _power(size) + level[size:]
        size *= 2
    anchor = powers[sizes.index(ANCHOR)]
    n, at, out = max(0, len(hashes) - window + 1), 0, None
    for level, size in zip(reversed(powers), reversed(sizes), strict=True):
        if window - at >= size:
            part = level[at : at + n]
            out = part if out is None else out * _power(size) + part
            at += size
    return _mixed(anchor), _mixed(out[:n])


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_ODD), n, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(31)


def _sliding(x: np.ndarray, width: int, choose) -> np.ndarray:
    """choose (np.minimum or np.maximum) over each ``width`` consecutive values."""
    size = 1
    level = x
    while 2 * size <= width:
        level = choose(level[:-size], level[size:])
        size *= 2
    n = len(x) - width + 1
    return choose(level[:n], level[width - size : width - size + n])


class _Slice:
    """Words of some documents in one row, with their windows and anchors."""

    def __init__(self, rows: list[bytes], window: int):
        if len(_hashes) > REMEMBERED:
            _hashes.clear()
        self.words = [t.split() for t in rows]
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.start = np.cumsum(self.n) - self.n
        flat = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(self.words)), np.uint64, int(self.n.sum()))
        self.window, self.span = window, window - ANCHOR + 1
        self.full = len(flat) >= window and bool((self.n >= window).any())
        if not self.full:
            return
        self.doc = np.repeat(np.arange(len(rows)), self.n)
        self.anchor, self.value = _grams(flat, window)
        self.whole = self.doc[: len(self.value)] == self.doc[window - 1 :]
        least = np.where(self.whole, _sliding(self.anchor, self.span, np.minimum), 0)
        pad = np.zeros(self.span - 1, np.uint64)
        covering = _sliding(np.concatenate([pad, least, pad]), self.span, np.maximum)
        self.is_anchor = covering == self.anchor

    def candidates(self, known: np.ndarray) -> np.ndarray:
        """Places of windows that hold an anchor which is ``known`` (sorted) to recur."""
        hit = np.zeros(len(self.anchor) + 1, np.int64)
        at = np.flatnonzero(self.is_anchor)
        if len(known):
            place = np.minimum(np.searchsorted(known, self.anchor[at]), len(known) - 1)
            hit[at[known[place] == self.anchor[at]] + 1] = 1
        seen = np.cumsum(hit)
        n = len(self.value)
        return np.flatnonzero((seen[self.span : self.span + n] > seen[:n]) & self.whole)


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return (values >> np.uint64(33)).astype(np.int64) % buckets


def _groups(keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(key, places) for each distinct key."""
    order = np.argsort(keys, kind="stable")
    ends = np.flatnonzero(np.diff(keys[order])) + 1
    return [(int(keys[part[0]]), part) for part in np.split(order, ends) if len(part)]


def _blobs(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> tuple[T.StructType, pa.Schema]:
    spark = T.StructType.fromDDL(ddl)
    return spark, to_arrow_schema(spark)


def _parts(table: pa.Table, text: str) -> Iterator[pa.RecordBatch]:
    for batch in table.combine_chunks().to_batches():
        yield from texts.slices(batch, pc.binary_length(batch.column(text)), AT_ONCE)


def _anchors(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """Rows (shard, values): the recurring anchors of each shard.

    A task asks about each anchor once for every few megabytes of text; one that recurs there needs no answer and its
    shards are told at once. So a passage that is everywhere doesn't fill a bucket.
    """
    schema, arrow = _arrow("bucket long, shard long, values binary, owners binary")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.slices(batch, pc.binary_length(batch.column(1))):
                own = _Slice(part.column(1).to_pylist(), window)
                if not own.full:
                    continue
                at = np.flatnonzero(own.is_anchor)
                shard = part.column(0).to_numpy()[own.doc[at]]
                order = np.lexsort((shard, own.anchor[at]))
                values, shard = own.anchor[at][order], shard[order]
                first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(values)))
                owners = np.where(n > 1, -1, shard[first])
                rows = [(b, None, values[first][i].tobytes(), owners[i].tobytes()) for b, i in _groups(_bucket(values[first], buckets))]
                many = np.repeat(n > 1, n)
                told_values, told_shard = values[many], shard[many]
                rows += [(None, s, np.unique(told_values[i]).tobytes(), None) for s, i in _groups(told_shard)]
                yield from _table(rows, arrow).to_batches()
                own = None
        texts.give_back()

    asked = scratch.cut(docs.select("__shard", "__text").mapInArrow(count, schema), "anchors")
    answer, answer_arrow = _arrow("shard long, values binary")

    def decide(rows: pa.Table) -> pa.Table:
        values, owners = _blobs(rows["values"], np.uint64), _blobs(rows["owners"], np.int64)
        _, which, times = np.unique(values, return_inverse=True, return_counts=True)
        recurs = (np.bincount(which, weights=1 + (owners < 0)) > 1)[which] & (owners >= 0)
        return _table([(s, values[recurs][i].tobytes()) for s, i in _groups(owners[recurs])], answer_arrow)

    answers = asked.where("bucket is not null").select("bucket", "values", "owners").groupBy("bucket").applyInArrow(lambda rows: texts.give_back(decide(rows)), answer)
    return answers.union(asked.where("shard is not null").select("shard", "values"))


def _confirm(docs: DataFrame, anchors: DataFrame, window: int, buckets: int) -> DataFrame:
    """Rows (shard, text): the passages that bear on each shard."""
    schema, arrow = _arrow("bucket long, shard long, key long, start int, run binary, values binary, keys binary, places binary, twice binary")

    def hash_windows(own: pa.Table, known: pa.Table) -> pa.Table:
        if not own.num_rows or not known.num_rows:
            return arrow.empty_table()
        shard = own["__shard"][0].as_py()
        sure = np.unique(_blobs(known["values"], np.uint64))
        values, keys, places, rows = [], [], [], []
        for part in _parts(own, "__text"):
            slice_ = _Slice(part.column("__text").to_pylist(), window)
            if not slice_.full:
                continue
            at, key = slice_.candidates(sure), part.column("__key").to_numpy()
            values.append(slice_.value[at]), keys.append(key[slice_.doc[at]]), places.append((at - slice_.start[slice_.doc[at]]).astype(np.int32))
            for run in np.split(at, np.flatnonzero((np.diff(at) != 1) | (np.diff(slice_.doc[at]) != 0)) + 1) if len(at) else []:
                d = slice_.doc[run[0]]
                a = int(run[0] - slice_.start[d])
                rows.append((None, shard, int(key[d]), a, b" ".join(slice_.words[d][a : a + len(run) + window - 1]), None, None, None, None))
        if rows:
            v, k, p = np.concatenate(values), np.concatenate(keys), np.concatenate(places)
            order = np.lexsort((p, k, v))
            v, k, p = v[order], k[order], p[order]
            first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            twice = (np.diff(np.append(first, len(v))) > 1).astype(np.uint8)
            v, k, p = v[first], k[first], p[first]
            rows += [(b, shard, None, None, None, v[i].tobytes(), k[i].tobytes(), p[i].tobytes(), twice[i].tobytes()) for b, i in _groups(_bucket(v, buckets))]
        return _table(rows, arrow)

    hashed = scratch.cut(docs.select("__shard", "__key", "__text").groupBy("__shard").cogroup(anchors.groupBy("shard")).applyInArrow(lambda own, known: texts.give_back(hash_windows(own, known)), schema), "windows")
    chosen, chosen_arrow = _arrow("shard long, asks boolean, keys binary, places binary")
    stride = PASSAGE - window + 1

    def decide(rows: pa.Table) -> pa.Table:
        sizes = np.array(pc.binary_length(rows["twice"]).to_pylist(), np.int64)
        v, k, p, twice = _blobs(rows["values"], np.uint64), _blobs(rows["keys"], np.int64), _blobs(rows["places"], np.int32), _blobs(rows["twice"], np.uint8)
        shard = np.repeat(rows["shard"].to_numpy(), sizes)
        order = np.lexsort((p, k, v))
        v, k, p, shard, twice = v[order], k[order], p[order], shard[order], twice[order]
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        n = np.diff(np.append(first, len(v)))
        recurs = np.add.reduceat(1 + twice.astype(np.int64), first) > 1
        speaker = first[recurs]
        rows = [(s, False, k[speaker][i].tobytes(), p[speaker][i].tobytes()) for s, i in _groups(shard[speaker])]
        heard, told = np.flatnonzero(np.repeat(recurs, n)), np.repeat(first, n)
        for s, i in _groups(shard[heard]):
            rows.append((s, True, *(x.tobytes() for x in _distinct(k[told[heard[i]]], p[told[heard[i]]] // stride))))
        return _table(rows, chosen_arrow)

    decided = scratch.cut(hashed.where("bucket is not null").select("bucket", "shard", "values", "keys", "places", "twice").groupBy("bucket").applyInArrow(lambda rows: texts.give_back(decide(rows)), chosen), "speakers")
    piece, piece_arrow = _arrow("key long, piece int, passage binary")

    def cut(runs: pa.Table, said: pa.Table) -> pa.Table:
        if not said.num_rows:
            return piece_arrow.empty_table()
        by_key: dict[int, dict[int, list[bytes]]] = {}
        for key, start, run in zip(runs["key"].to_pylist(), runs["start"].to_pylist(), runs["run"].to_pylist(), strict=True):
            by_key.setdefault(key, {}).setdefault(start, run.split())
        starts = {key: np.array(sorted(own)) for key, own in by_key.items()}
        k, p = _blobs(said["keys"], np.int64), _blobs(said["places"], np.int32)
        order = np.lexsort((p, k))
        k, p = k[order], p[order]
        breaks = np.flatnonzero((np.diff(k) != 0) | (np.diff(p) > 1) | (np.diff(p // stride) != 0)) + 1
        firsts, lasts = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(k)]]) - 1
        rows = []
        for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True):
            key = int(k[a])
            start = int(starts[key][np.searchsorted(starts[key], p[a], side="right") - 1])
            rows.append((key, int(p[a]) // stride, b" ".join(by_key[key][start][int(p[a]) - start : int(p[b]) - start + window])))
        return _table(rows, piece_arrow)

    asked, asked_arrow = _arrow("shard long, key long, piece int")

    def ask(rows: pa.Table) -> pa.Table:
        k, p = _distinct(_blobs(rows["keys"], np.int64), _blobs(rows["places"], np.int32))
        return pa.table([pa.array(np.full(len(k), rows["shard"][0].as_py())), pa.array(k), pa.array(p)], schema=asked_arrow)

    runs = hashed.where("run is not null").select("shard", "key", "start", "run")
    pieces = runs.groupBy("shard").cogroup(decided.where("not asks").groupBy("shard")).applyInArrow(lambda runs, said: texts.give_back(cut(runs, said)), piece)
    asks = decided.where("asks").select("shard", "keys", "places").groupBy("shard").applyInArrow(ask, asked)
    return asks.join(pieces, ["key", "piece"]).select("shard", "passage")


def _distinct(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((places, keys))
    keys, places = keys[order], places[order]
    first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (places[1:] != places[:-1])])[: len(keys)]
    return keys[first], places[first]


class Locator:
    """An automaton over tiles of passages, and the passages to extend its matches along."""

    def __init__(self, passages: list[bytes], window: int):
        self.window, self.tile, step = window, TILE, window - TILE + 1  # each window holds a whole tile
        split = [p.split() for p in sorted(set(passages))]
        self.place: dict[bytes, int] = {}
        self.passages = [np.array([self.place.setdefault(w, len(self.place)) for w in ws], np.int64) for ws in split]
        self.letters = max(1, math.ceil(math.log(max(2, len(self.place)), BASE)))
        self.tiles: list[list[tuple[int, int]]] = []
        known: dict[tuple, int] = {}
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for n, p in enumerate(self.passages):
            spelled = self._spell(p).tolist()
            self.table[self._slots(p)[::step]] = True
            for at in range(0, len(p) - self.tile + 1, step):
                word = tuple(spelled[at * self.letters : (at + self.tile) * self.letters])
                if word not in known:
                    known[word] = len(self.tiles)
                    self.tiles.append([])
                    self.automaton.add_word(word, known[word])
                self.tiles[known[word]].append((n, at))
        if self.tiles:
            self.automaton.make_automaton()

    @staticmethod
    def _slots(ids: np.ndarray) -> np.ndarray:
        """A place in the table for each TILE words in a row."""
        level, size = (ids + 1).astype(np.uint64) * _ODD, 1
        while size < TILE:
            level = level[:-size] * _power(size) + level[size:]
            size *= 2
        return _mixed(level) >> np.uint64(64 - TABLE_BITS)

    def _spell(self, ids: np.ndarray) -> np.ndarray:
        """Each word as letters, those of different places of a word different; an unknown word has one of no tile."""
        k = np.arange(self.letters)
        return np.where(ids[:, None] < 0, BASE * self.letters, ids[:, None] // BASE**k % BASE + BASE * k).ravel()

    def covered(self, words: list[bytes]) -> np.ndarray:
        """True for words that lie in a window of a passage."""
        out = np.zeros(len(words), bool)
        if not self.tiles or len(words) < self.window:
            return out
        ids = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        hit = np.flatnonzero(self.table[self._slots(ids)])
        if not len(hit):
            return out
        near = np.zeros(len(ids), bool)
        for k in range(self.tile):
            near[hit + k] = True
        at_word = np.flatnonzero(near)  # the automaton reads the stretches that may hold tiles, with a break between two
        breaks = np.flatnonzero(np.diff(at_word) > 1) + 1
        read, at_word = np.insert(ids[at_word], breaks, -1), np.insert(at_word, breaks, -1)
        reached: dict[tuple[int, int], int] = {}
        for end, tile in self.automaton.iter(tuple(self._spell(read).tolist())):
            at = int(at_word[(end + 1) // self.letters - 1]) + 1 - self.tile
            for n, place in self.tiles[tile]:
                if reached.get((n, at - place), -1) >= at + self.tile:
                    continue
                passage = self.passages[n]
                after = min(len(ids) - at, len(passage) - place)
                apart = np.flatnonzero(ids[at : at + after] != passage[place : place + after])
                right = at + (int(apart[0]) if len(apart) else after)
                before = min(at, place)
                apart = np.flatnonzero(ids[at - before : at] != passage[place - before : place])
                left = at - before + (int(apart[-1]) + 1 if len(apart) else 0)
                reached[n, at - place] = right
                if right - left >= self.window:
                    out[left:right] = True
        return out


def _keyed(docs: DataFrame, text: str) -> tuple[DataFrame, Column]:
    """Documents, and a hash of each row that differs between equal rows and is the same whenever the rows are read.

    Rows of files are told apart by their place there; other rows are written first.
    """
    try:
        docs.select("_metadata.row_index")
        place = F.struct("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        docs = scratch.cut(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
        place = F.col("__row")
    return docs, F.xxhash64(place, F.col(text))


def remove(docs: DataFrame, window: int = WINDOW, text: str = "text", drop_text: bool = False) -> DataFrame:
    """Append ``n_words``, ``n_removed`` and ``kept`` (string) to documents.

    A word is removed if it lies in ``window`` consecutive words of one document whose sequence also starts anywhere
    else, in another document or the same. All windows are judged on the input. ``kept`` has the other words, joined by
    one space; words are runs of anything but the six ASCII white-space characters. Null texts have no words. Rows that
    repeat an id and a text are occurrences of their own, dealt to different shards. Shorter texts than a window keep all words. An empty table
    gives no rows. Columns of the same names are replaced. ``window`` is at least 2 * ANCHOR - 1 words.
    """
    if window < 2 * ANCHOR - 1:
        raise ValueError(f"windows have at least {2 * ANCHOR - 1} words")
    scratch.short_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards, buckets = max(LEAST_SHARDS, -(-size // SHARD_BYTES)), max(LEAST_SHARDS, -(-size // BUCKET_BYTES))
    added = T.StructType.fromDDL("n_words long, n_removed long, kept string")
    kept = [c for c in docs.columns if c not in added.names and not (drop_text and c == text)]
    docs, key = _keyed(docs, text)
    shard = F.pmod(key, F.lit(shards)).alias("__shard")
    slim = docs.select(shard, key.alias("__key"), texts.utf8(docs, text).alias("__text"))
    passages = scratch.cut(_confirm(slim, _anchors(slim, window, buckets), window, buckets), "passages")
    # a text that stays is sent once; its bytes go along only where they aren't UTF-8
    spare = F.is_valid_utf8(text) if text in kept and isinstance(docs.schema[text].dataType, T.StringType) else F.lit(text in kept)
    keyed = docs.select(*(docs[c] for c in kept), shard, F.when(~F.coalesce(spare, F.lit(True)), texts.utf8(docs, text)).alias("__text"))
    schema = T.StructType([*(keyed.schema[c] for c in kept), *added.fields])
    arrow = to_arrow_schema(schema)

    def locate(own: pa.Table, known: pa.Table) -> pa.Table:
        if not own.num_rows:
            return arrow.empty_table()
        _hashes.clear()
        locator = Locator(known["passage"].to_pylist(), window)
        n_words, n_removed, left = [], [], []
        sent = own["__text"] if text not in kept else pc.coalesce(own["__text"], own[text].cast(own["__text"].type))
        for raw in pc.fill_null(sent, b"").to_pylist():
            words = raw.split()
            gone = locator.covered(words)
            n_words.append(len(words)), n_removed.append(int(gone.sum()))
            left.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if n_removed[-1] else b" ".join(words))
        made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())]
        return pa.table([*(own[c].cast(arrow.field(c).type) for c in kept), *made], schema=arrow)

    return keyed.groupBy("__shard").cogroup(passages.groupBy("shard")).applyInArrow(lambda own, known: texts.give_back(locate(own, known)), schema)
