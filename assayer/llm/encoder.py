"""Ids of whole texts from the tokenizers library, which is asked for each distinct piece of text once."""

from __future__ import annotations

import itertools
import json
import os
from itertools import chain

import numpy as np

#: Pieces, and ids of them, that a Python worker remembers; with more, it starts anew.
REMEMBERED = 900_000
MOST_IDS = 16 << 20
#: Pieces of one kind that go through the library in one line, if it is known which tokens end a piece.
LINE = 256
#: Bytes of a piece that are told apart in numpy, eight at a time; longer pieces are looked up one by one.
LANES = 8

#: Kinds of bytes: white space, letters a-z and A-Z, signs (without the apostrophe, which begins pieces), all others.
_SPACE, _LETTER, _SIGN, _OTHER = range(4)
_KIND = np.array([_SPACE if b in b" \t\n\x0b\x0c\r" else _LETTER if b < 128 and chr(b).isalpha() else _SIGN if 32 < b < 127 and not chr(b).isdigit() and b != 39 else _OTHER for b in range(256)], np.uint8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_ODD = np.random.default_rng(7).integers(1, 1 << 63, 2 * LANES + 2, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(31)


class _Table:
    """From 128 bits that stand for a piece to its number; open addressing, looked up and filled many at a time."""

    def __init__(self, most: int):
        self.bits = (2 * most).bit_length()
        self.first, self.second = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
        self.number = np.full(1 << self.bits, -1, np.int32)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Numbers of pieces, -1 for those that aren't known."""
        slot = (first >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.number[slot]
        open_ = np.flatnonzero((out >= 0) & ((self.first[slot] != first) | (self.second[slot] != second)))
        while len(open_):
            slot[open_] = slot[open_] + 1 & len(self.number) - 1
            at = slot[open_]
            out[open_] = self.number[at]
            open_ = open_[(out[open_] >= 0) & ((self.first[at] != first[open_]) | (self.second[at] != second[open_]))]
        return out

    def add(self, first: np.ndarray, second: np.ndarray, number: np.ndarray) -> None:
        """Distinct pieces that aren't known yet."""
        slot, left = (first >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(first))
        while len(left):
            free = left[self.number[slot[left]] < 0]
            placed = free[np.unique(slot[free], return_index=True)[1]]
            at = slot[placed]
            self.first[at], self.second[at], self.number[at] = first[placed], second[placed], number[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            slot[left] = slot[left] + 1 & len(self.number) - 1


class _Memory:
    """Ids of numbered pieces, one after another."""

    def __init__(self, kind: np.dtype):
        self.table, self.n, self.used = _Table(REMEMBERED), 0, 0
        self.start, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, kind)

    def append(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Numbers of pieces that are added, from their ids one after another and the number of each piece's ids."""
        n, used = self.n + len(counts), self.used + len(flat)
        while n > len(self.start):
            self.start, self.count = np.concatenate([self.start, self.start]), np.concatenate([self.count, self.count])
        while used > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        numbers = np.arange(self.n, n)
        self.start[numbers], self.count[numbers] = self.used + np.cumsum(counts) - counts, counts
        self.flat[self.used : used] = flat
        self.n, self.used = n, used
        return numbers


class PieceEncoder:
    """Ids of whole texts from a tokenizer for which ASCII white space always parts tokens and is dropped.

    Then a text's ids are those of its pieces, one after another: its words or, where the tokenizer parts ASCII and
    Latin-1 letters from signs, runs of either. If it takes capitals A-Z for small letters, pieces that differ in these alone are one.
    Each of these properties is tried out when a tokenizer is loaded; texts of a tokenizer without the first go through
    the library whole. A word that holds an added token goes through it whole, too. Pieces are known again by 128 bits.
    """

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, told = Tokenizer.from_str(content), json.loads(content)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.added = sorted({t["content"].encode() for t in told.get("added_tokens") or []})
        strips = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or len(t["content"].split()) != 1 for t in told.get("added_tokens") or [])
        self.by_word = not strips and self._same(["don't", "re", "3.5", "É", "á", "''", "s", "　x"], " ", "\n", "\t", "  ", "\x0b\x0c", "\r\n") and not len(self._ids([" \n"])[0])
        self.folds = self.by_word and all(np.array_equal(a, b) for a, b in zip(self._ids(["ABC", "aBİ", "İX", "ÉCole"]), self._ids(["abc", "abİ", "İx", "école"]), strict=True))
        self.parts = self.by_word and all(self._same([a, b], "") for a in ("the", "é", "s", "x", "ÿÀ") for b in (".", "!?", "|", "%%%", "-", '"', "),", "&", "\\"))
        self.parts = self.parts and all(self._same([b, a], "") for a in ("the", "é", "s", "re", "ÿÀ") for b in (".", "!?", "|", "%%%", "-", '("', "&", "\\"))
        self.ends, suffix = None, told["model"].get("end_of_word_suffix")
        if suffix and self.parts:
            self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
            self.ends[[n for t, n in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.memory = _Memory(self.type)

    def _ids(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows one after another, and each row's number of ids."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), self.type, int(counts.sum())), counts

    def _same(self, parts: list[str], *gaps: str) -> bool:
        """Whether parts have the same ids each by itself and with any of ``gaps`` between them."""
        apart, _ = self._ids(parts)
        return all(np.array_equal(apart, self._ids([g.join(parts)])[0]) for g in gaps)

    def _lines(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of letters or of signs, many to a line; the tokens that end a piece tell them apart."""
        flat, _ = self._ids([" ".join(pieces[i : i + LINE]) for i in range(0, len(pieces), LINE)])
        at = np.flatnonzero(self.ends[flat]) + 1
        if len(at) != len(pieces) or (len(at) and at[-1] != len(flat)):
            return self._ids(pieces)
        return flat, np.diff(at, prepend=0)

    def _cut(self, raw: np.ndarray, low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, odd, whole) of pieces: odd ones are not of letters or signs alone, whole ones hold an added token."""
        kind = _KIND[raw]
        if self.parts:
            lead = raw == 0xC3
            lead[:-1] &= (raw[1:] != 0x97) & (raw[1:] != 0xB7)
            kind[lead] = _LETTER
            kind[1:][lead[:-1]] = _LETTER
        fresh = np.empty(len(raw), bool)
        fresh[0] = True
        space = kind == _SPACE
        np.not_equal(space[1:], space[:-1], out=fresh[1:])
        if self.parts:
            a, b = kind[:-1], kind[1:]
            fresh[1:] |= (a + b == _LETTER + _SIGN) & (a > _SPACE) & (b > _SPACE)
        starts = offsets[:-1]
        fresh[starts[starts < len(raw)]] = True
        begin = np.flatnonzero(fresh)
        end = np.append(begin[1:], len(raw))
        word = ~space[begin]
        begin, end = begin[word], end[word]
        whole = np.zeros(len(begin), bool)
        text = low.tobytes() if self.added else b""
        for token in self.added:
            token, at = token.lower(), -1
            while (at := text.find(token, at + 1)) >= 0:
                whole[np.searchsorted(begin, at, "right") - 1] = True
        if whole.any():  # join the pieces of such a word again
            first = np.concatenate([[True], (begin[1:] != end[:-1]) | np.isin(begin[1:], starts)])
            word = np.cumsum(first) - 1
            holds = np.bincount(word, weights=whole) > 0
            keep = first | ~holds[word]
            last = np.append(keep[1:], True)
            begin, end, whole = begin[keep], end[last], holds[word][keep]
        other = np.concatenate([[0], np.cumsum(kind == _OTHER)])
        odd = (other[end] > other[begin]) | whole
        return begin, end, odd, whole

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts that lie one after another in ``raw`` (UTF-8) from offset to offset, and each text's number of ids."""
        n = len(offsets) - 1
        if not self.by_word:
            return self._ids([raw[a:b].tobytes().decode() for a, b in itertools.pairwise(offsets)])
        if not len(raw):
            return np.zeros(0, self.type), np.zeros(n, np.int64)
        low = _LOWER[raw] if self.folds else raw
        begin, end, odd, whole = self._cut(raw, low, offsets)
        if self.memory.n > REMEMBERED or self.memory.used > MOST_IDS:
            self.memory = _Memory(self.type)
        memory, size = self.memory, end - begin
        numbers = np.full(len(begin), -1, np.int64)
        short = np.flatnonzero((size <= 8 * LANES) & ~whole)
        first, second = self._keys(low, begin[short], size[short])
        numbers[short] = memory.table.find(first, second)
        new = np.flatnonzero(numbers[short] < 0)
        if len(new):
            _, at, back = np.unique(first[new], return_index=True, return_inverse=True)
            at = new[at]
            same = second[at[back]] == second[new]
            if not same.all():  # different pieces with equal first halves of their keys
                _, at, back = np.unique(np.stack([first[new], second[new]], 1), axis=0, return_index=True, return_inverse=True)
                at, back = new[at], back.reshape(-1)
            order = np.argsort(odd[short[at]], kind="stable")
            at, place = at[order], np.argsort(order)
            room = max(0, REMEMBERED - memory.n)
            made = memory.append(*self._learn(low, begin[short[at]], end[short[at]], odd[short[at]]))
            memory.table.add(first[at[:room]], second[at[:room]], made[:room])
            numbers[short[new]] = made[place[back]]
        long = np.flatnonzero(numbers < 0)
        if len(long):
            rows = [raw[a:b].tobytes() for a, b in zip(begin[long], end[long], strict=True)]
            place = {w: i for i, w in enumerate(dict.fromkeys(rows))}
            made = memory.append(*self._ids([w.decode() for w in place]))
            numbers[long] = made[[place[w] for w in rows]]
        counts = memory.count[numbers]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        flat = memory.flat[np.repeat(memory.start[numbers] - ends + counts, counts) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[np.searchsorted(begin, offsets)]
        return flat, np.diff(bounds)

    def _keys(self, low: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each piece of at most 8 * LANES bytes."""
        padded = np.concatenate([low, np.zeros(8 * LANES + 8, np.uint8)])
        words = np.ndarray((len(low) + 8 * LANES,), "<u8", padded, 0, (1,))
        first = size.astype(np.uint64) * _ODD[0]
        second = size.astype(np.uint64) * _ODD[1]
        some = slice(None)
        for k in range(LANES):
            if k:
                some = np.flatnonzero(size > 8 * k)
                if not len(some):
                    break
            left = np.minimum(size[some] - 8 * k, 8).astype(np.uint64)
            lane = words[begin[some] + 8 * k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
            first[some] += _mixed((lane ^ _ODD[2 + k]) * _ODD[2 + k])
            second[some] += lane * _ODD[2 + LANES + k]
        return _mixed(first * _ODD[1]), second

    def _learn(self, low: np.ndarray, begin: np.ndarray, end: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces; the odd ones come last."""
        rows = [low[a:b].tobytes().decode() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        if self.ends is None:
            return self._ids(rows)
        n = len(rows) - int(odd.sum())
        return tuple(np.concatenate(x) for x in zip(self._lines(rows[:n]), self._ids(rows[n:]), strict=True))


_loaded: dict[int, PieceEncoder] = {}


def encoder(content: str) -> PieceEncoder:
    """One encoder for each Python worker, kept from task to task."""
    if hash(content) not in _loaded:
        _loaded.clear()
        _loaded[hash(content)] = PieceEncoder(content)
    return _loaded[hash(content)]
