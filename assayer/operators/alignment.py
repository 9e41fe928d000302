"""Longest common subsequences: bit-parallel for one pair, and of a string with all stretches of another for many pairs at once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Hashable, Iterator, Sequence
from itertools import islice
from math import log2

import numpy as np

#: Strands of the shorter strings, and of the longer, that are combed at once, about.
CELLS, HELD = 1 << 15, 1 << 21
#: Sentences of a batch's rows that are aligned at once, about.
ALIGNED = 4096


def lcs_length(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Length of the longest common subsequence; a bit for each item of ``a``, one addition for each item of ``b``."""
    places: dict[Hashable, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        if met := places.get(y, 0) & row:
            row = (row + met | row & ~met) & full
    return len(a) - row.bit_count()


def comb(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of code rows ``a`` (pairs, m) and ``b`` (pairs, n): where the strand that leaves below each place of b entered.

    A strand enters above each place of b and left of each place of a; in a cell of equal items, or if they have crossed
    before, two strands part, else they cross. Values of m and more entered above place value - m. So of a stretch
    b[i:j] as many items are in no common subsequence with a as places below j have an entry of m + i or more. Cells of
    a diagonal don't touch one another, so each diagonal of all pairs is one step. Codes are not negative.
    """
    (n_pairs, m), n = a.shape, b.shape[1]
    kind = np.int16 if m + n < 1 << 15 and max(a.max(initial=0), b.max(initial=0)) < 1 << 15 else np.int32
    # pairs lie side by side, so that a diagonal is one run of memory; row i of a is line m - 1 - i
    left = np.repeat(np.arange(m, dtype=kind)[:, None], n_pairs, axis=1)
    above = np.repeat(np.arange(m, m + n, dtype=kind)[:, None], n_pairs, axis=1)
    turned, across = np.ascontiguousarray(a[:, ::-1].T, dtype=kind), np.ascontiguousarray(b.T, dtype=kind)
    most = min(m, n)
    other, both, ones = np.empty((most, n_pairs), kind), np.empty((most, n_pairs), kind), np.ones((most, n_pairs), kind)
    for d in range(m + n - 1):
        i0, i1 = max(0, d - n + 1), min(m, d + 1)  # rows of this diagonal; row i meets place d - i
        h, v, x, y = left[m - i1 : m - i0], above[d - i1 + 1 : d - i0 + 1], other[: i1 - i0], both[: i1 - i0]
        np.bitwise_xor(turned[m - i1 : m - i0], across[d - i1 + 1 : d - i0 + 1], out=x)
        np.minimum(x, ones[: i1 - i0], out=x)  # 0 where items are equal
        np.add(h, v, out=y)
        np.multiply(x, v, out=x)
        np.maximum(x, h, out=v)  # equal items: h goes on below; others: the later of both
        np.subtract(y, v, out=h)  # and what is left of the two to the right
    return np.ascontiguousarray(above.T)


def _codes(rows: Sequence[str], width: int, pad: int) -> np.ndarray:
    """Characters as numbers from 2 on; shorter rows end in ``pad`` (0 or 1)."""
    out = np.full((len(rows), width), pad, np.int32)
    for i, t in enumerate(rows):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.int32) + 2
    return out


def _fits(entry: np.ndarray, ms: np.ndarray, ns: np.ndarray, width: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``entry``: the first of the windows that fit best, and 100 * 2 * LCS / both lengths there.

    A row tells for each of the ``ns`` places of a longer string where its strand entered above (below 0: on the left) after a string of ``ms`` items, of
    which no window has fewer. A window is scored by the best of its stretches of so many items, or of fewer at its ends. Windows are ``width`` places every ``step``; a shorter string is one.
    """
    (n_rows, n), m = entry.shape, int(ms.max())
    held = ms[:, None]
    # places on either side that no strand enters or leaves at, so that stretches of the longest m may reach past the ends
    ins, outs = np.full((n_rows, n + 2 * m), -1, np.int32), np.full((n_rows, n + 2 * m), n + m, np.int32)
    ins[:, m : m + n] = entry
    row, at = np.nonzero(entry >= 0)
    outs[row, m + entry[row, at]] = at
    js = np.arange(1, m + 1, dtype=np.int32)
    weight = np.where(js <= held, held + js, np.inf)
    # stretches of m items: one place enters and one leaves as they go on; ``shared`` of the one from each place
    places = np.arange(n, dtype=np.int32)
    enter = np.take_along_axis(ins, m + places + held, axis=1) > places
    shared = np.empty((n_rows, n + 1), np.int32)
    shared[:, 0] = ms - ((ins[:, m : 2 * m] >= 0) & (js <= held)).sum(axis=1)
    np.cumsum((outs[:, m : m + n] < places + held).astype(np.int8) - enter, axis=1, dtype=np.int32, out=shared[:, 1:])
    shared[:, 1:] += shared[:, :1]
    best, score = np.zeros(n_rows, np.int64), np.full(n_rows, -1.0)
    for k, start in enumerate(range(0, max(n - width, 0) + 1, step)):
        own = np.flatnonzero(ns >= start + width) if k else np.arange(n_rows)
        if not len(own):
            break
        end = np.minimum(start + width, ns[own])
        heads = js - np.cumsum(ins[own, m + start : 2 * m + start] >= start, axis=1, dtype=np.int32)  # the first j places
        ends = np.take_along_axis(outs[own], m + end[:, None] - js, axis=1) < end[:, None]
        tails = js - np.cumsum(ends, axis=1, dtype=np.int32)  # the last j
        told = (2 * np.maximum(heads, tails) / weight[own]).max(axis=1)
        last = end - ms[own]
        inner = shared[own, start : int(last.max()) + 1]
        most = np.where(np.arange(start, start + inner.shape[1]) <= last[:, None], inner, 0).max(axis=1)
        told = 100.0 * np.maximum(told, most / ms[own])
        better = told > score[own]
        best[own[better]], score[own[better]] = k, told[better]
    return best, score


def _combed(pairs: Sequence[tuple[str, str]], width: int | None = None, step: int = 1):
    """(pairs, windows, scores) of pairs (shorter, longer) of strings that aren't empty, see ``_fits``; pairs of about a length go together."""
    order = sorted(range(len(pairs)), key=lambda i: (int(4 * log2(len(pairs[i][1]))), len(pairs[i][0])))
    at = 0
    while at < len(order):
        stop, m, n = at + 1, len(pairs[order[at]][0]), len(pairs[order[at]][1])
        while stop < len(order):
            wide, long = max(m, len(pairs[order[stop]][0])), max(n, len(pairs[order[stop]][1]))
            if (stop + 1 - at) * wide > CELLS or (stop + 1 - at) * long > HELD or len(pairs[order[stop]][0]) > 1.3 * len(pairs[order[at]][0]) + 8 or long > 1.5 * len(pairs[order[stop]][1]) + 64:
                break
            stop, m, n = stop + 1, wide, long
        own = order[at:stop]
        entries = comb(_codes([pairs[i][0] for i in own], m, 0), _codes([pairs[i][1] for i in own], n, 1)).astype(np.int32) - m
        yield own, *_fits(entries, *(np.array([len(pairs[i][j]) for i in own], np.int32) for j in (0, 1)), n if width is None else width, step)
        at = stop


def partial_ratios(a: Sequence[str | None], b: Sequence[str | None]) -> list[float]:
    """For each pair: the similarity (0 to 100) of the shorter with the stretch of the longer that fits it best.

    Stretches have the shorter's length, or fewer at the longer's ends; similarity is twice the longest common subsequence by both lengths.
    Of strings of one length either takes stretches of the other. Two empty strings are alike, an empty or null one is like no other.
    """
    out = [100.0 if x == "" and y == "" else 0.0 for x, y in zip(a, b, strict=True)]
    pairs, owner = [], []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x and y:
            short, long = (x, y) if len(x) <= len(y) else (y, x)
            pairs += [(short, long)] + [(long, short)] * (len(x) == len(y))
            owner += [i] * (1 + (len(x) == len(y)))
    for own, _, scores in _combed(pairs):
        for k, score in zip(own, scores.tolist(), strict=True):
            out[owner[k]] = max(out[owner[k]], score)
    return out


def most_shared(a: Counter[str], b: Counter[str]) -> int:
    """No common subsequence is longer: items that both have, by their counts."""
    return sum(min(n, b[c]) for c, n in a.items())


def best_windows(sentences: Sequence[str], texts: Sequence[str], width: int, step: int, least: float = 0.0) -> list[tuple[int, float]]:
    """For each (sentence, text): the start of the window that fits the sentence best (``partial_ratios``), and its score; the first of equal ones.

    Windows have ``width`` characters every ``step``; a shorter text is one window. A sentence is combed once with the whole
    text, and every window reads its score from that. Pairs that cannot reach ``least`` by what they share of characters
    are left out, with score 0.
    """
    out, pairs, owner, late = [(0, 0.0)] * len(sentences), [], [], []
    counted = {x: Counter(x) for x in {*sentences, *texts}} if least else {}
    for i, (s, t) in enumerate(zip(sentences, texts, strict=True)):
        if s and t:
            m = min(len(s), width, len(t))
            if least and 200.0 * most_shared(counted[s], counted[t]) < least * m:
                continue
            if len(s) < min(width, len(t)):
                pairs.append((s, t))
                owner.append(i)
            else:
                starts = range(0, len(t) - width + 1, step) if len(t) > width else [0]
                late += [(i, at, s, t[at : at + width]) for at in starts]
    for own, windows, scores in _combed(pairs, width, step):
        for k, window, score in zip(own, windows.tolist(), scores.tolist(), strict=True):
            out[owner[k]] = window * step, score
    for (i, at, _, _), score in zip(late, partial_ratios([x[2] for x in late], [x[3] for x in late]), strict=True):
        if score > out[i][1]:
            out[i] = at, score
    return out


def windows_of_rows(rows: Sequence[Sequence[str]], texts: Sequence[str], width: int, step: int, least: float = 0.0) -> Iterator[list[tuple[int, float]]]:
    """``best_windows`` of each row's sentences in its text.

    Sentences of many rows lie side by side, so that what a step costs besides its cells is shared by all of them.
    """
    at = 0
    while at < len(rows):
        stop, n = at + 1, len(rows[at])
        while stop < len(rows) and n + len(rows[stop]) <= ALIGNED:
            n, stop = n + len(rows[stop]), stop + 1
        found = iter(best_windows([s for i in range(at, stop) for s in rows[i]], [texts[i] for i in range(at, stop) for _ in rows[i]], width, step, least))
        yield from (list(islice(found, len(rows[i]))) for i in range(at, stop))
        at = stop
