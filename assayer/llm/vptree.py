"""Pairs of fingerprints within a small Hamming distance, by vantage-point trees."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Pairs whose further words are compared at once.
CHECKED = 1 << 15
#: Pairs that are compared at once, and the points from which on splitting pays.
PAIRS, SPLIT = 1 << 19, 48
#: The limit of a point that links with points of any size.
FREE = 1 << 60
#: Links that are held before they are reduced to one star for each component.
HELD = 1 << 20


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


@dataclass(frozen=True)
class Tree:
    """A complete tree: fingerprints within ``limit`` of a node's vantage point go left, others right."""

    vantage: np.ndarray
    limit: np.ndarray
    depth: int

    def route(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, leaf, at home): a point's own leaf and the later leaves that its ball of ``radius`` may reach.

        By the triangle inequality a point at distance d of the vantage point has no neighbour on the left if
        d > limit + radius, and none on the right if d <= limit - radius. Of two leaves only the earlier point
        visits the later leaf, so a pair meets once.
        """
        point, node, home = np.arange(len(points)), np.zeros(len(points), np.int64), np.ones(len(points), bool)
        for _ in range(self.depth):
            d = distance(points[point], self.vantage[node]).astype(np.int64)
            limit = self.limit[node]
            left, right = d <= limit, d > limit
            to_left = np.where(home, left, d <= limit + radius)
            to_right = np.where(home, right | (d > limit - radius), d > limit - radius)
            point, node, home = (
                np.concatenate([point[to_left], point[to_right]]),
                np.concatenate([2 * node[to_left] + 1, 2 * node[to_right] + 2]),
                np.concatenate([home[to_left], (home & right)[to_right]]),
            )
        return point, node - (2**self.depth - 1), home


def _split(points: np.ndarray, radius: int, tries: int, seed: int) -> tuple[np.uint64, int, float]:
    """A vantage point among the points and a limit, such that few points lie near the limit and halves are alike."""
    few = points if len(points) <= 512 else points[:: len(points) // 512]
    best = (points[0], 0, np.inf)
    for v in points[np.random.default_rng(seed).integers(0, len(points), tries)]:
        d = distance(few, v)
        seen = np.bincount(d, minlength=66)
        below = np.cumsum(seen)
        for limit in range(max(0, int(np.median(d)) - 2), int(np.median(d)) + 3):
            inside = below[limit] / len(d)
            near = seen[max(0, limit - radius + 1) : limit + radius + 1].sum() / len(d)
            cost = (1 + near) * max(inside, 1 - inside)
            if cost < best[2]:
                best = (v, limit, cost)
    return best


def build(sample: np.ndarray, depth: int, radius: int) -> Tree:
    """A tree from a sample of fingerprints; the sample bears on the balance of leaves alone."""
    n = 2**depth - 1
    vantage, limit, own = np.zeros(n, np.uint64), np.zeros(n, np.int64), [sample] + [sample[:0]] * (2 * n)
    for node in range(n):
        if len(own[node]):
            vantage[node], limit[node], _ = _split(own[node], radius, 8, node)
            inside = distance(own[node], vantage[node]) <= limit[node]
            own[2 * node + 1], own[2 * node + 2] = own[node][inside], own[node][~inside]
    return Tree(vantage, limit, depth)


def spanned(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of n points the smallest point that the links (a, b) connect it to, and the places of links that are enough for that."""
    label, used = np.arange(n), [np.zeros(0, np.int64)]
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = np.flatnonzero(low < high)
        if not len(apart):
            return label, np.concatenate(used)
        np.minimum.at(label, high[apart], low[apart])
        hooks = apart[label[high[apart]] == low[apart]]
        used.append(hooks[np.unique(high[hooks], return_index=True)[1]])
        while (label[label] != label).any():
            label = label[label]


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n points the smallest point that the links (a, b) connect it to."""
    return spanned(n, a, b)[0]


class Leaf:
    """Links between the home points of a leaf, and between them and its visitors.

    ``prints`` are compared within ``radius``; with ``checks`` (rows of uint64), a link also needs their distance to be
    at most ``most``. Links of points with equal ``roots`` are left out. ``a`` and ``b`` are links enough to connect the
    roots that all links connect, or all links if ``whole`` is set; ``label`` is the smallest point that a point is
    connected with, if there are no roots. With ``sizes`` and ``limits`` a link also needs the size of either point to be within the other's limit;
    points without a limit (FREE) have size 0. With ``count`` no links are held, and ``counts`` tells how many each point has (a link
    that is found from both ends counts twice).
    """

    def __init__(self, prints: np.ndarray, home: np.ndarray, radius: int, checks: np.ndarray | None = None, most: int = 0, roots: np.ndarray | None = None, whole: bool = False, sizes: np.ndarray | None = None, limits: np.ndarray | None = None, count: bool = False):
        self.sizes, self.limits, self.counts = sizes, limits, np.zeros(len(prints), np.int64) if count else None
        self.prints, self.radius, self.checks, self.most, self.roots, self.whole = prints, radius, checks, most, roots, whole
        self.own = np.arange(len(prints)) if roots is None else np.unique(roots, return_inverse=True)[1]
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.least = 0, HELD
        self.label = np.arange(len(prints))
        if limits is None:
            self._search(np.flatnonzero(home), np.arange(len(prints)), 0)
        else:
            free = limits >= FREE
            for own, other in ((home, free), (home & free, ~free), (home & ~free, ~free)):
                self._search(np.flatnonzero(own), np.flatnonzero(other), 0)
        self._reduce()
        self.a, self.b = self.links[0]

    def _reduce(self) -> None:
        none = np.zeros(0, np.int64)
        a, b = (np.concatenate(x) for x in zip(*self.links, (none, none), strict=True))
        if self.whole:
            codes = np.unique(np.minimum(a, b) * len(self.prints) + np.maximum(a, b))
            a, b = codes // max(1, len(self.prints)), codes % max(1, len(self.prints))
        else:
            self.label, used = spanned(len(self.prints), self.own[a], self.own[b])
            a, b = a[used], b[used]
        self.links, self.held = [(a, b)], len(a)
        self.least = max(HELD, 2 * len(a))

    def _add(self, a: np.ndarray, b: np.ndarray) -> None:
        if self.counts is not None:
            self.counts += np.bincount(a, minlength=len(self.counts)) + np.bincount(b, minlength=len(self.counts))
            return
        self.links.append((a, b))
        self.held += len(a)
        if self.held > self.least:
            self._reduce()

    def _linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        near = distance(self.prints[a], self.prints[b]) <= self.radius
        if self.roots is not None:
            near &= self.roots[a] != self.roots[b]
        if self.limits is not None:
            near &= (self.sizes[a] <= self.limits[b]) & (self.sizes[b] <= self.limits[a])
        if self.checks is not None:
            found, wide = np.nonzero(near), np.broadcast_arrays(a, b)
            for i in range(0, len(found[0]), CHECKED):
                at = tuple(x[i : i + CHECKED] for x in found)
                near[at] = distance(self.checks[wide[0][at]], self.checks[wide[1][at]]).sum(-1, dtype=np.int64) <= self.most
        return near

    def _compare(self, home: np.ndarray, other: np.ndarray) -> None:
        step = max(1, PAIRS // max(1, len(other)))
        for i in range(0, len(home), step):
            part = home[i : i + step]
            x, y = np.nonzero(self._linked(part[:, None], other[None, :]))
            self._add(part[x], other[y])

    def _search(self, home: np.ndarray, other: np.ndarray, depth: int) -> None:
        if self.limits is not None and len(home) and len(other):  # those whom no other's size suits have no link here
            home = home[self.limits[home] >= self.sizes[other].min()]
            other = other[self.limits[other] >= self.sizes[home].min()] if len(home) else other
        if not len(home) or not len(other):
            return
        if len(home) <= SPLIT or len(home) * len(other) <= PAIRS // 8:
            self._compare(home, other)
            return
        vantage, limit, cost = _split(self.prints[home], self.radius, 4, depth)
        if cost >= 0.97 and self.whole:
            self._compare(home, other)
            return
        if cost >= 0.97:  # a dense cluster: its members need no comparison with one another, only with the rest
            centre = home[:1]
            near = self._linked(centre, other)
            self._add(np.full(int(near.sum()), centre[0]), other[near])
            close = np.zeros(len(self.prints), bool)
            close[other[near]] = True
            close[centre] = True
            if close[home].sum() <= 1 + len(home) // 64:
                self._compare(home, other)
                return
            self._search(home[close[home]], other[~close[other]], depth + 1)
            self._search(home[~close[home]], other, depth + 1)
            return
        dh, do = distance(self.prints[home], vantage), distance(self.prints[other], vantage).astype(np.int64)
        self._search(home[dh <= limit], other[do <= limit + self.radius], depth + 1)
        self._search(home[dh > limit], other[do > limit - self.radius], depth + 1)
