"""Sharding by a minimax contiguous partition of atomic groups."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import prefix, scratch

#: Bits by which a range of group keys is split at first and at each refinement.
FIRST_BITS, MORE_BITS = 12, 8


def _block(key: Column, shift: int) -> Column:
    return F.shiftright(key, shift) if shift else key


class _Ranges:
    """Consecutive ranges of the ordered group keys with their sizes, refined only where a cut may fall.

    The driver holds at most 2**FIRST_BITS ranges and 2**MORE_BITS for each range that a cut touches, whatever
    the number of groups.
    """

    def __init__(self, groups: DataFrame, rows: list[tuple[int, int, int, int]] | None = None):
        self.groups = groups
        self.rows = self._sizes(groups, 64 - FIRST_BITS) if rows is None else rows
        self._index()

    @staticmethod
    def _sizes(groups: DataFrame, shift: int) -> list[tuple[int, int, int, int]]:
        rows = groups.groupBy(_block(F.col("key"), shift).alias("block")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        return [(r.block << shift, shift, r["size"], r.n) for r in rows]

    def _index(self) -> None:
        self.rows.sort()
        self.ends = np.cumsum([0, *(r[2] for r in self.rows)], dtype=np.int64).tolist()
        self.single = [r[3] == 1 or r[1] == 0 for r in self.rows]
        self.total = self.ends[-1]
        self.largest = max((r[2] for r, one in zip(self.rows, self.single, strict=True) if one), default=0)

    def refine(self, which: set[int]) -> None:
        by_shift: dict[int, list[int]] = {}
        for i in which:
            by_shift.setdefault(self.rows[i][1], []).append(self.rows[i][0] >> self.rows[i][1])
        made = []
        for shift, blocks in by_shift.items():
            made += self._sizes(self.groups.where(_block(F.col("key"), shift).isin(blocks)), max(0, shift - MORE_BITS))
        self.rows = [r for i, r in enumerate(self.rows) if i not in which] + made
        self._index()

    def greedy(self, capacity: int, shards: int) -> tuple[list[tuple[int, int]], set[int]]:
        """Fill shards in order up to the capacity. Gives bounds of each cut, and the ranges that leave them apart."""
        low = high = 0
        cuts, unsure = [], set()
        for _ in range(shards):
            first, last = bisect_right(self.ends, low + capacity) - 1, bisect_right(self.ends, high + capacity) - 1
            low = self.ends[first]
            high = self.ends[last] if last >= len(self.rows) or self.single[last] else high + capacity
            unsure |= {i for i in range(first, min(last + 1, len(self.rows))) if not self.single[i]} if low < high else set()
            cuts.append((low, high))
        return cuts, unsure


def smallest_capacity(ranges: _Ranges, shards: int) -> int:
    """Binary search over the capacity; each check is greedy, and refines ranges only where it cannot decide."""
    low, high = max(1, -(-ranges.total // shards)), max(1, ranges.total)
    while low < high:
        middle = (low + high) // 2
        while True:
            cuts, unsure = ranges.greedy(middle, shards)
            if cuts[-1][0] >= ranges.total or cuts[-1][1] < ranges.total:
                break
            ranges.refine(unsure)
        if cuts[-1][0] >= ranges.total:
            high = middle
        else:
            low = middle + 1
    return low


def first_keys(ranges: _Ranges, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and the key with which each shard after the first begins."""
    if not ranges.total:
        return 0, []
    capacity = smallest_capacity(ranges, shards)
    while True:
        cuts, unsure = ranges.greedy(capacity, shards)
        if not unsure:
            break
        ranges.refine(unsure)
    at = [ranges.ends.index(low) for low, _ in cuts[:-1] if low < ranges.total]
    keys = [ranges.rows[i][0] for i in at]
    giant = next((i for i, r in enumerate(ranges.rows) if ranges.single[i] and r[2] == capacity), None)
    if giant is not None and len(keys) < shards - 1:
        keys = _around(ranges, giant, capacity, shards) or keys
    return capacity, keys


def _around(ranges: _Ranges, giant: int, capacity: int, shards: int) -> list[int] | None:
    """Cuts that give a group as large as the capacity a shard of its own, and deal the others to the shards left.

    Else the greedy cut would fill few shards up to that group's size. None if a side doesn't fit its shards.
    """
    before, after = ranges.rows[:giant], ranges.rows[giant + 1 :]
    sizes = [sum(r[2] for r in part) for part in (before, after)]
    if not sum(sizes):
        return None
    first = min(shards - 1 - bool(after), max(int(bool(before)), round((shards - 1) * sizes[0] / sum(sizes))))
    keys: list[int] = []
    for part, n, begins in ((before, first, None), ([ranges.rows[giant]], 1, None if not before else ranges.rows[giant][0]), (after, shards - 1 - first, None)):
        if part and n < 1:
            return None
        if not part:
            continue
        if part is after:
            begins = after[0][0]
        top, inner = first_keys(_Ranges(ranges.groups, part), n)
        if top > capacity:
            return None
        keys += ([] if begins is None else [begins]) + inner
    return keys


def shard(docs: DataFrame, shards: int = 16, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Deal documents to shards of near equal bytes, equal texts together.

    Groups of equal texts are atomic. They are ordered by a 64-bit hash of the text, and cut into contiguous
    runs so that the largest shard is as small as that order allows. A group of that size has its shard to itself. Returns the id column, ``size`` (UTF-8
    bytes plus 1; null text: 1), ``text_crc32``, ``law`` ('bytes'), ``shard``, ``slot`` (0, 1, ... in each shard
    by id) and ``grown_shard`` (null: this law moves rows when the shard count changes).

    Null texts are one group, apart from empty ones. Rows that repeat an id keep a slot each. With fewer groups
    than shards some shards stay empty; an empty table gives no rows. Other columns are not read.
    """
    row = F.struct(F.col(text).isNull(), F.col(text))
    slim = docs.select(
        F.col(id), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text).cast("binary"), F.lit(b""))).alias("text_crc32"), F.xxhash64(row).alias("__key"),
    )
    slim = scratch.cut(slim.withColumn("__row", F.monotonically_increasing_id()), "sizes")
    groups = scratch.cut(slim.groupBy(F.col("__key").alias("key")).agg(F.sum("size").alias("size")), "groups")
    _, keys = first_keys(_Ranges(groups), shards)
    begun = F.size(F.filter(F.array(*map(F.lit, keys)), lambda k: k <= F.col("__key"))) if keys else F.lit(0)
    dealt = slim.withColumn("shard", begun.cast("int")).withColumn("__one", F.lit(1).cast("long"))
    slots = prefix.running(dealt, ["shard"], [id, "__key", "__row"], "__one", "slot")
    return slots.select(id, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
