"""Order of suffixes by induction from a sorted sample, with the lengths that neighbours have in common.

A sampled suffix is a string from a sampled place on, with the bytes before it. Sorted samples come in; level by level
every suffix takes one more byte on its left: the suffixes that begin one place earlier are in order when they are dealt
by that byte, in the order that they had. Each level is a pass through a disk-backed priority queue of tuples (group,
byte), and with each tuple goes the length of the prefix that it shares with the one before it: one more than the least
length between the two in the order they had. Suffixes whose first WINDOW bytes are equal then stand side by side, with
common prefixes of WINDOW or more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from .queues import DiskQueue

WINDOW = 100
NONE = 255


def tuples(left: int) -> np.dtype:
    """Group and next byte, common prefix with the tuple before, window distances it stands for, their side, owner, run, bytes on its left (nearest first)."""
    return np.dtype([("key", np.uint64), ("lcp", np.uint8), ("low", np.uint8), ("high", np.uint8), ("half", np.uint8), ("doc", np.int64), ("run", np.int64), ("left", np.uint8, (left,))])


MEMBER = np.dtype([("key", np.uint64), ("doc", np.int64), ("run", np.int64), ("half", np.uint8)])


def range_min(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of x[low], ..., x[high], both included, of each pair."""
    out = np.empty(len(low), x.dtype)
    level = np.frexp((high - low + 1).astype(float))[1] - 1
    table, k = x, 0
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k) + 1])
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


class Level:
    """One pass: windows that begin at this distance are compared, and what goes on is dealt by the next byte."""

    def __init__(self, distance: int, queue: DiskQueue, limit: int, folder: str):
        self.distance, self.queue, self.limit, self.folder = distance, queue, limit, folder
        # of the group that the last block ended in: least common prefix since each byte was seen, and since the last window
        self.group, self.since, self.seen = None, np.full(256, NONE, np.uint8), np.zeros(256, bool)
        self.gap = 0
        self.open = self.pending()

    def pending(self) -> tuple[DiskQueue, list[int]]:
        """Members of a class that may go on in the next block, and the least of their owners."""
        return DiskQueue(self.limit, self.folder), []

    def closed(self) -> Iterator[np.ndarray]:
        """Members of the open class that have an earlier owner."""
        queue, least = self.open
        if queue.count > 1:
            first = min(least)
            for block in queue.pop():
                yield block[block["doc"] > first]
        self.open = self.pending()

    def compare(self, block: np.ndarray) -> Iterator[np.ndarray]:
        valid = np.flatnonzero(block["low"] <= self.distance)
        lcp = block["lcp"]
        if not len(valid):
            self.gap = min(self.gap, int(lcp.min()))
            return
        least = np.minimum.reduceat(lcp, np.concatenate([[0], valid[:-1] + 1]))
        least[0] = min(int(least[0]), self.gap)
        self.gap = int(lcp[valid[-1] + 1 :].min(initial=NONE))
        members = np.zeros(len(valid), MEMBER)
        for name in ("doc", "run", "half"):
            members[name] = block[name][valid]
        starts = np.flatnonzero(least < WINDOW)
        head = members[: starts[0]] if len(starts) else members
        if len(head):
            self.open[0].push(head)
            self.open[1].append(int(head["doc"].min()))
        if not len(starts):
            return
        yield from self.closed()
        inner = members[starts[0] : starts[-1]]
        if len(inner):
            at = starts[:-1] - starts[0]
            first = np.minimum.reduceat(inner["doc"], at)
            yield inner[inner["doc"] > np.repeat(first, np.diff(starts))]
        tail = members[starts[-1] :]
        self.open[0].push(tail)
        self.open[1].append(int(tail["doc"].min()))

    def induce(self, block: np.ndarray) -> None:
        lcp, group = block["lcp"], block["key"] >> np.uint64(8)
        alive = np.flatnonzero(block["high"] > self.distance)
        goes_on = self.group is not None and group[0] == self.group
        if len(alive):
            key = (group[alive] << np.uint64(8)) | block["left"][alive, self.distance]
            order = np.argsort(key, kind="stable")
            at, key = alive[order], key[order]
            same = np.concatenate([[False], key[1:] == key[:-1]])
            common = np.zeros(len(at), np.int64)
            twin = np.flatnonzero(same)
            common[twin] = range_min(lcp, at[twin - 1] + 1, at[twin]).astype(np.int64) + 1
            if goes_on:  # the first of a byte here may have one before it in an earlier block
                byte = (key & np.uint64(255)).astype(np.int64)
                first = np.flatnonzero(~same & (key >> np.uint64(8) == self.group) & self.seen[byte])
                before = np.minimum.accumulate(lcp)
                common[first] = np.minimum(self.since[byte[first]], before[at[first]]).astype(np.int64) + 1
            out = block[at]
            out["key"], out["lcp"] = key, np.minimum(common, WINDOW)
            self.queue.push(out)
        last = group[-1]
        start = int(np.searchsorted(group, last))
        if goes_on and last == self.group:
            self.since = np.minimum(self.since, lcp[start:].min())
        else:
            self.since, self.seen = np.full(256, NONE, np.uint8), np.zeros(256, bool)
        self.group = last
        own = alive[alive >= start]
        if not len(own):
            return
        behind = np.concatenate([np.minimum.accumulate(lcp[::-1])[::-1], [NONE]]).astype(np.uint8)
        byte = block["left"][own, self.distance]
        self.since[byte] = behind[own + 1]  # of equal bytes the last one counts
        self.seen[byte] = True


def induced(blocks: Iterator[np.ndarray], distances: int, limit: int, folder: str, watch: Callable | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(distance, members with an earlier owner) of windows at distances 0, 1, ..., from sorted samples (tuples in blocks, with group as key)."""
    for distance in range(distances):
        queue = DiskQueue(limit, folder)
        level = Level(distance, queue, limit, folder)
        for block in blocks:
            if watch:
                watch(distance, block)
            for lost in level.compare(block):
                yield distance, lost
            level.induce(block)
        for lost in level.closed():
            yield distance, lost
        if not queue.count:
            return
        blocks = queue.pop()
