"""Best-fit packing after dominance reduction, on counts of lengths.

All that packing needs is how many pieces there are of each length, at most `capacity` numbers however large the corpus.
On these counts, `reduce_dominated` fixes sets that provably dominate every other set with their longest piece (a piece
too long for company; a pair that fills its sequence; the longest fitting partner where only one, or only one that
matters, fits; a triple where no two partners can beat it), as in the Martello-Toth reduction. Best fit by falling
length places the rest. The plan, runs of sequences with the same make-up, is small; pieces find their place by their
rank among the pieces of their length, which tasks count on their own and a prefix sum over tasks completes.

Edge cases: a null text is empty, and is the closing id only; a document longer than the capacity is cut, however long
it is; rows that repeat an id, with one text or several, are separate documents; which of two pieces of one length comes
first doesn't matter, so ties go by the tasks' order; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pieces as slices
from .common import scratch, written
from .encode import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"


@dataclass
class Run:
    """`count` sequences alike: of each part (length, first rank, per sequence) sequence i holds the ranks from first + i * per."""

    count: int
    parts: list[tuple[int, int, int]] = field(default_factory=list)

    def used(self) -> int:
        return sum(n * per for n, _, per in self.parts)

    def cut(self, at: int) -> tuple[Run, Run]:
        return Run(at, list(self.parts)), Run(self.count - at, [(n, first + at * per, per) for n, first, per in self.parts])


class Counts:
    """How many pieces of each length are left; they are taken in rank order."""

    def __init__(self, counts: dict[int, int]):
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.taken = dict.fromkeys(self.left, 0)
        self.lengths = sorted(self.left)

    def take(self, n: int, count: int) -> int:
        first = self.taken[n]
        self.taken[n] += count
        self.left[n] -= count
        if not self.left[n]:
            del self.left[n]
            self.lengths.remove(n)
        return first

    def largest(self, most: int, without: dict[int, int] | None = None) -> int | None:
        """The largest length up to `most` with a piece left besides those in `without`."""
        i = bisect_right(self.lengths, most) - 1
        while i >= 0:
            if self.left[self.lengths[i]] > (without or {}).get(self.lengths[i], 0):
                return self.lengths[i]
            i -= 1
        return None

    def smallest(self, count: int, without: int) -> list[int]:
        """The `count` smallest pieces besides one of length `without`."""
        out: list[int] = []
        for n in self.lengths:
            out += [n] * min(count - len(out), self.left[n] - (n == without))
            if len(out) == count:
                break
        return out


def dominating(counts: Counts, longest: int, room: int) -> list[int] | None:
    """Partners of a piece of the longest length that dominate all others; None if none is proven."""
    partner = counts.largest(room, {longest: 1})
    if partner is None:
        return []
    if partner == room:
        return [partner]
    least = counts.smallest(3, longest)
    if len(least) < 2 or sum(least[:2]) > room:
        return [partner]  # at most one partner fits
    if len(least) < 3 or sum(least) > room:  # at most two partners fit
        second = counts.largest(room - partner, {longest: 1} | {partner: 1 + (partner == longest)})
        # the smaller of two partners is at most room / 2
        half = counts.largest(room // 2, {longest: 1})
        if second is not None and (half is None or second >= half):
            return [partner, second]
        if second is None and half is not None:
            # no pair holds the longest partner: it alone dominates if it is as long as any two that fit together
            best = best_pair(counts, longest, room)
            if best <= partner:
                return [partner]
    return None


def best_pair(counts: Counts, longest: int, room: int) -> int:
    """The largest sum of two partners that fit."""
    best = 0
    for n in counts.lengths:
        if counts.left[n] > (n == longest):
            other = counts.largest(min(room - n, n), {longest: 1, n: 1 + (n == longest)} if n != longest else {longest: 2})
            if other is not None:
                best = max(best, n + other)
    return best


def reduce_dominated(counts: Counts, capacity: int) -> list[Run]:
    """Fix dominating sets, from the longest length to the shortest, and again until a pass fixes none.

    A length without a proof is left for the next pass: what others take away can make its proof possible.
    """
    runs: list[Run] = []
    fixed = True
    while fixed:
        fixed = False
        for n in sorted(counts.lengths, reverse=True):
            while counts.left.get(n):
                partners = dominating(counts, n, capacity - n)
                if partners is None:
                    break
                need = {n: 1}
                for x in partners:
                    need[x] = need.get(x, 0) + 1
                # taking pieces away never makes another set fit better, so the proof holds until one of these lengths runs out
                times = min(counts.left[x] // per for x, per in need.items())
                if not partners and n + counts.lengths[0] <= capacity:
                    times = 1  # it is the last piece: copies of it would have fitted each other
                runs.append(Run(times, [(x, counts.take(x, times * per), per) for x, per in need.items()]))
                fixed = True
    return runs


def best_fit(counts: Counts, capacity: int) -> list[Run]:
    """Best fit by falling length, a length at a time: each sequence that a piece fits best is filled before the next."""
    open_runs: dict[int, list[Run]] = {}
    spaces: list[int] = []

    def put(run: Run) -> None:
        space = capacity - run.used()
        if space not in open_runs:
            open_runs[space] = []
            spaces.insert(bisect_left(spaces, space), space)
        open_runs[space].append(run)

    while counts.lengths:
        n = counts.lengths[-1]
        while counts.left.get(n):
            i = bisect_left(spaces, n)
            if i < len(spaces):
                space = spaces[i]
                run = open_runs[space].pop()
                if not open_runs[space]:
                    del open_runs[space]
                    spaces.pop(i)
            else:
                space, run = capacity, Run(-(-counts.left[n] // (capacity // n)))
            per, left = space // n, counts.left[n]
            if per > left:  # one sequence takes all that is left
                run, rest = run.cut(1)
                if rest.count:
                    put(rest)
                run.parts.append((n, counts.take(n, left), left))
            else:
                run, rest = run.cut(min(run.count, left // per))
                if rest.count:
                    put(rest)
                run.parts.append((n, counts.take(n, run.count * per), per))
            put(run)
    return [run for runs in open_runs.values() for run in runs]


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    held = Counts(counts)
    return reduce_dominated(held, capacity) + best_fit(held, capacity)


class Places:
    """(length, rank) -> (sequence, offset) by binary search among the plan's parts."""

    def __init__(self, runs: list[Run]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        at = 0
        for run in runs:
            offset = 0
            for n, first, per in run.parts:
                rows.setdefault(n, []).append((first, per, at, offset))
                offset += n * per
            at += run.count
        self.by_length = {n: np.array(sorted(x), np.int64).T for n, x in rows.items()}

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for n in np.unique(lengths).tolist():
            here = np.flatnonzero(lengths == n)
            first, per, at, start = self.by_length[n]
            i = np.searchsorted(first, ranks[here], "right") - 1
            turn = ranks[here] - first[i]
            sequence[here], offset[here] = at[i] + turn // per[i], start[i] + turn % per[i] * n
        return sequence, offset


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of every document, each with its task and its place among the task's pieces of its length."""

    def cut(batches):
        enc, task = encoder(tokenizer), TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part, texts in slices(batch):
                flat, sizes = enc.encode(texts)
                flat, end, rows = flat.astype("<u4"), 0, []
                closing = np.array([end_id], "<u4")
                for doc_id, n in zip(part.column(0).to_pylist(), sizes.tolist()):
                    ids = np.concatenate([flat[end : end + n], closing])
                    end += n
                    for k, start in enumerate(range(0, n + 1, capacity)):
                        piece = ids[start : start + capacity]
                        rows.append((doc_id, k, start, len(piece), zlib.crc32(piece), task, int(met[len(piece)])))
                        met[len(piece)] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = written(cut_documents(rows, tokenizer, capacity, end_id), f"{scratch(docs.sparkSession, 'pieces')}/pieces")
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = by_task.select("length", "task", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = Places(plan(counts, capacity))

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                sequence, offset = places.of(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
                )

    ranked = cut.join(before, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
