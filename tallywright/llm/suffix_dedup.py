"""Remove byte strings that stand earlier in the corpus: suffixes are ordered by induction from a sorted sample.

The suffixes that matter are equal when their first WINDOW bytes are. Three levels pass on only what the one above left
open:

1   Anchors: in every window of WINDOW bytes the smallest hashed gram of GRAM bytes, a local minimum of the text. Equal
    windows have equal anchors at equal distances. Anchors of one gram that two documents share go on.
2   Runs: neighbouring windows with one anchor, as one tuple of the anchor's gram and the run's bytes. All windows of
    equal runs are equal; the run's first document keeps them, later ones lose them. Grams whose runs differ go on,
    with the first document of each run.
3   Suffixes: the suffix that begins at an anchor (or HALF bytes before it, for windows that begin further away) is the
    sample. Spark's external sort orders the samples; from them, the order of the suffixes that begin one, two, ...
    bytes earlier is induced level by level, through disk-backed priority queues that carry each tuple with the prefix
    it has in common with the one before it (`induction`). Windows whose common prefix reaches WINDOW are equal, and
    their first document keeps them.

Suffixes of one sample prefix of SAME bytes meet in one task, which holds QUEUE bytes of them at a time; so a gram that
many documents share is dealt by what follows it, and neither a gram, a prefix nor a class of equal windows has to fit
into memory. The dealt method sorts every suffix of a shard; here the runs of levels 1 and 2, named by two 64-bit hashes,
stand for the suffixes between anchors, as tuples for all suffixes would take many times the disk and time that there is
(see the README). Repeats within a document are found where its text is. Texts travel compressed.

Edge cases: a null text is empty; texts below WINDOW bytes lose nothing; a null id counts as the smallest id; rows that
repeat an id, with one text or several, are one owner and lose nothing to each other; of equal starts in one document the
first stays; a very long text is looked at in segments (its own bytes and about as many for its runs are held, and those
of windows in grams that it repeats); other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, arrow_folder, compressed, pieces, removed, scratch, texts_of, unpacked, written
from .induction import WINDOW, induced, tuples
from .words import BASE, BASE_INVERSE, _bytes, mix, powers

GRAM = 24
#: Window starts of a segment of a long text, bytes of segments that are looked at together, and window starts whose
#: minima are taken together; with GRAM these stay below 2^20 places.
SEGMENT, TOGETHER, BLOCK = 1 << 17, 1 << 18, 1 << 17
#: Distances of windows from their anchor fall into two halves; all windows of one half share the sample's first SAME bytes.
HALF = (WINDOW - GRAM + 2) // 2
SAME = WINDOW - HALF + 1
#: Bytes of tuples that a task's queues hold in memory, and tuples after which it finishes whole groups.
QUEUE, GROUPS = 32 << 20, 1 << 16
TUPLE = tuples(HALF - 1)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
SAMPLE = "doc_id long, run long, half int, low int, left binary, suffix binary"


def segments(raw: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, place, bytes) of all windows' texts, long texts in overlapping segments, about TOGETHER bytes at a time."""
    group, size = [], 0
    for i, x in enumerate(raw):
        for at in range(0, len(x) - WINDOW + 1, SEGMENT):
            part = x[at : at + SEGMENT + WINDOW - 1]
            if group and size + len(part) > TOGETHER:
                yield group
                group, size = [], 0
            group.append((i, at, part))
            size += len(part)
    if group:
        yield group


class Texts:
    """Bytes of some segments in a row, a byte between two of them, with hashes of any of their strings."""

    def __init__(self, group: list[tuple[int, int, bytes]]):
        self.text = np.array([i for i, _, _ in group], np.int64)
        self.place = np.array([at for _, at, _ in group], np.int64)
        self.bounds = np.cumsum([0] + [len(x) + 1 for _, _, x in group])
        self.data = np.frombuffer(b"\0".join([*(x for _, _, x in group), b""]), np.uint8)
        self.total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_bytes[self.data] * powers(BASE, len(self.data)), out=self.total[1:])
        self.back = powers(BASE_INVERSE, len(self.data) + 1)

    def hashes(self, starts, ends) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.back[starts])

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """All starts of windows that lie in one text, and the place of each one's smallest gram (the first of equals)."""
        n = len(self.data) - WINDOW + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        grams = (self.total[GRAM:] - self.total[:-GRAM]) * self.back[: len(self.data) - GRAM + 1]
        grams *= np.uint64(0xD6E8FEB86659FD93)
        width, low = WINDOW - GRAM + 1, np.uint64((1 << 20) - 1)
        anchor = np.empty(n, np.int64)
        for at in range(0, n, BLOCK):
            part = grams[at : min(n, at + BLOCK) + width - 1]
            least = (part & ~low) | np.arange(len(part), dtype=np.uint64)
            span = 1
            while span * 2 <= width:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            if span < width:
                least = np.minimum(least[: -(width - span)], least[width - span :])
            anchor[at : at + len(least)] = (least & low).astype(np.int64) + at
        inside = np.ones(n, bool)
        for start, end in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist()):
            inside[max(start, end - WINDOW) : end] = False
        starts = np.flatnonzero(inside)
        return starts, anchor[starts]

    def runs(self) -> dict[str, np.ndarray]:
        """Neighbouring windows with one anchor: text, first and last start and anchor in that text, names of gram and run."""
        starts, anchor = self.anchors()
        if not len(starts):
            return {k: np.empty(0, np.int64) for k in RUNS}
        new = np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(starts) != 1)])
        first = starts[new]
        last = starts[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])]
        at = anchor[new]
        of = np.searchsorted(self.bounds, first, "right") - 1
        move = self.place[of] - self.bounds[of]
        return {
            "text": self.text[of],
            "first": first + move,
            "last": last + move,
            "at": at + move,
            "gram": self.hashes(at, at + GRAM).view(np.int64),
            "run": mix(self.hashes(first, last + WINDOW) + (at - first).astype(np.uint64) * np.uint64(BASE)).view(np.int64),
        }

    def windows(self, text: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of these runs, as far as their windows lie here: each window's run, start in its text, and name."""
        of, start, name = [np.empty(0, np.int64)] * 3
        for i in range(len(self.text)):
            low, high = self.place[i], self.place[i] + self.bounds[i + 1] - self.bounds[i] - 1 - WINDOW
            own = np.flatnonzero((text == self.text[i]) & (first >= low) & (last <= high))
            sizes = (last - first + 1)[own]
            at = np.repeat(first[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            here = at - low + self.bounds[i]
            of, start, name = np.concatenate([of, np.repeat(own, sizes)]), np.concatenate([start, at]), np.concatenate([name, self.hashes(here, here + WINDOW).view(np.int64)])
        return of, start, name


RUNS = ("text", "first", "last", "at", "gram", "run")


def runs_of(raw: list[bytes]) -> dict[str, np.ndarray]:
    """Runs of all texts, in order of text and place."""
    found = [Texts(group).runs() for group in segments(raw)]
    return {k: np.concatenate([np.empty(0, np.int64), *(x[k] for x in found)]) for k in RUNS}


def repeated(*keys: np.ndarray) -> np.ndarray:
    """Which rows have a row with the same keys before them."""
    out = np.zeros(len(keys[0]), bool)
    if len(out):
        order = np.lexsort(keys[::-1])
        same = np.ones(len(order) - 1, bool)
        for k in keys:
            same &= k[order][1:] == k[order][:-1]
        out[order[1:][same]] = True  # lexsort is stable
    return out


def shared_among(owner: np.ndarray, gram: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Runs of a text whose gram has another run in that text."""
    order = np.lexsort((run, gram, owner))
    o, g, r = owner[order], gram[order], run[order]
    edge = np.concatenate([[True], (o[1:] != o[:-1]) | (g[1:] != g[:-1])]) if len(o) else np.empty(0, bool)
    group = np.cumsum(edge) - 1
    changes = np.zeros(group[-1] + 1 if len(group) else 0, bool)
    changes[group[1:][(r[1:] != r[:-1]) & ~edge[1:]]] = True
    out = np.zeros(len(owner), bool)
    out[order] = changes[group]
    return out


def member(texts: np.ndarray, values: np.ndarray, lists: list) -> np.ndarray:
    """Whether each value is in its text's list."""
    sizes = [len(x) if x else 0 for x in lists]
    if not sum(sizes) or not len(values):
        return np.zeros(len(values), bool)
    owner = np.concatenate([np.repeat(np.arange(len(lists)), sizes), texts])
    value = np.concatenate([*(np.asarray(x, np.int64) for x in lists if x), values])
    order = np.lexsort((value, owner))
    new = (owner[order][1:] != owner[order][:-1]) | (value[order][1:] != value[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.concatenate([[0], np.cumsum(new)])
    held = np.zeros(len(order), bool)
    held[group[: sum(sizes)]] = True
    return held[group[sum(sizes) :]]


def samples(raw: list[bytes], runs: dict[str, np.ndarray], picked: np.ndarray) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(run's place, half, least distance in it, bytes on the left, nearest last, and the sampled suffix) of the picked runs."""
    for i in picked.tolist():
        text, at = raw[runs["text"][i]], int(runs["at"][i])
        near, far = at - int(runs["last"][i]), at - int(runs["first"][i])
        for half in (0, 1):
            low, high = max(near - half * HALF, 0), min(far - half * HALF, HALF - 1)
            if low <= high:
                start = at - half * HALF
                yield i, half, low, text[start - high : start], text[start : start - low + WINDOW]


def tuples_of(table: pa.RecordBatch, group: int, before: tuple | None) -> tuple[np.ndarray, int, tuple]:
    """Sorted samples as tuples; group: of the sample before them, (half, length, suffix) of which is before."""
    n = table.num_rows
    out = np.zeros(n, TUPLE)
    for name, column in (("doc", "doc_id"), ("run", "run"), ("half", "half"), ("low", "low")):
        out[name] = table.column(column).to_numpy()

    def matrix(column: str, width: int, flip: bool) -> tuple[np.ndarray, np.ndarray]:
        values = table.column(column).to_pylist()
        sizes = np.array([len(x) for x in values], np.int64)
        flat = np.frombuffer(b"".join(x[::-1] for x in values) if flip else b"".join(values), np.uint8)
        held = np.zeros((n, width), np.uint8)
        held[np.arange(width) < sizes[:, None]] = flat
        return held, sizes

    out["left"], high = matrix("left", HALF - 1, True)
    out["high"] = high
    suffix, sizes = matrix("suffix", WINDOW, False)
    if before is None:
        before = (-1, 0, np.zeros(WINDOW, np.uint8))
    above = np.vstack([before[2][None], suffix[:-1]])
    shorter = np.minimum(sizes, np.concatenate([[before[1]], sizes[:-1]]))
    unlike = above != suffix
    common = np.minimum(np.where(unlike.any(1), unlike.argmax(1), WINDOW), shorter)
    new = (common < SAME) | (out["half"] != np.concatenate([[before[0]], out["half"][:-1].astype(np.int64)]))
    out["lcp"] = np.where(new, 0, common)
    groups = group + np.cumsum(new)
    out["key"] = groups.astype(np.uint64) << np.uint64(8)
    return out, int(groups[-1]), (int(out["half"][-1]), int(sizes[-1]), suffix[-1])


def lost_windows(tables: Iterator[pa.RecordBatch], folder: str, limit: int = QUEUE, groups: int = GROUPS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(members, distances as bits) of windows that an earlier document has, from samples in order of half and suffix."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def joined():
        members = np.concatenate([m for m, _ in held])
        bits = np.concatenate([b for _, b in held])
        order = np.lexsort((members["half"], members["run"], members["doc"]))
        members, bits = members[order], bits[order]
        new = np.concatenate([[True], (members["doc"][1:] != members["doc"][:-1]) | (members["run"][1:] != members["run"][:-1]) | (members["half"][1:] != members["half"][:-1])])
        return members[new], np.bitwise_or.reduceat(bits, np.flatnonzero(new))

    for blocks in whole_groups(tables, groups):
        for distance, lost in induced(blocks, HALF, limit, folder):
            if len(lost):
                held.append((lost, np.full(len(lost), 1 << distance, np.int64)))
                count += len(lost)
                if count > 1 << 19:
                    yield joined()
                    held, count = [], 0
    if held:
        yield joined()


def whole_groups(tables: Iterator[pa.RecordBatch], least: int) -> Iterator[Iterator[np.ndarray]]:
    """Streams of tuples, each of so many or more and of whole groups; the next one begins when the last has been read."""
    state: dict = {"group": 0, "before": None, "rest": None, "over": False}

    def blocks():
        count = 0
        while True:
            block = state["rest"]
            state["rest"] = None
            if block is None:
                table = next(tables, None)
                if table is None:
                    state["over"] = True
                    return
                if not table.num_rows:
                    continue
                block, state["group"], state["before"] = tuples_of(table, state["group"], state["before"])
            if count >= least:
                new = np.flatnonzero(block["key"] != state["last"])
                if len(new):
                    state["rest"] = block[new[0] :]
                    if new[0]:
                        yield block[: new[0]]
                    return
            count += len(block)
            state["last"] = block["key"][-1]
            yield block

    while not state["over"]:
        yield blocks()


def removal(raw: list[bytes], later_runs: list, later_windows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of the maximal strings to remove; of each text the names of runs, and the rows (run, half, bits), that are lost."""
    runs = runs_of(raw)
    text, first, last = runs["text"], runs["first"], runs["last"]
    gone = member(text, runs["run"], later_runs) | repeated(text, runs["run"])
    spans = [(text[gone], first[gone], last[gone] + WINDOW)]
    # windows that another document has: its rows by text and run
    rows = [(i, x["run"], x["half"], x["bits"]) for i, found in enumerate(later_windows) for x in found or ()]
    if rows:
        row_text, row_run, half, bits = (np.array(x, np.int64) for x in zip(*rows))
        order = np.lexsort((row_run, row_text))
        row_text, row_run, half, bits = row_text[order], row_run[order], half[order], bits[order]
        both = np.lexsort((np.concatenate([np.zeros(len(row_run)), np.ones(len(text))]), np.concatenate([row_run, runs["run"]]), np.concatenate([row_text, text])))
        # each run takes the rows of its name, which stand before it
        place = np.empty(len(both), np.int64)
        place[both] = np.cumsum(both < len(row_run))
        up_to = place[len(row_run) :]
        for back in (1, 2):  # two halves at most
            i = np.flatnonzero(up_to >= back)
            j = up_to[i] - back
            same = (row_text[j] == text[i]) & (row_run[j] == runs["run"][i])
            i, j = i[same], j[same]
            on = np.unpackbits(bits[j].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :HALF]
            k, bit = np.nonzero(on)
            start = runs["at"][i[k]] - half[j[k]] * HALF - bit
            spans.append((text[i[k]], start, start + WINDOW))
    # windows of its own: in grams that have another run in the text
    unlike = shared_among(text, runs["gram"], runs["run"])
    if unlike.any():
        at = np.flatnonzero(unlike)
        wanted = set(text[at].tolist())
        found = [(Texts(g).windows(text[at], first[at], last[at])) for g in segments(raw) if any(i in wanted for i, _, _ in g)]
        of, start, name = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((start, text[at[of]]))
        of, start, name = at[of[order]], start[order], name[order]
        lost = repeated(text[of], runs["gram"][of], name)
        spans.append((text[of[lost]], start[lost], start[lost] + WINDOW))
    text, start, end = (np.concatenate(x) for x in zip(*spans))
    order = np.lexsort((start, text))
    text, start, end = text[order], start[order], end[order]
    if not len(text):
        return text, start, end
    longest = max(map(len, raw)) + 1  # spans that overlap or touch become one; texts follow each other without touching
    reach = np.maximum.accumulate(end + text * longest)
    new = np.concatenate([[True], start[1:] + text[1:] * longest > reach[:-1]])
    return text[new], start[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(text) - 1]])] - text[new] * longest


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: bytes, removed bytes and spans, SHA-256 of what is left, and the spans themselves."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "suffixes")
    # rows that share an id stay apart by their texts; rows with one id and text are alike
    texts = texts_of(docs, id_col, text_col).withColumn("row", F.xxhash64("text"))
    row, queues = ["doc_id", "row"], f"{arrow_folder(spark, folder)}/queues"

    def to_runs(batches):
        for batch in batches:
            for part, chunk in pieces(batch):
                runs = runs_of([t.encode() for t in chunk])
                kept = ~repeated(runs["text"], runs["run"])
                ids, rows = (part.column(i).to_numpy()[runs["text"][kept]] for i in (0, 2))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(rows), pa.array(runs["gram"][kept]), pa.array(runs["run"][kept])], names=["doc_id", "row", "gram", "run"])

    def to_samples(batches):
        for batch in batches:
            for part, raw in unpacked(batch):
                runs = runs_of(raw)
                picked = np.flatnonzero(member(runs["text"], runs["run"], part.column(2).to_pylist()) & ~repeated(runs["text"], runs["run"]))
                place, half, low, left, suffix = zip(*found) if (found := list(samples(raw, runs, picked))) else [()] * 5
                place = np.array(place, np.int64)
                ids = part.column(0).to_numpy()[runs["text"][place]]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(runs["run"][place]), pa.array(half, pa.int32()), pa.array(low, pa.int32()), pa.array(left, pa.binary()), pa.array(suffix, pa.binary())], names=[x.split()[0] for x in SAMPLE.split(", ")])

    def to_lost(batches):
        for members, bits in lost_windows(batches, queues):
            yield pa.RecordBatch.from_arrays([pa.array(members["doc"]), pa.array(members["run"]), pa.array(members["half"].astype(np.int32)), pa.array(bits)], names=["doc_id", "run", "half", "bits"])

    def to_result(batches):
        for batch in batches:
            for part, raw in unpacked(batch):
                text, starts, ends = removal(raw, part.column(2).to_pylist(), part.column(3).to_pylist())
                rows, at = [], np.searchsorted(text, np.arange(len(raw) + 1))
                for i, x in enumerate(raw):
                    spans = list(zip(starts[at[i] : at[i + 1]].tolist(), ends[at[i] : at[i + 1]].tolist()))
                    left = hashlib.sha256()
                    place = 0
                    for s, e in spans:
                        left.update(x[place:s])
                        place = e
                    left.update(x[place:])
                    rows.append((len(x), sum(e - s for s, e in spans), len(spans), left.hexdigest(), [{"start": s, "end": e} for s, e in spans]))
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), span)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    # level 1: grams that two documents share
    runs = written(texts.mapInArrow(to_runs, "doc_id long, row long, gram long, run long"), f"{folder}/runs")
    grams = runs.groupBy("gram").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("gram")
    met = written(runs.join(grams, "gram").select(*row, "gram", "run"), f"{folder}/met")
    removed(spark, f"{folder}/runs")
    # level 2: the first document of each run, and grams with several runs
    firsts = met.groupBy("gram", "run").agg(F.min(F.struct(*row)).alias("first"), F.max("doc_id").alias("last"))
    firsts = written(firsts.select("gram", "run", F.col("first.doc_id").alias("first"), F.col("first.row").alias("row"), "last"), f"{folder}/firsts")
    later = met.join(firsts.filter("first < last").drop("row"), ["gram", "run"]).filter("doc_id > first").select(*row, "run")
    several = firsts.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
    # level 3: suffixes at the anchors of those, and what is induced from them
    by_doc = firsts.join(several, "gram").groupBy(F.col("first").alias("doc_id"), "row").agg(F.collect_list("run").alias("wanted"))
    packed = texts.mapInArrow(compressed, "doc_id long, packed binary, row long")
    sampled = packed.join(by_doc, row).select("doc_id", "packed", "wanted").mapInArrow(to_samples, SAMPLE)
    sampled = sampled.withColumn("part", F.xxhash64("half", F.substring("suffix", 1, SAME))).repartition("part").sortWithinPartitions("half", "suffix").drop("part")
    lost = written(sampled.mapInArrow(to_lost, "doc_id long, run long, half int, bits long"), f"{folder}/lost")
    # lists are of one text each, however many rows share its id
    runs_lost = later.groupBy(*row).agg(F.collect_set("run").alias("runs"))
    lost = lost.groupBy("doc_id", "run", "half").agg(F.bit_or("bits").alias("bits"))
    windows_lost = lost.join(met.select(*row, "run"), ["doc_id", "run"]).groupBy(*row, "run", "half").agg(F.bit_or("bits").alias("bits"))
    windows_lost = windows_lost.groupBy(*row).agg(F.collect_list(F.struct("run", "half", "bits")).alias("windows"))
    named = packed.join(runs_lost, row, "left").join(windows_lost, row, "left").select("doc_id", "packed", "runs", "windows")
    return named.mapInArrow(to_result, RESULT).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
