"""How filters of documents overlap, in every order of applying them: radix tries find the copies, masks are counted.

    A  under 50 words                           D  holds any of # $ % & * |
    B  100 x distinct words < 65 x words        E  identical to the text of a smaller id
    C  100 x A-Z > 5 x code points

Every document gets the set of filters that it fails, as five bits. A to D are counted where the text is read. For E,
texts go to ranges of texts: a text's range begins with its shortest prefix (of 16, 64, 256, ... code points) that no
more than a small part of all bytes shares, so a beginning that very many texts share is cut further down. A task gets
its range in order and inserts whole texts into a compressed trie, whose terminals hold the smallest id of a text and
the rows that have it; as texts come in order, all but the path to the last one is complete, is traversed and goes, so a
task holds one path, whatever its range. Copies within a block of rows are put together before the texts are dealt out: of
a text, only the rows of the smallest id travel. Then masks are counted per part, and everything else is arithmetic on
at most 32 counts of each part.

Edge cases: a null text is an empty text, which fails A; a null source is the empty one; a null id is the smallest and
has no labels; rows that share an id and a text don't fail E through each other; a document is good or toxic if any of
its labels says so; a very long text is one row of Arrow batches that are bounded in bytes; other columns are left out;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, NO_ID, bounded, pieces, scratch, written

FILTERS = "ABCDE"
#: Fixed values of the filters.
FEWEST_WORDS, DISTINCT_PCT, CAPITAL_PCT, SIGNS = 50, 65, 5, b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COPY = 1 << FILTERS.index("E")
#: Code points of the prefixes that a range may begin with, bytes of a prefix that ranges are made of, the most prefixes of
#: a length that are cut further, and bytes of texts whose copies are put together before they travel.
LENGTHS, KEY_BYTES, MOST_SHARED, BLOCK_BYTES = [16 * 4**k for k in range(14)], 48, 8192, 8 << 20
READ = "key binary, text binary, doc_id long, part string, mask int, n long"
FOUND = "doc_id long, part string, mask int, n long"


def failed(text: str, raw: bytes) -> int:
    """The filters A to D that a text fails, as bits."""
    words = raw.split()
    return (
        (len(words) < FEWEST_WORDS)
        | (100 * len(set(words)) < DISTINCT_PCT * len(words)) << 1
        | (100 * (len(raw) - len(raw.translate(None, CAPITALS))) > CAPITAL_PCT * len(text)) << 2
        | (len(raw.translate(None, SIGNS)) < len(raw)) << 3
    )


class Terminal:
    """The smallest id of one text, how many rows of each part have it, and the filters that the text fails."""

    __slots__ = ("doc_id", "parts", "mask")

    def __init__(self, doc_id: int, part: str, mask: int, n: int):
        self.doc_id, self.parts, self.mask = doc_id, {part: n}, mask

    def meet(self, doc_id: int, part: str, n: int) -> Iterator[tuple]:
        """One more record of the text; yields the rows that are copies of a smaller id."""
        if doc_id > self.doc_id:
            yield doc_id, part, self.mask | COPY, n
        elif doc_id < self.doc_id:
            yield from ((self.doc_id, p, self.mask | COPY, k) for p, k in self.parts.items())
            self.doc_id, self.parts = doc_id, {part: n}
        else:
            self.parts[part] = self.parts.get(part, 0) + n

    def rows(self) -> Iterator[tuple]:
        return ((self.doc_id, p, self.mask, k) for p, k in self.parts.items())


def common(a: bytes, b: bytes) -> int:
    """How many bytes two strings begin with in common, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    step = 16
    while low + step < high and a[low : low + step] == b[low : low + step]:
        low, step = low + step, 2 * step
    high = min(high, low + step)
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class Trie:
    """A compressed trie of texts that come in order: the path to the last text, as depths and their terminals.

    Edges are pieces of that text, between one depth and the next. What a new text leaves behind gets no more texts, so it
    is traversed and dropped.
    """

    def __init__(self) -> None:
        self.text = b""
        self.path: list[tuple[int, Terminal | None]] = [(0, None)]

    def insert(self, text: bytes, doc_id: int, part: str, mask: int, n: int) -> Iterator[tuple]:
        shared = common(self.text, text)
        yield from self.closed(shared)
        depth, terminal = self.path[-1]
        if depth < len(text):
            self.path.append((len(text), Terminal(doc_id, part, mask, n)))
        elif terminal is None:  # the root, for the empty text
            self.path[-1] = (depth, Terminal(doc_id, part, mask, n))
        else:
            yield from terminal.meet(doc_id, part, n)
        self.text = text

    def closed(self, depth: int) -> Iterator[tuple]:
        """Traverse and drop what lies deeper; an edge that reaches beyond is cut in two there."""
        cut = False
        while self.path[-1][0] > depth:
            _, terminal = self.path.pop()
            cut = True
            if terminal:
                yield from terminal.rows()
        if cut and self.path[-1][0] < depth:
            self.path.append((depth, None))

    def rest(self) -> Iterator[tuple]:
        yield from self.closed(0)
        if self.path[0][1]:
            yield from self.path[0][1].rows()


def shared_prefixes(texts: DataFrame) -> dict[int, set[int]]:
    """By length: names of the prefixes that more than one part in MOST_SHARED of all bytes shares; so few that they are shipped."""
    lengths = F.filter(F.lit(LENGTHS), lambda k: k < F.length("text"))
    weight = F.octet_length("text").cast("long")
    rows = texts.select(F.explode(F.transform(lengths, lambda k: F.struct(k.alias("length"), F.crc32(F.substring("text", F.lit(1), k).cast("binary")).alias("name")))).alias("x"), weight.alias("bytes"))
    total = texts.agg(F.coalesce(F.sum(weight), F.lit(0))).head()[0]
    hot = rows.groupBy("x").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).filter((F.col("bytes") > total // MOST_SHARED) & (F.col("n") > 1))
    out: dict[int, set[int]] = {}
    for row in hot.select("x.*").collect():  # at most MOST_SHARED for each of the 14 lengths
        out.setdefault(row["length"], set()).add(row["name"])
    return out


def masks(docs: DataFrame, folder: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, part, mask, n): the filters that rows fail, n rows alike."""
    spark = docs.sparkSession
    bounded(spark)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part"))
    hot = shared_prefixes(rows)

    def key(text: str, raw: bytes) -> bytes:
        at = 0
        while at < len(LENGTHS) and LENGTHS[at] < len(text) and LENGTHS[at] in hot and zlib.crc32(text[: LENGTHS[at]].encode()) in hot[LENGTHS[at]]:
            at += 1
        prefix = text[: LENGTHS[at]].encode() if at < len(LENGTHS) else raw
        return prefix if len(prefix) <= KEY_BYTES else prefix[:KEY_BYTES] + zlib.crc32(prefix).to_bytes(4, "big")

    def records(rows: list[tuple], schema: str, kinds: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names=[x.split()[0] for x in schema.split(", ")])

    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64())

    def read(batches):
        held: dict[bytes, tuple[bytes, Terminal]] = {}
        size = 0

        def flushed():
            out = [(k, raw, *row) for raw, (k, terminal) in held.items() for row in terminal.rows()]
            held.clear()
            part, total = [], 0
            for row in out:
                part.append(row)
                total += len(row[1])
                if total > BATCH_BYTES:
                    yield records(part, READ, (pa.binary(), pa.binary(), *kinds))
                    part, total = [], 0
            yield records(part, READ, (pa.binary(), pa.binary(), *kinds))

        for batch in batches:
            for part, texts in pieces(batch):
                copies = []
                for doc_id, text, name in zip(part.column(0).to_pylist(), texts, part.column(2).to_pylist()):
                    raw = text.encode()
                    if raw in held:
                        copies += held[raw][1].meet(doc_id, name, 1)
                    else:
                        held[raw] = key(text, raw), Terminal(doc_id, name, failed(text, raw), 1)
                        size += len(raw)
                yield records([(None, None, *row) for row in copies], READ, (pa.binary(), pa.binary(), *kinds))
                if size > BLOCK_BYTES:
                    yield from flushed()
                    size = 0
        yield from flushed()

    def traverse(batches):
        trie = Trie()
        for batch in batches:
            raws, ids, parts, bits, numbers = (batch.column(i).to_pylist() for i in range(5))
            yield records([x for row in zip(raws, ids, parts, bits, numbers) for x in trie.insert(*row)], FOUND, kinds)
        yield records(list(trie.rest()), FOUND, kinds)

    found = written(rows.mapInArrow(read, READ), f"{folder}/read")
    ranges = found.filter("text IS NOT NULL").repartitionByRange(F.col("key")).sortWithinPartitions("text")
    decided = ranges.select("text", "doc_id", "part", "mask", "n").mapInArrow(traverse, FOUND)
    return found.filter("text IS NULL").select("doc_id", "part", "mask", "n").unionByName(decided)


def orders() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, bit of the step's filter, bits of the filters before it) of all orders."""
    out = []
    for order in permutations(FILTERS):
        earlier = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            out.append(("".join(order), step, bit, earlier))
            earlier |= bit
    return out


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = docs.sparkSession
    rows = masks(docs, scratch(spark, "audit"), id_col, text_col, source_col).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    told = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = rows.join(told, "doc_id", "left")
    rows = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")))
    # what a step does depends on its filter and on which ones came before, in whatever order: 80 cases for each part
    steps = orders()
    cases = sorted({(bit, earlier) for _, _, bit, earlier in steps})
    rows = rows.withColumn("c", F.explode(F.lit([bit << 8 | earlier for bit, earlier in cases]))).withColumns({"bit": F.shiftright("c", 8), "earlier": F.col("c").bitwiseAND(255)})
    fails, passed = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) == 0
    count = lambda condition, value="n": F.sum(F.when(condition, F.col(value)).otherwise(0))
    cells = rows.groupBy("part", "bit", "earlier").agg(
        count(passed & ~fails).alias("kept"), count(passed & fails).alias("removed"), count(~passed & fails).alias("redundant"), count(F.col("mask") == F.col("bit")).alias("unique_fails"),
        count(passed & fails, "good").alias("good_lost"), count(passed & fails, "toxic").alias("toxic_lost"),
    )
    table = spark.createDataFrame(steps, "filter_order string, step int, bit int, earlier int")
    times = table.groupBy("bit", "earlier").agg(F.count("*").alias("times"))
    shapley = cells.join(F.broadcast(times), ["bit", "earlier"]).groupBy("part", "bit").agg(F.sum(F.col("removed") * F.col("times")).alias("shapley"))
    out = cells.join(shapley, ["part", "bit"]).join(F.broadcast(table), ["bit", "earlier"])  # 600 rows, whatever the data
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
