"""N-gram Jaccard join over an R-tree of count vectors.

Shingle hashes fall into groups by range. The number of hashes in each of POINT groups is a document's point; the sum
over coordinates of the smaller count bounds the overlap of two sets from above, for points and for the upper corners of
nodes that hold many points. The tree is spread over tasks by its first two levels: the class of the set's size, and the
content of one group of hashes. A class has more groups than two linked sets can differ in, so two linked sets agree on
one group at least and meet below one such node (see `keys_of`); nothing is lost. (Two texts of like size are about as
far apart in 256 counts as any other two, so a tree over bare counts alone would compare nearly all pairs.) Below that,
each node is an R-tree of its points: leaves of LEAF points in order of size and coarse counts, INNER nodes to a parent,
each with its upper corner. The join goes down the tree in pairs of nodes whose bound reaches the similarity; what is
left at the points is verified on the sets themselves.

Links inside a large group of near copies are many, but only components are asked for. A first round looks for one
partner of each point in its own leaf and the one before it, so its work grows with the points, and joins what verifies.
The second round joins the trees of nodes that still hold several components: points of the component that has most
points there meet those of other components only. No true link between components is lost, whatever the first round
found.

Edge cases: null texts and texts without words are empty sets, linked with nothing; equal sets are linked (a set is named
by a digest of 64 bits, and where unlike sets share that one, by a second one that doesn't depend on it, see `shared_by`;
never by the id of a row, so rows that repeat an id with the same or another text each take part and give a row each); a null id counts as the smallest id; ties of sizes go by digest, which changes work, never results;
a very long text is hashed block by block, its set of eight bytes a shingle is one value; other columns are left out; an
empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NO_ID, PIECE_CHARS, pieces, removed, scratch, texts_of, unpacked, written
from .components import components
from .words import mix, shingles, words_hashed

#: Coordinates of a point and of its coarse form, points of a leaf, nodes of an inner node, points of a page; larger nodes are split into pages.
POINT, COARSE, LEAF, INNER, PAGE = 256, 8, 32, 8, 2048
#: Groups of up to so many points are compared without a tree.
FEW = 12
ROWS = "doc_id long, mark long, n_shingles long, digest long, second long, point binary"
#: Sets that a task remembers, so as not to send the nodes of equal ones again.
REMEMBERED = 100_000
#: Bits of a second-level node's name. Nodes that share a name only cost time, so a shorter name does.
KEY = np.uint64((1 << 48) - 1)
#: The most digests that unlike sets may share: some 6 x 10^12 different sets have so many.
SHARED = 1 << 20


def size_classes(most: int = 1 << 40) -> list[int]:
    """The largest size of each class."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


CLASSES = size_classes()


def most_different(a: int, b: int, num: int, den: int) -> int:
    """The most hashes that only one of two linked sets of these sizes has: J >= num/den means |x ^ y| <= (den-num)/(den+num) (|x|+|y|)."""
    return (a + b) * (den - num) // (den + num)


def group_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Groups by range, so those of a sorted set lie in a row."""
    return ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def point_of(hashes: np.ndarray) -> bytes:
    """Counts of the POINT groups, 255 for that and more (see `reaches`)."""
    return np.minimum(np.bincount(group_of(hashes, POINT).astype(np.int64), minlength=POINT), 255).astype(np.uint8).tobytes()


def digest_of(hashes: np.ndarray, bits: int = 64) -> int:
    """Names a set, in so many bits."""
    total = mix(hashes).sum(dtype=np.uint64) ^ np.uint64(len(hashes))
    return int((total & np.uint64((1 << bits) - 1)).view(np.int64)) if len(hashes) else 0


def second_of(hashes: np.ndarray) -> int:
    """A digest that two sets of the same `digest_of` don't share for that reason."""
    return digest_of(mix(hashes) + np.uint64(0x9E3779B97F4A7C15))


def name_of(hashes: np.ndarray, shared: np.ndarray, bits: int = 64) -> int:
    """The digest of a set, or the second one if the first is among the shared (in order)."""
    digest = digest_of(hashes, bits)
    at = int(np.searchsorted(shared, digest))
    return second_of(hashes) if at < len(shared) and shared[at] == digest else digest


def shared_by(rows: DataFrame, path: str) -> tuple[DataFrame, np.ndarray]:
    """Digests that unlike sets share, as a table and, in order, for the tasks that name sets from texts.

    Of n different sets about n * n / 2^65 digests are shared: some ten of 2 x 10^10 sets.
    """
    both = rows.filter("n_shingles > 0").groupBy("digest").agg(F.min("second").alias("lo"), F.max("second").alias("hi"))
    table = written(both.filter("lo < hi").select("digest"), path)
    found = np.array(sorted(r.digest for r in table.limit(SHARED + 1).collect()), np.int64)
    if len(found) > SHARED:
        raise ValueError(f"more than {SHARED} digests are shared by unlike sets: name them in more bits")
    return table, found


def keys_of(hashes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Second-level nodes of a sorted set: (class, group, content) for its own class and those that a larger partner may have.

    A class fixes how many groups there are. A set needs the first ones only: one more than it can differ in from any
    partner in the class, and `spare` more; so two linked sets agree on spare + 1 of those that both have. If a set has
    more empty ones than `spare` among them, these may be all that they agree on, and count as well.
    """
    n = len(hashes)
    salted, out = mix(hashes), [np.empty(0, np.uint64)]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(salted, out=total[1:])
    for c in range(bisect_left(CLASSES, n), bisect_left(CLASSES, n * den // num) + 1) if n else ():
        largest = CLASSES[c]
        differ = most_different(largest, largest, num, den)
        spare = differ // 8 + 2
        first = most_different(n, min(largest, n * den // num), num, den) + 1 + spare
        starts = np.searchsorted(group_of(hashes, differ + 1 + spare), np.arange(first + 1, dtype=np.uint64))
        size = np.diff(starts)
        filled = size > 0
        if first - filled.sum() > spare:
            filled[:] = True
        place = np.arange(first, dtype=np.uint64) + np.uint64(c << 44)
        out.append((mix(mix(total[starts[1:]] - total[starts[:-1]] + size.astype(np.uint64)) + mix(place)) & KEY)[filled])
    return np.concatenate(out)


class Points:
    """Points of a table of rows in order: what the bound needs of each."""

    def __init__(self, digests: np.ndarray, sizes: np.ndarray, labels: np.ndarray, sides: np.ndarray, points: np.ndarray, num: int, den: int):
        self.digests, self.sizes, self.labels, self.sides, self.points = digests, sizes, labels, sides, points
        self.coarse = points.reshape(len(points), COARSE, POINT // COARSE).sum(2, dtype=np.int64)
        self.full = (points == 255).any(1)
        self.num, self.den = num, den

    def reaches(self, overlap, a, b):
        """Whether so much overlap reaches the similarity: den * o >= num * (a + b - o)."""
        return (self.den + self.num) * overlap >= self.num * (a + b)

    def fit(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs i, j are worth verifying; a set with a full coordinate is bounded by its size alone."""
        ok = (self.labels[i] != self.labels[j]) & (self.digests[i] != self.digests[j]) & ((self.sides[i] != self.sides[j]) | (self.sides[i] < 0))
        ok &= self.reaches(np.minimum(self.sizes[i], self.sizes[j]), self.sizes[i], self.sizes[j])
        for counts in (self.coarse, self.points):  # the coarse bound is never below the fine one
            at = np.flatnonzero(ok)
            for s in range(0, len(at), 1 << 14):
                p, q = i[at[s : s + (1 << 14)]], j[at[s : s + (1 << 14)]]
                bound = np.minimum(counts[p], counts[q]).sum(1, dtype=np.int64)
                ok[at[s : s + (1 << 14)]] = (self.full[p] | self.full[q]) | self.reaches(bound, self.sizes[p], self.sizes[q])
        return ok


class Tree:
    """R-tree over the points of one page, packed bottom up; levels[0] are the leaves."""

    def __init__(self, held: Points, start: int, end: int):
        self.held = held
        sizes, coarse = held.sizes[start:end], held.coarse[start:end]
        slab = np.argsort(np.argsort(sizes, kind="stable"), kind="stable") // (LEAF * INNER)
        self.order = np.lexsort((held.digests[start:end], coarse[:, 1], coarse[:, 0], slab, held.sides[start:end])) + start
        self.levels = [self.corners(LEAF)]
        while len(self.levels[-1][0]) > 1:
            self.levels.append(self.corners(LEAF * INNER ** len(self.levels)))

    def corners(self, width: int):
        """Of each node of so many points: upper corner, least and largest size, whether a coordinate is full, one label or side of all (or none)."""
        at, h = np.arange(0, len(self.order), width), self.held
        o = self.order

        def one(x):
            low, high = np.minimum.reduceat(x[o], at), np.maximum.reduceat(x[o], at)
            return np.where(low == high, low, -1), low == high

        return (np.maximum.reduceat(h.points[o], at), np.minimum.reduceat(h.sizes[o], at), np.maximum.reduceat(h.sizes[o], at), np.maximum.reduceat(h.full[o], at), one(h.labels), one(h.sides))

    def may_link(self, level: int, p: int, q: np.ndarray) -> np.ndarray:
        """Which nodes q may hold a point that links with one of node p."""
        corner, least, most, full, (label, same_label), (side, same_side) = self.levels[level]
        h = self.held
        small, large = np.maximum(least[p], least[q]), np.minimum(most[p], most[q])
        ok = ~(same_label[p] & same_label[q] & (label[p] == label[q])) & ~(same_side[p] & same_side[q] & (side[p] == side[q]) & (side[p] >= 0))
        # the best case: the sizes as close to each other as the nodes allow, the smaller one within the larger
        far = np.maximum(0, small - large)
        ok &= h.den * (small - far) >= h.num * small
        bound = np.minimum(corner[p], corner[q]).sum(1, dtype=np.int64)
        return ok & (full[p] | full[q] | h.reaches(bound, least[p], least[q]))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all pairs that the bounds leave."""
        out_i, out_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        stack = [(len(self.levels) - 1, 0, np.zeros(1, np.int64))]
        while stack:
            level, p, qs = stack.pop()
            qs = qs[self.may_link(level, p, qs)]
            if not len(qs):
                continue
            if level:
                children = np.unique((qs[:, None] * INNER + np.arange(INNER)).ravel())
                children = children[children < len(self.levels[level - 1][0])]
                for c in range(p * INNER, min((p + 1) * INNER, len(self.levels[level - 1][0]))):
                    stack.append((level - 1, c, children[children <= c]))
                continue
            a = self.order[p * LEAF : (p + 1) * LEAF]
            for q in qs.tolist():
                b = self.order[q * LEAF : (q + 1) * LEAF]
                i, j = (np.triu_indices(len(a), 1)) if p == q else (np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a)))
                i, j = a[i], b[j]
                ok = self.held.fit(i, j)
                out_i.append(i[ok])
                out_j.append(j[ok])
        return np.concatenate(out_i), np.concatenate(out_j)

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the pairs in one leaf, or in a leaf and the one before it, that the bounds leave."""
        out_i, out_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in range(1, min(2 * LEAF, len(self.order))):
            i, j = self.order[k:], self.order[:-k]
            at = np.arange(k, len(self.order)) // LEAF - np.arange(len(self.order) - k) // LEAF <= 1
            i, j = i[at], j[at]
            ok = self.held.fit(i, j)
            out_i.append(i[ok])
            out_j.append(j[ok])
        return np.concatenate(out_i), np.concatenate(out_j)


def candidates(table: pa.Table, star: bool, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (larger digest, smaller digest) of a table of whole pages. star: the smallest near partner of each only."""
    key, page = table.column("key").to_numpy(), table.column("page").to_numpy()
    points = np.frombuffer(b"".join(table.column("point").to_pylist()), np.uint8).reshape(-1, POINT)
    held = Points(*(table.column(c).to_numpy() for c in ("digest", "n_shingles", "label", "side")), points, num, den)
    cuts = np.concatenate([[0], np.flatnonzero((np.diff(key) != 0) | (np.diff(page) != 0)) + 1, [len(key)]])
    width = np.diff(cuts)
    group = np.repeat(np.arange(len(width)), width)
    few = np.flatnonzero(width[group] <= FEW)
    left, right = [], []
    for k in range(1, FEW):  # small pages, all at once
        i = few[few + k < len(key)]
        i = i[group[i] == group[i + k]]
        ok = held.fit(i, i + k)
        left.append(i[ok])
        right.append(i[ok] + k)
    for g in np.flatnonzero(width > FEW).tolist():
        tree = Tree(held, cuts[g], cuts[g + 1])
        i, j = tree.near() if star else tree.pairs()
        left.append(i)
        right.append(j)
    x, y = held.digests[np.concatenate(left)], held.digests[np.concatenate(right)]
    a, b = np.maximum(x, y), np.minimum(x, y)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | ((b[1:] != b[:-1]) & (not star))]) if len(a) else np.empty(0, bool)
    return a[new], b[new]


def propose(rows: DataFrame, star: bool, num: int, den: int) -> DataFrame:
    """Distinct candidate pairs (a, b), a > b, from rows (key, page, side, digest, n_shingles, point, label)."""

    def found(table):
        a, b = candidates(table.combine_chunks(), star, num, den)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def search(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            k, page = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "page"))
            change = np.flatnonzero((k != k[-1]) | (page != page[-1]))
            if len(change):  # the last page of a batch may go on in the next
                yield found(pa.Table.from_batches([*held, batch.slice(0, int(change[-1]) + 1)]))
                held = [batch.slice(int(change[-1]) + 1)]
            elif held and (held[-1].column(0)[0], held[-1].column(1)[0]) != (batch.column(0)[0], batch.column(1)[0]):
                yield found(pa.Table.from_batches(held))
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield found(pa.Table.from_batches(held))

    together = rows.select("key", "page", "side", "digest", "n_shingles", "point", "label").repartition("key", "page").sortWithinPartitions("key", "page")
    return together.mapInArrow(search, "a long, b long").distinct()


def part_of(count) -> F.Column:
    """A page's number within a node of so many points."""
    return F.pmod(F.xxhash64("digest"), F.greatest(F.lit(1), F.ceil(count / PAGE)).cast("int")).cast("int")


def chunks(met: DataFrame) -> DataFrame:
    """Pages for the first round: parts of a node, each by itself."""
    return met.select("key", part_of(F.col("members")).cast("long").alias("page"), F.lit(-1).alias("side"), "digest", F.col("digest").alias("label"))


def meetings(labelled: DataFrame) -> DataFrame:
    """Pages for the second round, of nodes with several labels: parts of the rest meet each other and those of the main label."""
    counts = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    most = F.max(F.struct("n", "label")).alias("most")
    nodes = counts.groupBy("key").agg(most, F.sum("n").alias("all"), F.count("*").alias("labels")).filter("labels > 1")
    nodes = nodes.select("key", F.col("most.label").alias("main"), F.col("most.n").alias("n_main"), (F.col("all") - F.col("most.n")).alias("n_rest"))
    rows = labelled.join(nodes, "key")
    is_main = F.col("label") == F.col("main")
    parts_main, parts_rest = (F.greatest(F.lit(1), F.ceil(F.col(c) / PAGE)).cast("int") for c in ("n_main", "n_rest"))
    part = F.when(is_main, part_of(F.col("n_main"))).otherwise(part_of(F.col("n_rest")))
    rows = rows.withColumns({"part": part, "pm": parts_main, "pr": parts_rest})

    def place(kind, x, y, side):
        return F.struct((F.lit(kind).cast("long") * (1 << 62) + x.cast("long") * F.lit(1 << 31) + y).alias("page"), side.cast("int").alias("side"))

    p = F.col("part")
    with_rest = F.transform(F.sequence(F.lit(0), F.col("pr") - 1), lambda o: place(0, F.greatest(p, o), F.least(p, o), F.when(p == o, -1).otherwise((p > o).cast("int"))))
    with_main = F.transform(F.sequence(F.lit(0), F.col("pm") - 1), lambda m: place(1, m, p, F.lit(0)))
    of_main = F.transform(F.sequence(F.lit(0), F.col("pr") - 1), lambda o: place(1, p, o, F.lit(1)))
    places = F.when(is_main, of_main).otherwise(F.concat(with_rest, with_main))
    return rows.select("key", F.explode(places).alias("m"), "digest", "label").select("key", "m.page", "m.side", "digest", "label")


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sets reach the similarity."""
    one = pairs.join(sets.select(F.col("digest").alias("a"), F.col("hashes").alias("x")), "a")
    two = one.join(sets.select(F.col("digest").alias("b"), F.col("hashes").alias("y")), "b")
    overlap = F.size(F.array_intersect("x", "y"))
    return two.filter((den + num) * overlap >= num * (F.size("x") + F.size("y"))).select("a", "b")


def linked_rows(docs: DataFrame, size: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """(doc_id, mark, n_shingles, component) of every row; mark: a hash of its text, component: a set's name, null for empty sets; bits: of a digest."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "jaccard")
    texts = texts_of(docs, id_col, text_col)

    def sets_of(chunk):
        words, sizes = words_hashed(chunk)
        ends = np.cumsum(sizes)
        return (np.unique(shingles(words[e - n : e], size)) for e, n in zip(ends.tolist(), sizes.tolist()))

    def to_rows(batches):
        for batch in batches:
            for part, chunk in pieces(batch):
                rows = [(len(x), digest_of(x, bits), second_of(x), point_of(x) if len(x) else b"") for x in sets_of(chunk)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=[x.split()[0] for x in ROWS.split(", ")])

    def to_keys(batches):
        met: set[int] = set()
        for batch in batches:
            for _, chunk in pieces(batch, chars=PIECE_CHARS // 4):
                keys, digests, sizes = [np.empty(0, np.uint64)], [], []
                for x in sets_of(chunk):
                    digest = name_of(x, shared, bits)
                    if len(x) and digest not in met:
                        met.add(digest)
                        keys.append(keys_of(x, num, den))
                        digests.append(digest)
                        sizes.append(len(keys[-1]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(digests, np.int64), sizes))], names=["key", "digest"])
                if len(met) > REMEMBERED:
                    met.clear()

    def to_packed(batches):
        pack = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        for batch in batches:
            for part, chunk in pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([pack(t.encode()) for t in chunk], pa.binary())], names=["doc_id", "mark", "packed"])

    def to_sets(batches):
        for batch in batches:
            for _, chunk in unpacked(batch):
                sets = list(sets_of(chunk))
                yield pa.RecordBatch.from_arrays([pa.array([name_of(x, shared, bits) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["digest", "hashes"])

    def sets_for(pairs: DataFrame, but: DataFrame | None, name: str) -> DataFrame:
        """(digest, hashes) of the sets in these pairs, besides those there are; one row of each set gives them."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
        if but is not None:
            wanted = wanted.join(but.select("digest"), "digest", "left_anti")
        wanted = written(classes.join(wanted, "digest", "left_semi").select("doc_id", "mark"), f"{folder}/wanted-{name}")
        if but is not None and wanted.isEmpty():
            return but
        packed = texts.withColumn("mark", F.xxhash64("text")).mapInArrow(to_packed, "doc_id long, mark long, packed binary")
        packed = packed.join(wanted, ["doc_id", "mark"], "left_semi").dropDuplicates(["doc_id", "mark"])
        sets = written(packed.select("doc_id", "packed").mapInArrow(to_sets, "digest long, hashes array<long>"), f"{folder}/sets-{name}")
        return sets if but is None else but.unionByName(sets)

    rows = written(texts.withColumn("mark", F.xxhash64("text")).mapInArrow(to_rows, ROWS), f"{folder}/rows")
    again, shared = shared_by(rows, f"{folder}/shared")
    if len(shared):
        renamed = rows.join(again.withColumn("taken", F.lit(True)), "digest", "left")
        rows = written(renamed.withColumn("digest", F.when(F.col("taken"), F.col("second")).otherwise(F.col("digest"))).select(*rows.columns), f"{folder}/renamed")
    # nodes where unlike sets meet; a set is named by its digest, and one of its rows stands for it
    node = W.partitionBy("key")
    keys = texts.mapInArrow(to_keys, "key long, digest long")
    keys = keys.select("key", "digest", F.min("digest").over(node).alias("lo"), F.max("digest").over(node).alias("hi"), F.count("*").over(node).alias("members"))
    met = written(keys.filter("lo < hi").select("key", "digest", "members").distinct(), f"{folder}/met")
    classes = rows.filter("n_shingles > 0").join(met.select("digest").distinct(), "digest", "left_semi").dropDuplicates(["digest"])
    classes = written(classes, f"{folder}/classes")
    points = classes.select("digest", "n_shingles", "point")

    first = written(propose(chunks(met).join(points, "digest"), True, num, den), f"{folder}/first")
    sets = sets_for(first, None, "1")
    links = written(verify(first, sets, num, den), f"{folder}/links1")
    label = components(links, f"{folder}/components1").withColumnRenamed("node", "digest")
    labelled = met.join(label, "digest", "left").select("key", "digest", F.coalesce("component", "digest").alias("label"))
    rest = propose(meetings(labelled).join(points, "digest"), False, num, den).join(first, ["a", "b"], "left_anti")
    rest = written(rest, f"{folder}/rest")
    more = written(verify(rest, sets_for(rest, sets, "2"), num, den), f"{folder}/links2")
    label = components(links.unionByName(more), f"{folder}/components2").withColumnRenamed("node", "digest")
    out = rows.select("doc_id", "mark", "n_shingles", "digest").join(label, "digest", "left")
    out = out.select("doc_id", "mark", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "digest")).alias("component"))
    out = written(out, f"{scratch(spark, 'linked')}/rows")
    removed(spark, folder)
    return out


def jaccard_components(docs: DataFrame, size: int = 3, num: int = 9, den: int = 10, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id under links of Jaccard similarity num/den or more."""
    rows = linked_rows(docs, size, num, den, id_col, text_col, bits)
    least = rows.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    real = lambda c: F.nullif(c, F.lit(NO_ID))
    return rows.join(least, "component", "left").select(real(F.col("doc_id")).alias("doc_id"), "n_shingles", real(F.coalesce("least", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of docs, all columns, that stay: of each component the row with the smallest id (then the smallest hash of its text).

    Rows without words stay; rows that repeat both id and text are one. Rows are told apart by id and text, never by the
    id alone.
    """
    rows = linked_rows(docs, size, num, den).filter("component is not null")
    groups = rows.groupBy("component").agg(F.min(F.struct("doc_id", "mark")).alias("kept"), F.count("*").alias("n")).filter("n > 1")
    gone = rows.join(groups, "component").filter(F.struct("doc_id", "mark") != F.col("kept")).select(F.col("doc_id").alias("_link_id_"), F.col("mark").alias("_link_mark_")).distinct()
    again = groups.join(rows, "component").filter(F.struct("doc_id", "mark") == F.col("kept")).groupBy("component").count().filter("count > 1")
    keyed = docs.withColumns({"_link_id_": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_link_mark_": F.xxhash64("text")})
    stay = keyed.join(gone, ["_link_id_", "_link_mark_"], "left_anti")
    if not again.isEmpty():
        twice = again.join(groups, "component").select("kept.*").select(F.col("doc_id").alias("_link_id_"), F.col("mark").alias("_link_mark_"))
        one = stay.join(twice, ["_link_id_", "_link_mark_"], "left_semi").dropDuplicates(["_link_id_", "_link_mark_"])
        stay = stay.join(twice, ["_link_id_", "_link_mark_"], "left_anti").unionByName(one)
    return stay.select(*docs.columns)
