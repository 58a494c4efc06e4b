"""Benchmark decontamination in DataFrame functions only: SimHash over windows as long as the benchmark item.

Words are runs of letters and digits in lower case; shingles are five words in a row (all words of a shorter item). A
document is contaminated by an item if one of its windows with as many shingles as the item (the whole text, if that has
fewer) has a weighted similarity of 0.8 or more: shared shingles over all shingles, each counted as often as it stands.

A fingerprint of every window of every length would cost some microseconds a word and length. So windows are looked at
only where enough shingles of an item lie close together: every window with as many of them as the similarity takes (8/9
of its length), in whatever order they stand; this leaves out no window of the similarity. Each of them gets a 64-bit
SimHash. The index cuts item fingerprints into BLOCKS blocks of 16 bits and holds, for each block, all values within
RADIUS // BLOCKS bits of it; of two fingerprints within RADIUS, one block is that close at least (see `within_radius`), so the
index finds all items within RADIUS, with or without the windows' choice. The exact similarity then decides.

Edge cases: null texts have no words and match nothing; items without words are ignored; a null id is a document or item
of its own; rows that repeat an id with other texts are looked at each by itself (told apart by a hash of the text), and
repeated rows together; items that repeat an id or text likewise, each distinct text with a key of its own; ties go to the
first window; a very long text is one array of words; other columns are left out; empty tables give an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, scratch, written

SHINGLE = 5
#: Similarity as a fraction.
NUM, DEN = 4, 5
#: Fingerprints of windows with this similarity differ in 10 of 64 bits on average, with a deviation of 3; 3 in 10,000 of
#: those that just reach it in more than RADIUS. A block of a pair within RADIUS differs in RADIUS // BLOCKS bits at most.
RADIUS, BLOCKS = 19, 4
WIDTH = 64 // BLOCKS
#: Shingles of items up to which the items' table is broadcast (about 50 bytes each); beyond it, the join is shuffled.
BROADCAST_ROWS = 200_000


def words_of(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_count(words: Column, size: int) -> Column:
    return F.greatest(F.size(words) - (size - 1), F.lit(0))


def shingles(words: Column, size: int) -> Column:
    """Hashes of the runs of `size` words."""
    columns = [F.slice(words, i + 1, shingle_count(words, size)).alias(f"w{i}") for i in range(size)]
    return F.transform(F.arrays_zip(*columns), lambda z: F.xxhash64(*(z[f"w{i}"] for i in range(size))))


def blocks(fingerprint: Column) -> Column:
    """The blocks of a fingerprint, each with its number."""
    return F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1)).alias("bits")) for i in range(BLOCKS)))


def masks(spark: SparkSession) -> DataFrame:
    """mask: the 2,517 values of a block with RADIUS // BLOCKS bits at most; as rows, since as literals they would stand in every plan on the driver."""
    return spark.range(0, 1 << WIDTH, 1, 1).filter(F.bit_count("id") <= RADIUS // BLOCKS).select(F.col("id").alias("mask"))


def within_radius(windows: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of windows (with keys and fingerprint) and items (with keys, item and other) whose fingerprints differ in RADIUS bits at most.

    A block of an item stands in the index with each value that differs from it in RADIUS // BLOCKS bits at most: 2,517
    values, 15 in 100 of the items of a window's length. Some 10,000 rows an item are never broadcast.
    """
    right = items.select(*keys, "item", "other", F.explode(blocks(F.col("other"))).alias("b")).select(*keys, "item", "other", "b.block", "b.bits")
    right = right.crossJoin(F.broadcast(masks(items.sparkSession))).withColumn("bits", F.col("bits").bitwiseXOR(F.col("mask"))).drop("mask")
    left = windows.select("*", F.explode(blocks(F.col("fingerprint"))).alias("b")).select(*windows.columns, "b.block", "b.bits")
    close = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other"))) <= RADIUS
    return left.join(right.hint("merge"), [*keys, "block", "bits"]).filter(close).select(*windows.columns, "item").distinct()


def simhashes(windows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and fingerprint, from keys and hashes: a bit is set if most shingles have it set.

    Thirty-two sums count two bits each: bits j and j + 32 in lanes of 32 bits.
    """
    lanes = F.lit(0x0000000100000001)
    rows = windows.select(*keys, F.explode("hashes").alias("h"))
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(F.shiftrightunsigned("h", j).bitwiseAND(lanes)).alias(f"s{j}") for j in range(32)))

    def bit(j: int, lane: int) -> Column:
        ones = F.shiftrightunsigned(f"s{j}", 32 * lane).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when(2 * ones > F.col("n"), F.shiftleft(F.lit(1).cast("long"), j + 32 * lane)).otherwise(F.lit(0).cast("long"))

    return sums.select(*keys, reduce(Column.bitwiseOR, (bit(j, lane) for j in range(32) for lane in range(2))).alias("fingerprint"))


def weighted_overlap(x: Column, y: Column) -> Column:
    """Shared shingles, each as often as both have it."""
    plain = (F.size(F.array_distinct(x)) == F.size(x)) & (F.size(F.array_distinct(y)) == F.size(y))

    def times(xs: Column, h: Column) -> Column:
        return F.size(F.filter(xs, lambda v: v == h))

    slow = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda total, h: total + F.least(times(x, h), times(y, h)))
    return F.when(plain, F.size(F.array_intersect(x, y))).otherwise(slow)


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """(item_id, item, k, m, hashes) of each item with words; item: a key of its shingles."""
    words = benchmark.select("item_id", words_of("text").alias("words")).filter(F.size("words") > 0)
    words = words.withColumn("k", F.least(F.size("words"), F.lit(SHINGLE)))
    hashes = reduce(lambda a, b: F.when(F.col("k") == b, shingles(F.col("words"), b)).otherwise(a), range(1, SHINGLE), shingles(F.col("words"), SHINGLE))
    return words.select("item_id", F.xxhash64("k", hashes).alias("item"), "k", F.size(hashes).alias("m"), hashes.alias("hashes"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, item, start, similarity): the best window of every text and item that reach the similarity.

    doc_id is NO_ID for null; mark is a hash of the text, item a key of the item's shingles.
    """
    folder = scratch(docs.sparkSession, "windows")
    items = written(item_shingles(benchmark).drop("item_id").dropDuplicates(["item"]), f"{folder}/items")
    n_shingles, sizes = items.agg(F.coalesce(F.sum("m"), F.lit(0)), F.collect_set("k")).head()  # five sizes at most
    small = F.broadcast if n_shingles <= BROADCAST_ROWS else (lambda x: x)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text_col).alias("mark"), words_of(text_col).alias("words"))

    # shingles that documents share with items; all sizes of shingles in one pass
    sizes, doc = sorted(sizes) or [SHINGLE], ["doc_id", "mark"]
    zipped = F.arrays_zip(*(F.slice("words", i + 1, F.size("words")).alias(f"w{i}") for i in range(sizes[-1])))  # null behind the last word
    rows = texts.select(*doc, F.size("words").alias("words"), F.posexplode(zipped).alias("p", "z"))
    of_size = (F.struct(F.lit(k).alias("k"), F.when(F.col(f"z.w{k - 1}").isNotNull(), F.xxhash64(*(f"z.w{i}" for i in range(k)))).alias("h")) for k in sizes)
    rows = rows.select(*doc, "words", "p", F.explode(F.array(*of_size)).alias("s")).select(*doc, (F.col("words") - (F.col("s.k") - 1)).alias("n"), "p", "s.k", "s.h")
    known = items.select("item", "k", "m", F.explode("hashes").alias("h")).distinct()
    seeds = rows.filter("h is not null").join(small(known), ["k", "h"]).drop("h")
    # cells of the item's length: a window lies in two neighbours, which hold enough of them if it reaches the similarity
    keys = [*doc, "item", "k", "m", "n"]
    places = seeds.select(*keys, F.floor(F.col("p") / F.col("m")).cast("int").alias("cell"), "p").distinct()
    # A window of w shingles with the similarity shares NUM (m + w) / (NUM + DEN) of them or more, wherever they stand in it.
    sizes_of_both = F.col("m") + F.least("m", "n")
    need = F.floor((NUM * sizes_of_both + (NUM + DEN - 1)) / (NUM + DEN)).cast("int")
    counts = places.groupBy(*keys, "cell").agg(F.count("*").alias("c"))
    both = counts.select(*keys, F.explode(F.array(F.col("cell") - 1, F.col("cell"))).alias("pair"), "c")
    both = both.groupBy(*keys, "pair").agg(F.sum("c").alias("c")).filter(F.col("c") >= need)
    cells = both.select(*keys, "pair", F.explode(F.array(F.col("pair"), F.col("pair") + 1)).alias("cell"))
    close = places.join(cells, [*keys, "cell"]).groupBy(*keys, "pair").agg(F.sort_array(F.collect_list("p")).alias("ps")).withColumn("need", need)
    # Windows with enough of the places: those that start at place i or before it and end at place i + need - 1 or after it.
    # A pair of cells has 2 m places at most.
    last = F.slice("ps", F.col("need"), F.size("ps"))
    ranges = F.filter(F.zip_with(F.slice("ps", 1, F.size(last)), last, lambda a, b: F.struct(F.greatest(F.lit(0), b - F.col("m") + 1).alias("low"), F.least(a, F.greatest(F.lit(0), F.col("n") - F.col("m"))).alias("high"))), lambda r: r["low"] <= r["high"])
    starts = close.select(*doc, "k", "m", F.explode(ranges).alias("r")).select(*doc, "k", "m", F.explode(F.sequence("r.low", "r.high")).alias("start")).distinct()

    # their fingerprints
    wanted = starts.groupBy(*doc).agg(F.collect_list(F.struct("k", "m", "start")).alias("wanted"))
    held, cut = texts.join(wanted, doc), None
    for k in sizes:
        own = held.select(*doc, F.filter("wanted", of_k(k)).alias("wanted"), shingles(F.col("words"), k).alias("all")).filter(F.size("wanted") > 0)
        part = F.transform("wanted", lambda w: F.struct(w["k"].alias("k"), w["m"].alias("m"), w["start"].alias("start"), F.slice("all", w["start"] + 1, w["m"]).alias("hashes")))
        own = own.select(*doc, F.explode(part).alias("w")).select(*doc, "w.*")
        cut = own if cut is None else cut.unionByName(own)
    windows = written(cut.dropDuplicates([*doc, "k", "m", "start"]), f"{folder}/windows")
    of_windows = simhashes(windows, [*doc, "k", "m", "start"])
    of_items = simhashes(items, ["item", "k", "m"]).withColumnRenamed("fingerprint", "other")
    pairs = within_radius(of_windows, of_items, ["k", "m"]).drop("fingerprint")

    # the exact similarity
    pairs = pairs.join(windows, [*doc, "k", "m", "start"]).join(small(items.select("item", F.col("hashes").alias("own"))), "item")
    pairs = pairs.withColumn("overlap", weighted_overlap(F.col("hashes"), F.col("own"))).withColumn("all", F.size("hashes") + F.size("own") - F.col("overlap"))
    hits = pairs.filter(DEN * F.col("overlap") >= NUM * F.col("all"))
    best = F.max(F.struct((F.col("overlap") / F.col("all")).alias("similarity"), (-F.col("start")).alias("s"))).alias("best")
    return hits.groupBy(*doc, "item").agg(best).select(*doc, "item", (-F.col("best.s")).cast("int").alias("start"), "best.similarity")


def of_k(k: int):
    return lambda w: w["k"] == k


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start, similarity): the best window of every document and item that reach the similarity.

    start counts words from 0. Rows that repeat an id with other texts, of documents or items, each have their own rows.
    """
    names = item_shingles(benchmark).select("item_id", "item").distinct()
    found = leaks(docs, benchmark, id_col, text_col).join(names, "item")
    return found.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "item_id", "start", "similarity")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose own text no item contaminates; rows that share an id stand each for itself."""
    gone = leaks(docs, benchmark).select(F.col("doc_id").alias("_leak_id_"), F.col("mark").alias("_leak_mark_")).distinct()
    keyed = docs.withColumns({"_leak_id_": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_leak_mark_": F.xxhash64("text")})
    return keyed.join(gone, ["_leak_id_", "_leak_mark_"], "left_anti").select(*docs.columns)
