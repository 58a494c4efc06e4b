"""Conversations as a trie of their turns: what its nodes share, rolled up in bands of depths.

Every conversation c is rebuilt first: it starts with up to h turns of conversation c - c % FAMILY, h being the CRC-32 of
its decimal number modulo HEADS, and goes on with its own turns after its first h. A node is a sequence of turns that a
rebuilt conversation starts with; it goes by 128 bits of sums of its turns' digests and places, so that names are running
sums, and the root by the sum of nothing. Running numbers and sums are those of slices first (`sliced`), then inside
each slice: a conversation that holds any share of the turns is dealt over many tasks.

Sums over subtrees go by bands of BAND depths. Of each node the conversation of the smallest id stands for it; inside a
band, that one's values are added to its turns above, up to the band's root, and then by node. The roots of bands form a
trie a BANDth as high, which is rolled up in the same way, in bands of bands, until one band is left; then the complete sums
of the roots are added where the band above ends, and that band is summed again. So no turn is counted for more than BAND
nodes a level, and rounds grow with the logarithm of the depth only.

Ids of the conversations that end in a node are joined in parts of PART; what is left to one task is to feed a digest with
the parts of one node, one after the other, which holds one part at a time.

Edge cases: a null role or text is empty; turns that share a number are ordered by role, then text; rows with a null turn
come first; repeated rows are repeated turns; rows with a null id form one conversation, which is the smallest, isn't
rebuilt and has an empty number; c - c % FAMILY goes towards zero for negative ids; a conversation that is rebuilt
without a turn is a member of the root and ends there; a very long text is digested where it is read; other columns are left
out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NO_ID, SLICE, WORD, bounded, scratch, sliced, written

#: Fixed values of the rebuilding: conversations that share a source, and one more than the most turns they take of it.
FAMILY, HEADS = 20, 4
#: Depths of a band, ids that are joined together, and characters of a turn that bound a slice.
BAND, PART, BOUND_CHARS = 32, 4096, 128
NAME, LANES, NOTHING = ["n1", "n2"], ["l0", "l1", "l2", "l3"], hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame, folder: str, id_col: str) -> DataFrame:
    """(conv_id, slice, at, digest, words): turns in their order, without their texts."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("conv_id"),
        F.col("turn"),
        F.concat(role, F.lit("\0"), text).alias("said"),
        F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    turns = turns.withColumn("bound", F.substring("said", 1, BOUND_CHARS))
    return sliced(turns, f"{folder}/turns", F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("bound"), within=(F.asc("said"),), slices=-(-conversations.count() // SLICE), drop=("said", "bound", "turn"))


def lanes(digest: Column, place: Column) -> list[Column]:
    """Four numbers of 32 bits of a turn at a place; sums of any number of turns stay below 2^63."""
    halves = [F.xxhash64(F.lit(seed), place.cast("long"), digest) for seed in (1, 2)]
    return [x.alias(lane) for lane, x in zip(LANES, (y for h in halves for y in (F.shiftrightunsigned(h, 32), h.bitwiseAND((1 << 32) - 1))))]


def rebuilt(turns: DataFrame, folder: str) -> DataFrame:
    """(conv_id, pos, n1, n2, p1, p2, words, last): each rebuilt conversation's nodes from the root on, with their parents' names."""
    in_order = W.partitionBy("conv_id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    counts = turns.groupBy("conv_id", "slice").agg(F.count("*").alias("n"))
    counts = written(counts.withColumn("before", F.coalesce(F.sum("n").over(in_order), F.lit(0))), f"{folder}/counts")
    inside = F.row_number().over(W.partitionBy("conv_id", "slice").orderBy("at"))
    own = turns.join(counts.select("conv_id", "slice", "before"), ["conv_id", "slice"]).withColumn("place", F.col("before") + inside)
    heads = own.filter((F.col("place") < HEADS) & (F.col("conv_id") % FAMILY == 0)).groupBy(F.col("conv_id").alias("source")).agg(F.array_sort(F.collect_list(F.struct("place", "digest", "words"))).alias("head"))
    known = F.col("conv_id") != NO_ID
    convs = counts.groupBy("conv_id").agg(F.sum("n").alias("turns"))
    convs = convs.withColumns({"skip": F.when(known, F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).otherwise(0), "source": F.when(known, F.col("conv_id") - F.col("conv_id") % FAMILY)})
    convs = convs.join(heads, "source", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<place:bigint,digest:binary,words:bigint>>")), F.lit(1), F.col("skip").cast("int")))
    convs = convs.select("conv_id", "skip", F.size("head").cast("long").alias("taken"), (F.size("head") + F.greatest(F.col("turns") - F.col("skip"), F.lit(0))).alias("length"), "head")
    convs = written(convs, f"{folder}/convs")

    root = convs.select("conv_id", F.lit(-2).alias("slice"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("words"), *(F.lit(0).cast("long").alias(x) for x in LANES))
    taken = convs.select("conv_id", F.lit(-1).alias("slice"), F.explode("head").alias("t")).select("conv_id", "slice", F.col("t.place").alias("pos"), "t.words", *lanes(F.col("t.digest"), F.col("t.place")))
    shift = counts.join(convs, "conv_id").select("conv_id", "slice", "before", "skip", "taken")
    own = turns.join(shift, ["conv_id", "slice"]).withColumn("place", F.col("before") + inside).filter("place > skip").withColumn("pos", F.col("place") - F.col("skip") + F.col("taken"))
    rows = written(root.unionByName(taken).unionByName(own.select("conv_id", "slice", "pos", "words", *lanes(F.col("digest"), F.col("pos")))), f"{folder}/rebuilt")

    sums = rows.groupBy("conv_id", "slice").agg(*(F.sum(x).alias(x) for x in LANES))
    sums = sums.select("conv_id", "slice", *(F.coalesce(F.sum(x).over(in_order), F.lit(0)).alias(f"{x}_before") for x in LANES)).join(convs.select("conv_id", "length"), "conv_id")
    so_far = W.partitionBy("conv_id", "slice").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    named = rows.join(sums, ["conv_id", "slice"]).withColumns({f"{x}_now": F.sum(x).over(so_far) + F.col(f"{x}_before") for x in LANES})

    def name(place: Column, values: list[Column]) -> list[Column]:
        return [F.xxhash64(F.lit(seed), place, *values) for seed in (3, 4)]

    here = name(F.col("pos"), [F.col(f"{x}_now") for x in LANES])
    above = [F.when(F.col("pos") > 0, x) for x in name(F.col("pos") - 1, [F.col(f"{x}_now") - F.col(x) for x in LANES])]
    return written(named.select("conv_id", "pos", *(c.alias(n) for c, n in zip([*here, *above], ["n1", "n2", "p1", "p2"])), "words", (F.col("pos") == F.col("length")).alias("last")), f"{folder}/paths")


def in_bands(paths: DataFrame, values: DataFrame, step: int) -> DataFrame:
    """(n1, n2, leaves, tokens): values of every node and of what is below it in its band, of the nodes at multiples of `step`."""
    own = values.select("conv_id", F.col("depth").alias("pos"), "leaves", "tokens")
    rows = paths.filter(F.col("pos") % step == 0).select("conv_id", "pos", *NAME).join(own, ["conv_id", "pos"], "left").na.fill(0, ["leaves", "tokens"])
    up = W.partitionBy("conv_id", F.floor(F.col("pos") / (step * BAND))).orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.select(*NAME, F.sum("leaves").over(up).alias("leaves"), F.sum("tokens").over(up).alias("tokens"))
    return rows.filter("leaves <> 0 OR tokens <> 0").groupBy(*NAME).agg(F.sum("leaves").alias("leaves"), F.sum("tokens").alias("tokens"))


def rolled_up(paths: DataFrame, values: DataFrame, deepest: int, folder: str, step: int = 1) -> DataFrame:
    """(n1, n2, leaves, tokens) over whole subtrees, of the nodes at multiples of `step`; values: names, conv_id, depth, leaves, tokens."""
    sums = written(in_bands(paths, values, step), f"{folder}/bands{step}")
    above = step * BAND
    if deepest < above:
        return sums
    roots = values.filter(F.col("depth") % above == 0).select(*NAME, "conv_id", "depth").join(sums, NAME, "left").na.fill(0, ["leaves", "tokens"])
    complete = rolled_up(paths, roots, deepest, folder, above)
    # a band's root adds all of its subtree to the node at which the band above ends, on its own path
    lower = complete.join(roots.select(*NAME, "conv_id", "depth"), NAME).filter("depth > 0").select("conv_id", (F.col("depth") - step).alias("pos"), "leaves", "tokens")
    ends = paths.select("conv_id", "pos", *NAME).join(lower, ["conv_id", "pos"]).groupBy(*NAME).agg(F.sum("leaves").alias("more_leaves"), F.sum("tokens").alias("more_tokens"))
    added = values.join(ends, NAME, "left").na.fill(0, ["more_leaves", "more_tokens"])
    added = added.select(*NAME, "conv_id", "depth", (F.col("leaves") + F.col("more_leaves")).alias("leaves"), (F.col("tokens") + F.col("more_tokens")).alias("tokens"))
    return written(in_bands(paths, added, step), f"{folder}/whole{step}")


def digests(batches):
    """One digest of each node's parts, which come one after another."""
    name, digest = None, None

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 3, (pa.int64(), pa.int64(), pa.string()))], names=["n1", "n2", "ends_sha256"])

    for batch in batches:
        rows = []
        for n1, n2, part in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (n1, n2) == name:
                digest.update(b",")
            else:
                if name is not None:
                    rows.append((*name, digest.hexdigest()))
                name, digest = (n1, n2), hashlib.sha256()
            digest.update(part.encode())
        yield batch_of(rows)
    yield batch_of([(*name, digest.hexdigest())] if name is not None else [])


def ends(paths: DataFrame, folder: str) -> DataFrame:
    """(n1, n2, ends_sha256) of the nodes in which conversations end."""
    bounded(paths.sparkSession)
    rows = sliced(paths.filter("last").select(*NAME, "conv_id"), f"{folder}/ends", F.asc("n1"), F.asc("n2"), F.asc("conv_id"))
    inside = F.row_number().over(W.partitionBy(*NAME, "slice").orderBy("conv_id"))
    rows = rows.withColumn("part", F.floor((inside - 1) / PART))
    number = lambda c: F.when(c == NO_ID, "").otherwise(c.cast("string"))
    rows = rows.groupBy(*NAME, "slice", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), number), ",").alias("ids"))
    parts = rows.repartition(*NAME).sortWithinPartitions(*NAME, "slice", "part").select(*NAME, "ids")
    return parts.mapInArrow(digests, "n1 long, n2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    folder = scratch(conversations.sparkSession, "trie")
    paths = rebuilt(numbered(conversations, folder, id_col), folder)
    nodes = paths.groupBy(*NAME).agg(F.min("conv_id").alias("conv_id"), F.min("pos").alias("depth"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("words").alias("words"))
    nodes = written(nodes, f"{folder}/nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, NAME, "left").na.fill(0, ["n_children"]), f"{folder}/parents")
    values = nodes.select(*NAME, "conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("tokens"))
    deepest = nodes.agg(F.coalesce(F.max("depth"), F.lit(0))).head()[0]
    sums = rolled_up(paths, values, deepest, folder)
    parent = nodes.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, NAME, "left").join(ends(paths, folder), NAME, "left").join(parent, ["p1", "p2"], "left")
    return out.select(
        F.nullif("conv_id", F.lit(NO_ID)).alias("conv_id"),
        "depth",
        F.nullif("parent_conv_id", F.lit(NO_ID)).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.coalesce("tokens", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )
