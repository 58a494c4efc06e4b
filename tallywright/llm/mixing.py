"""Mix sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Sources in the order of their code points (null last) weigh 5, 2, 1, 5, ... and share SHARE times all words; a target
stops at MOST times its source's words, and what is over is shared again by weight until no target is above. A document
of a source with target t and s words is taken floor(t / s) times for sure and once more with probability p, what is
left of t / s.

The choice is dependent: two documents at a time, words move from one probability to the other, in a random direction
that keeps both expectations, until one of the two is 0 or 1; the words that a source gives stay the same with every
move. Documents meet in blocks of about BLOCK of one source, dealt by a seeded hash, the long ones first, so that a short
one is left undecided; those meet in blocks of BLOCK again, level by level, until a source has one left, which goes to the
nearer side. So a source misses its target by half of a document at most, mostly a short one, no group has more than some
BLOCK rows whatever a source holds, and a rerun draws the same. Rows with the same source, id and size are alike and go as one row
with a number, of which floor(number x p) are taken and one at most is left to meet others.

Edge cases: a null text has size 0; documents without words are never taken, nor met; a null id is an id like another;
rows that repeat an id count each; a null source is a source, the last one, and an empty one another; documents of
one size meet in the order of a hash; a very long text is a document of many words; other columns are left out; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, scratch, sliced, written

#: Fixed values of the mix: weights by rank, words of the mix for each word there is, and times a source may be taken.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Documents that meet in a block, and rows that stand for alike ones before they are dealt over tasks.
BLOCK, ALIKE = 64, 4096
ITEM = "struct<doc_id:bigint,size:bigint,sure:bigint,p:double>"
TAKEN = "array<struct<doc_id:bigint,size:bigint,copies:bigint>>"


def before(rows: DataFrame, values: list[str]) -> DataFrame:
    """Sums of values over the rows before each row of a sliced table, as <value>_before."""
    sums = rows.groupBy("slice").agg(*(F.sum(v).alias(f"_{v}") for v in values))
    earlier = W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)  # a row for each slice
    sums = sums.select("slice", *(F.coalesce(F.sum(f"_{v}").over(earlier), F.lit(0)).alias(f"_{v}") for v in values))
    own = W.partitionBy("slice").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(sums, "slice")
    return rows.withColumns({f"{v}_before": F.coalesce(F.sum(v).over(own), F.lit(0)) + F.col(f"_{v}") for v in values}).drop(*(f"_{v}" for v in values))


def targets(sizes: DataFrame, folder: str, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, alike, target) of every source; sizes: source, size, n (rows that are alike)."""
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count_if(F.col("size") > 0).alias("alike"))
    ranked = before(sliced(sources.withColumn("one", F.lit(1).cast("long")), f"{folder}/ranked", F.asc_nulls_last("source")), ["one"])
    weight = F.element_at(F.lit([float(w) for w in weights]), (F.col("one_before") % len(weights) + 1).cast("int"))
    weighed = ranked.select("source", "source_size", "alike", "one_before", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("most"))
    # sources by how much of their most a unit of weight is: those that reach it come first
    weighed = sliced(weighed.withColumn("reach", F.col("most") / F.col("weight")), f"{folder}/weighed", F.asc("reach"), F.asc("one_before"))
    total = weighed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).select((F.col("words") * share).alias("words"), "weights")
    rows = before(weighed, ["most", "weight"]).crossJoin(total)  # of one row
    level = (F.col("words") - F.col("most_before")) / (F.col("weights") - F.col("weight_before"))
    # a unit of weight gets what is left where nobody reaches the most any more
    unit = rows.withColumn("level", level).filter("level <= reach").agg(F.min_by("level", F.struct("reach", "one_before")).alias("unit"))
    return weighed.crossJoin(unit).select("source", "source_size", "alike", F.least("most", F.col("weight") * F.col("unit")).alias("target"))


def bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def met(state: Column, new: Column) -> Column:
    """The one that is undecided so far meets a new one: words move until one of the two is 0 or 1."""
    i, out = state["left"], state["out"]
    times = new["size"] / i["size"]  # words of the new one for a word of the other
    moves = F.struct(
        times.alias("times"),
        F.least(1 - i["p"], new["p"] * times).alias("up"),
        F.least(i["p"], (1 - new["p"]) * times).alias("down"),
    )

    def moved(m: Column) -> Column:
        rises = new["u"] * (m["up"] + m["down"]) < m["down"]
        ends = F.when(rises, new["p"] * m["times"] <= 1 - i["p"]).otherwise((1 - new["p"]) * m["times"] <= i["p"])  # of the new one
        p = F.when(ends, F.when(rises, i["p"] + new["p"] * m["times"]).otherwise(i["p"] - (1 - new["p"]) * m["times"])).otherwise(
            F.when(rises, new["p"] - (1 - i["p"]) / m["times"]).otherwise(new["p"] + i["p"] / m["times"])
        )
        # who ends: the new one falls to 0 when the other rises, and the other way round
        taken = F.when(ends == rises, F.lit(0)).otherwise(F.lit(1)).cast("long")
        pick = lambda a, b: F.when(ends, a).otherwise(b)
        left = F.struct(*(pick(i[c], new[c]).alias(c) for c in ("doc_id", "size", "sure")), F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0)).alias("p"))
        done = F.struct(pick(new["doc_id"], i["doc_id"]).alias("doc_id"), pick(new["size"], i["size"]).alias("size"), (pick(new["sure"], i["sure"]) + taken).alias("copies"))
        return F.struct(left.cast(ITEM).alias("left"), F.concat(out, F.array(done)).cast(TAKEN).alias("out"))

    return F.when(i.isNull(), F.struct(F.struct(*(new[c].alias(c) for c in ("doc_id", "size", "sure", "p"))).cast(ITEM).alias("left"), out.cast(TAKEN).alias("out"))).otherwise(bound(moves, moved))


def folded(rows: DataFrame, seed: int) -> DataFrame:
    """(source, block, left, out): what each block leaves undecided, and how often the others are taken."""
    name = F.xxhash64(F.lit(seed), "doc_id", "size")
    item = F.struct((-F.col("size")).alias("order"), name.alias("name"), F.col("doc_id"), F.col("size"), F.col("sure"), F.col("p"), (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("draw"), "doc_id", "size"), 11) / float(1 << 53)).alias("u"))
    start = F.struct(F.lit(None).cast(ITEM).alias("left"), F.array().cast(TAKEN).alias("out"))
    state = rows.groupBy("source", "block").agg(F.aggregate(F.array_sort(F.collect_list(item)), start, met).alias("state"))
    return state.select("source", "block", "state.left", "state.out")


def mix(docs: DataFrame, seed: int = 13, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **shares) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target (of its source), taken, source, copies."""
    folder = scratch(docs.sparkSession, "mix")
    sizes = docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = written(sizes.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n")), f"{folder}/sizes")
    sources = written(targets(sizes, folder, **shares), f"{folder}/sources")
    of = sources.select(F.col("source").alias("of"), F.try_divide("target", F.col("source_size").cast("double")).alias("times"), F.ceil(F.col("alike") / BLOCK).alias("blocks"))
    rows = sizes.join(of, F.col("source").eqNullSafe(F.col("of"))).withColumn("sure", F.floor("times"))
    rows = rows.withColumn("p", F.when(F.col("size") > 0, F.col("times") - F.col("sure")).otherwise(0.0))
    rows = rows.withColumn("ones", F.floor(F.col("n") * F.col("p"))).withColumn("rest", F.col("n") * F.col("p") - F.col("ones"))
    rows = rows.withColumn("undecided", (F.col("rest") > 0).cast("long")).withColumn("sure", F.when(F.col("size") > 0, F.col("sure")).otherwise(0))

    def told(copies, n):
        return rows.select("source", "doc_id", "size", copies.cast("long").alias("copies"), n.alias("n")).filter("n > 0")

    decided = [told(F.col("sure") + 1, F.col("ones")), told(F.col("sure"), F.col("n") - F.col("ones") - F.col("undecided"))]
    open_rows = rows.filter("undecided = 1").select("source", F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), "doc_id", "size"), "blocks").alias("block"), "doc_id", "size", "sure", F.col("rest").alias("p"))
    blocks, level = sources.agg(F.coalesce(F.max(F.ceil(F.col("alike") / BLOCK)), F.lit(0))).head()[0], 0
    while True:
        state = written(folded(open_rows, seed + level), f"{folder}/level{level}")
        done = state.select("source", F.explode("out").alias("x"))
        decided.append(done.select("source", "x.doc_id", "x.size", "x.copies", F.lit(1).cast("long").alias("n")))
        open_rows = state.select("source", F.floor(F.col("block") / BLOCK).alias("block"), "left.*")
        if blocks <= 1:
            break
        blocks, level = -(-blocks // BLOCK), level + 1
    decided.append(open_rows.select("source", "doc_id", "size", (F.col("sure") + (F.col("p") >= 0.5).cast("long")).alias("copies"), F.lit(1).cast("long").alias("n")))
    out = decided[0]
    for x in decided[1:]:
        out = out.unionByName(x)
    # alike rows become rows again; those of a large number are dealt over tasks in parts
    few = out.filter(F.col("n") <= ALIKE).withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    parts = out.filter(F.col("n") > ALIKE).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / ALIKE))))
    parts = parts.repartition("source", "doc_id", "size", "part").withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(ALIKE).cast("long"), F.col("n") - F.col("part") * ALIKE))))
    out = few.unionByName(parts.drop("part"))
    by = sources.select(F.col("source").alias("of"), "source_size", "target")
    out = out.join(by, F.col("source").eqNullSafe(F.col("of")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
