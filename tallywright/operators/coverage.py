"""Staged deltas folded into progress, coverage against targets, next work, and universes of multisets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stage(deltas: DataFrame) -> DataFrame:
    """Deltas as parallel arrays, one row per submission."""
    return deltas.groupBy("generation", "submission").agg(F.collect_list(F.struct("rack", "n", "equity_cents")).alias("d")).select("generation", "submission", *(F.col(f"d.{c}").alias(c) for c in ("rack", "n", "equity_cents")))


def fold(staged: DataFrame) -> DataFrame:
    """Sums per generation and key of staged parallel arrays; partial sums come before the shuffle."""
    return fold_rows(staged.select("generation", F.explode(F.arrays_zip("rack", "n", "equity_cents")).alias("d")).select("generation", "d.*"))


def fold_rows(rows: DataFrame) -> DataFrame:
    """The same of deltas that aren't staged, one row each."""
    return rows.groupBy("generation", "rack").agg(F.sum("n").alias("n"), F.sum("equity_cents").alias("equity_cents"))


def merge_deltas(staged: DataFrame, progress: DataFrame) -> DataFrame:
    """Progress (generation, rack, n, equity_cents) with the deltas added; keys outside it are dropped."""
    return added(fold(staged), progress)


def added(sums: DataFrame, progress: DataFrame) -> DataFrame:
    """Progress with sums per key added."""
    new = sums.withColumnsRenamed({"n": "dn", "equity_cents": "de"})
    return progress.join(new, ["generation", "rack"], "left").select(
        "generation", "rack", (F.col("n") + F.coalesce("dn", F.lit(0))).alias("n"), (F.col("equity_cents") + F.coalesce("de", F.lit(0))).alias("equity_cents")
    )


def unmatched(staged: DataFrame, progress: DataFrame) -> DataFrame:
    """Per generation: folded keys that are not in progress, and their count."""
    lost = fold(staged).join(progress.select("generation", "rack"), ["generation", "rack"], "left_anti")
    return lost.groupBy("generation").agg(F.count("*").alias("keys"), F.sum("n").alias("n"))


def target_of(generation, targets: list[int]):
    """Targets are by generation from 1; the last holds for all later ones."""
    return F.element_at(F.lit(targets), F.greatest(F.lit(1), F.least(generation, F.lit(len(targets)))).cast("int"))


def generation_summary(progress: DataFrame, targets: list[int]) -> DataFrame:
    """Per generation: keys, keys at target, occurrences, lowest count and its first key."""
    target = target_of(F.col("generation"), targets)
    return progress.groupBy("generation").agg(
        F.count("*").alias("keys"), F.count_if(F.col("n") >= target).alias("at_target"), F.sum("n").alias("total"), F.min("n").alias("least"), F.min_by("rack", F.struct("n", "rack")).alias("least_rack")
    )


def select_sweep(progress: DataFrame, generation: int, target: int, cursor, k: int) -> DataFrame:
    """The next k keys below target behind the cursor in key order, with whether there are more."""
    rows = progress.filter((F.col("generation") == generation) & (F.col("n") < target) & (F.col("rack") > cursor)).select("rack", "n").orderBy("rack").limit(k + 1)
    place = F.row_number().over(W.orderBy("rack"))  # over k + 1 rows
    return rows.select("rack", "n", place.alias("place"), (F.count("*").over(W.partitionBy()) > k).alias("more")).filter(F.col("place") <= k)


def select_tail(progress: DataFrame, generation: int, target: int, busy: DataFrame, k: int) -> DataFrame:
    """The k lowest counts below target that are neither in flight nor staged; ties by key."""
    rows = progress.filter((F.col("generation") == generation) & (F.col("n") < target))
    return rows.join(busy.filter("rack is not null").select("rack").distinct(), "rack", "left_anti").select("rack", "n").orderBy("n", "rack").limit(k)


def generation_table(progress: DataFrame, generation: int) -> DataFrame:
    """Key, count and equity sum with ten decimals, as the CSV sink writes them."""
    return progress.filter(F.col("generation") == generation).select("rack", "n", (F.col("equity_cents").cast("decimal(28,0)") / 100).cast("decimal(38,10)").cast("string").alias("equity_sum"), F.try_divide(F.col("equity_cents") / 100, F.col("n").cast("double")).alias("mean"))


def write_generation(table: DataFrame, path: str) -> None:
    """CSV parts in key order over all parts."""
    table.select("rack", "n", "equity_sum").repartitionByRange("rack").sortWithinPartitions("rack").write.mode("overwrite").csv(path)


def missing_keys(tables: DataFrame, universe: DataFrame, generations: DataFrame) -> DataFrame:
    """(generation, missing, extra): keys of the universe that a generation's table lacks, and keys that it has beyond; both 0 when coverage is complete."""
    wanted = generations.select("generation").crossJoin(universe.select("rack", F.lit(1).alias("wanted")))
    both = wanted.join(tables.select("generation", "rack", F.lit(1).alias("held")).distinct(), ["generation", "rack"], "full")
    return both.groupBy("generation").agg(F.count_if(F.col("held").isNull()).alias("missing"), F.count_if(F.col("wanted").isNull()).alias("extra"))


def content_hash(progress: DataFrame) -> DataFrame:
    """Per generation: keys and a hash of the content that doesn't depend on order."""
    return progress.groupBy("generation").agg(F.count("*").alias("keys"), F.sum(F.xxhash64("rack", "n", "equity_cents").cast("decimal(38,0)")).alias("content"))


def generation_integrity(rebuilt: DataFrame, recorded: DataFrame, builder: str) -> DataFrame:
    """Recorded generations (generation, content, builder) against tables that were built again: present, of the same builder, of the same content."""
    now = content_hash(rebuilt).withColumnRenamed("content", "rebuilt")
    same = F.col("content").eqNullSafe(F.col("rebuilt"))
    return recorded.join(now, "generation", "left").select("generation", F.col("rebuilt").isNotNull().alias("present"), (F.col("builder") == builder).alias("same_builder"), same.alias("same"))


def universe_counts(bag: list[int], size: int) -> list[list[int]]:
    """ways[i][k]: multisets of k tiles from letters i and after; a table of letters x size numbers."""
    ways = [[0] * (size + 1) for _ in range(len(bag) + 1)]
    ways[-1][0] = 1
    for i in range(len(bag) - 1, -1, -1):
        for k in range(size + 1):
            ways[i][k] = sum(ways[i + 1][k - t] for t in range(min(bag[i], k) + 1))
    return ways


def multiset_universe(spark: SparkSession, bag: DataFrame, size: int, least: int | None = None) -> DataFrame:
    """All distinct multisets of `size` tiles (of `least` to `size`) from a bag (letter, n, place): the tile string, letters in place order.

    A fold over letters: each step joins the frontier with how many of the letter to take and drops what can't be filled
    any more, so the frontier never exceeds the universe's own order.
    """
    letters = bag.orderBy("place").collect()  # an alphabet
    rest, least = sum(r["n"] for r in letters), size if least is None else least
    frontier = spark.range(1).select(F.lit("").alias("rack"), F.lit(0).alias("size"))
    for r in letters:
        rest -= r["n"]
        take = F.explode(F.sequence(F.greatest(F.lit(0), F.lit(least - rest) - F.col("size")), F.least(F.lit(r["n"]), F.lit(size) - F.col("size")))).alias("t")
        frontier = frontier.filter(F.col("size") + r["n"] + rest >= least).select("rack", "size", take).select(F.concat("rack", F.repeat(F.lit(r["letter"]), F.col("t"))).alias("rack"), (F.col("size") + F.col("t")).alias("size"))
    return frontier.filter(F.col("size").between(least, size)).select("rack")


def write_universe(racks: DataFrame, job: int, generation: int, path: str) -> DataFrame:
    """Write the racks of a job's generation as a table, each task its own part; (job_id, generation, racks_total) of what was written."""
    keyed = racks.select(F.lit(job).cast("long").alias("job_id"), F.lit(generation).cast("long").alias("generation"), "rack")
    keyed.write.mode("overwrite").parquet(path)
    return racks.sparkSession.read.schema(keyed.schema).parquet(path).groupBy("job_id", "generation").agg(F.count("*").alias("racks_total"))


def unrank(indices: DataFrame, letters: list[str], bag: list[int], size: int) -> DataFrame:
    """Multisets by index (column `index`), in the order of ascending takes per letter."""
    ways = universe_counts(bag, size)
    df = indices.withColumns({"rest": F.col("index").cast("long"), "open": F.lit(size), "rack": F.lit("")})
    for i, letter in enumerate(letters):
        for t in range(min(bag[i], size) + 1):
            # how many multisets take exactly t of this letter, by how many tiles are open
            here = F.coalesce(F.element_at(F.lit([ways[i + 1][k - t] if k >= t else 0 for k in range(size + 1)]), F.col("open") + 1), F.lit(0))
            done = F.col("done") if t else F.lit(False)
            hit = ~done & (F.col("rest") < here)
            df = df.withColumn("hit", hit).withColumns({
                "rack": F.when(F.col("hit"), F.concat("rack", F.lit(letter * t))).otherwise(F.col("rack")),
                "left": F.when(F.col("hit"), F.col("open") - t).otherwise(F.col("left") if t else F.col("open")),
                "rest": F.when(done | F.col("hit"), F.col("rest")).otherwise(F.col("rest") - here),
                "done": done | F.col("hit"),
            })
        df = df.withColumn("open", F.col("left"))
    return df.select("index", "rack")


def scattered(total: int):
    """Index times 2^61 - 1 modulo the total, in exact decimals."""
    return ((F.col("index").cast("decimal(18,0)") * F.lit((1 << 61) - 1).cast("decimal(19,0)")) % F.lit(total).cast("decimal(18,0)")).cast("long")


def select_coverage(progress: DataFrame, targets: list[int], cursors: DataFrame, busy: DataFrame, k: int, switch: int = 100) -> DataFrame:
    """(generation, mode, place, rack, n): the next k keys of every generation that has keys below its target.

    cursors: generation, cursor (of a lap under way); busy: generation, rack of keys in flight or staged. A lap goes on in key
    order while a key is left behind its cursor ('sweep'). At its end, or without one, a new lap begins ('lap') while more
    than `switch` times k keys are below target; then the lowest counts that aren't busy come first ('tail'). All
    generations are decided by one aggregation, and each task passes on k keys of a generation at most.
    """
    below = progress.filter(F.col("n") < target_of(F.col("generation"), targets)).join(cursors, "generation", "left")
    behind = F.coalesce(F.col("rack") > F.col("cursor"), F.lit(False))
    left = below.groupBy("generation").agg(F.count("*").alias("left"), F.count_if(behind).alias("behind"))
    mode = F.when(F.col("behind") > 0, "sweep").when(F.col("left") > switch * k, "lap").otherwise("tail")
    taken = busy.filter("rack is not null").select("generation", "rack", F.lit(True).alias("busy")).distinct()
    rows = below.withColumn("behind_cursor", behind).join(left.select("generation", mode.alias("mode")), "generation").join(taken, ["generation", "rack"], "left")
    rows = rows.filter((F.col("mode") == "lap") | ((F.col("mode") == "sweep") & F.col("behind_cursor")) | ((F.col("mode") == "tail") & F.col("busy").isNull()))
    first = F.when(F.col("mode") == "tail", F.col("n")).otherwise(0)
    place = F.row_number().over(W.partitionBy("generation").orderBy(first, "rack"))
    return rows.withColumn("place", place).filter(F.col("place") <= k).select("generation", "mode", F.col("place").cast("long").alias("place"), "rack", "n")
