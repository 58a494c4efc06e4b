"""Facts as streams: running counters, one result per task, staged merges, late results, lapses, streaks and verdicts.

Folds write through foreachBatch under the batch's number, so a batch that is run again replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import PENT
from ..operators.coverage import fold, target_of
from ..operators.outcomes import with_test
from ..operators.ratings import pool_evidence, rate_pools
from ..scratch import scratch, written  # noqa: F401


def replayed(df: DataFrame, folder: str, files: int, *order: str | Column, at_once: int = 1, number: str | None = None) -> DataFrame:
    """A table as a stream of so many files in the order of columns, at_once files a batch; number: a column for the file's place in the order."""
    rows = df.repartitionByRange(files, *order).sortWithinPartitions(*order)
    rows = rows.withColumn(number, F.spark_partition_id()) if number else rows
    rows.write.parquet(folder)
    return df.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", at_once).option("latestFirst", "false").parquet(folder)


def in_order(df: DataFrame, folder: str, files: int, at_once: int, column: str) -> DataFrame:
    """A table as a stream whose batches come in the order of a column.

    A file source takes files by their age, and tasks of one write end in any order; so rows are dealt into ranges once, and
    the ranges of a batch are appended when those of the batch before are there.
    """
    rows = df.repartitionByRange(files, column).withColumn("_batch_", F.floor(F.spark_partition_id() / at_once).cast("int"))
    rows.write.partitionBy("_batch_").parquet(f"{folder}-ranges")
    held = df.sparkSession.read.schema(rows.schema).parquet(f"{folder}-ranges")
    for batch in range(-(-files // at_once)):  # reads the files of the batch only
        held.filter(F.col("_batch_") == batch).drop("_batch_").repartition(at_once).write.mode("append").parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", at_once).parquet(folder)


def fed(spark: SparkSession, parts: list[DataFrame], folder: str, write: Callable[[DataFrame, int], None]) -> None:
    """Parts as the batches of one stream: each comes when the one before is done, as far as its checkpoint tells."""
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        drained(spark.readStream.schema(part.schema).parquet(f"{folder}/in"), folder, write)


def drained(stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> None:
    """Run a stream until what is there is done."""
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    out = out.foreachBatch(write) if write else out.format("parquet").option("path", f"{folder}/out")
    query = out.start()
    query.awaitTermination()


def upsert(folder: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """Write each batch's changed rows under its number; `current` reads the newest row of each key."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")

    return write


def current(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/changes")
    newest = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("batch")))
    return rows.withColumn("newest", newest).filter("newest = 1").drop("newest", "batch")


def job_counters(claims: DataFrame) -> DataFrame:
    """Running counters per job; update mode."""
    return claims.groupBy("job_id").agg(F.count_if(F.col("state") == "completed").alias("completed"), F.coalesce(F.sum(F.when(F.col("state") == "completed", F.col("movegens"))), F.lit(0)).alias("movegens"))


def contributor_counters(claims: DataFrame) -> DataFrame:
    """Running counters per contributor, both kinds of identity; update mode."""
    return claims.filter("state = 'completed'").groupBy("worker", "is_anon").agg(F.count("*").alias("tasks"), F.sum("held_ms").alias("compute_ms"))


def accepted_once(claims: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first completed claim of each task within the watermark; later ones are refused."""
    return claims.filter("state = 'completed'").withWatermark("claimed_at", delay).dropDuplicatesWithinWatermark(["task_id"])


def trailing_throughput(claims: DataFrame, every: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Completions per job and hour, every so often; a window is told once, when the watermark has passed its end."""
    done = claims.filter("state = 'completed'").withWatermark("completed_at", delay)
    return done.groupBy("job_id", F.window("completed_at", "1 hour", every)).agg(F.count("*").alias("recent")).select("job_id", "window.start", "window.end", "recent")


def fold_staged(folder: str, first: DataFrame) -> Callable[[DataFrame, int], None]:
    """Fold each batch of staged arrays into progress; a batch writes the keys that it changes, with their new sums.

    A batch that is run again reads what earlier batches wrote and replaces its own rows, so nothing counts twice.
    """
    first.write.mode("overwrite").parquet(f"{folder}/progress/batch=-1")

    def write(staged: DataFrame, batch: int) -> None:
        new = fold(staged).withColumnsRenamed({"n": "dn", "equity_cents": "de"})
        held = newest(staged.sparkSession.read.parquet(f"{folder}/progress").filter(F.col("batch") < batch).join(new.select("generation", "rack"), ["generation", "rack"], "left_semi"))
        changed = held.join(new, ["generation", "rack"]).select("generation", "rack", (F.col("n") + F.col("dn")).alias("n"), (F.col("equity_cents") + F.col("de")).alias("equity_cents"))
        changed.write.mode("overwrite").parquet(f"{folder}/progress/batch={batch}")

    return write


def newest(progress: DataFrame) -> DataFrame:
    """The last row of each key, by partial maxima."""
    return progress.groupBy("generation", "rack").agg(F.max_by(F.struct("n", "equity_cents"), "batch").alias("last")).select("generation", "rack", "last.*")


def latest_progress(spark: SparkSession, folder: str) -> DataFrame:
    return newest(spark.read.parquet(f"{folder}/progress"))


def split_late(folder: str, closed: DataFrame) -> Callable[[DataFrame, int], None]:
    """Results of closed generations go aside: they are credited, not folded."""

    def write(rows: DataFrame, batch: int) -> None:
        late = rows.join(closed.select("generation", F.lit(True).alias("late")), "generation", "left").withColumn("late", F.coalesce("late", F.lit(False)))
        late.write.mode("overwrite").partitionBy("late").parquet(f"{folder}/split/batch={batch}")

    return write


def complete_generations(progress: DataFrame, targets: list[int], in_flight: DataFrame, staged: DataFrame) -> DataFrame:
    """Generations with every key at target, nothing in flight and nothing staged."""
    done = progress.groupBy("generation").agg(F.min(F.col("n") >= target_of(F.col("generation"), targets)).alias("all")).filter("all").select("generation")
    return done.join(in_flight.select("generation"), "generation", "left_anti").join(staged.select("generation"), "generation", "left_anti")


def close_generations(folder: str, universe: DataFrame, targets: list[int]) -> Callable[[DataFrame, int], None]:
    """After each batch of messages, the generations that are complete then and weren't before; a closing stays.

    Messages (generation, kind, rack, n): kind 'count' adds n to a key of the universe, 'open' and 'staged' add n to what is
    in flight and staged. Each batch adds its sums; the state is the sum over batches, so a batch that runs again replaces
    its own.
    """

    def write(messages: DataFrame, batch: int) -> None:
        spark = messages.sparkSession
        messages.groupBy("generation", "kind", "rack").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{folder}/sums/batch={batch}")
        sums = spark.read.parquet(f"{folder}/sums").filter(F.col("batch") <= batch)
        counts = universe.select("generation", "rack", F.lit(0).cast("long").alias("n")).unionByName(sums.filter("kind = 'count'").select("generation", "rack", "n").join(universe, ["generation", "rack"], "left_semi"))
        pending = [sums.filter(F.col("kind") == k).groupBy("generation").agg(F.sum("n").alias("n")).filter("n > 0") for k in ("open", "staged")]
        now = complete_generations(counts.groupBy("generation", "rack").agg(F.sum("n").alias("n")), targets, *pending)
        if batch:
            now = now.join(spark.read.parquet(f"{folder}/closed").filter(F.col("batch") < batch), "generation", "left_anti")
        now.write.mode("overwrite").parquet(f"{folder}/closed/batch={batch}")

    return write


def fingerprints(evidence: DataFrame, members: DataFrame) -> DataFrame:
    """(pool, content): a hash of a pool's evidence and members that doesn't depend on order."""
    one = evidence.select("pool", F.xxhash64(*[c for c in evidence.columns if c != "pool"]).alias("h"))
    two = members.select("pool", F.xxhash64(F.lit("member"), "config").alias("h"))
    return one.unionByName(two).groupBy("pool").agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("content"))


def stale_pools(now: DataFrame, fitted: DataFrame) -> DataFrame:
    """(pool, content) of the pools whose fingerprint isn't that of their last fit (fitted: pool, content)."""
    before = fitted.select("pool", F.col("content").alias("before"))
    return now.join(before, "pool", "left").filter(~F.col("content").eqNullSafe(F.col("before"))).select("pool", "content")


def refit(folder: str, jobs: DataFrame, pools: DataFrame, members: Callable[[int], DataFrame]) -> Callable[[DataFrame, int], None]:
    """After each batch of results: rate the pools whose evidence or members changed since their last run, and no others.

    Evidence is kept as sums per batch. A run is the ratings of one pool under the batch's number and the fingerprint that
    they were fitted to; members(batch) are the members at that time.
    """

    def write(results: DataFrame, batch: int) -> None:
        spark = results.sparkSession
        pool_evidence(results, jobs, pools, pools_members).write.mode("overwrite").parquet(f"{folder}/evidence/batch={batch}")
        parts = spark.read.parquet(f"{folder}/evidence").filter(F.col("batch") <= batch)
        current = members(batch)
        for side in ("a", "b"):
            parts = parts.join(current.select("pool", F.col("config").alias(side)), ["pool", side], "left_semi")
        evidence = parts.groupBy("pool", "a", "b").agg(*(F.sum(c).alias(c) for c in (*PENT, "games", "spread_sum")))
        fitted = spark.read.schema("pool long, content decimal(38,0), batch int").parquet(f"{folder}/fits") if batch else spark.createDataFrame([], "pool long, content decimal(38,0), batch int")
        last = fitted.filter(F.col("batch") < batch).groupBy("pool").agg(F.max_by("content", "batch").alias("content"))
        stale = written(stale_pools(fingerprints(evidence, current), last), f"{folder}/stale/{batch}")
        chosen = [x.join(stale.select("pool"), "pool", "left_semi") for x in (evidence, current, pools)]
        rate_pools(*chosen).write.mode("overwrite").parquet(f"{folder}/runs/batch={batch}")
        stale.write.mode("overwrite").parquet(f"{folder}/fits/batch={batch}")

    # evidence of everyone who is ever a member
    pools_members = members(1 << 30)
    return write


def fold_streaks(folder: str) -> Callable[[DataFrame, int], None]:
    """Sum up each batch of claims per job and slice: abandoned claims before the first and after the last completion, and the longest run.

    Slices are ranges of (claimed_at, claim_id) that don't overlap; they may come in any order, each whole in one batch.
    """

    def write(claims: DataFrame, batch: int) -> None:
        place = F.struct(F.col("claimed_at").isNull().alias("open"), "claimed_at", "claim_id")
        so_far = W.partitionBy("job_id", "slice").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
        rows = claims.select("job_id", "slice", "state", place.alias("place"))
        rows = rows.withColumn("island", F.count_if(F.col("state") == "completed").over(so_far))
        runs = rows.groupBy("job_id", "slice", "island").agg(F.count_if(F.col("state") == "abandoned").alias("n"))
        parts = runs.groupBy("job_id", "slice").agg(F.max("island").alias("completed"), F.min_by("n", "island").alias("first"), F.min("island").alias("opens"), F.max_by("n", "island").alias("last"), F.max("n").alias("longest"))
        # a slice that opens with a completion has no run before it
        parts = parts.withColumn("first", F.when(F.col("opens") == 0, F.col("first")).otherwise(F.lit(0))).drop("opens")
        parts.write.mode("overwrite").parquet(f"{folder}/slices/batch={batch}")

    return write


def streaks(spark: SparkSession, folder: str, trip: int = 3) -> DataFrame:
    """Per job: abandoned claims in a row since the last completion and the longest run so far, from the slices' sums."""
    before = W.partitionBy("job_id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    parts = spark.read.parquet(f"{folder}/slices").withColumn("island", F.count_if(F.col("completed") > 0).over(before))
    ends = F.array(F.struct("island", F.col("first").alias("n")), F.when(F.col("completed") > 0, F.struct((F.col("island") + 1).alias("island"), F.col("last").alias("n"))))
    runs = parts.select("job_id", "longest", F.explode(F.filter(ends, lambda e: e.isNotNull())).alias("e")).groupBy("job_id", "e.island").agg(F.sum("e.n").alias("n"), F.max("longest").alias("longest"))
    out = runs.groupBy("job_id").agg(F.max_by("n", "island").alias("run"), F.greatest(F.max("n"), F.max("longest")).alias("longest"))
    return out.withColumn("tripped", F.col("longest") >= trip)


def latch_verdicts(folder: str, jobs: DataFrame, sums: list[str]) -> Callable[[DataFrame, int], None]:
    """After each batch of results: add the sums, test them, and keep each job's first verdict for good."""

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        new = rows.groupBy("job_id").agg(*(F.sum(c).alias(c) for c in sums))
        if batch:
            old = spark.read.parquet(f"{folder}/verdicts/version={batch - 1}")
            new = old.select("job_id", *sums).unionByName(new).groupBy("job_id").agg(*(F.sum(c).alias(c) for c in sums)).join(old.select("job_id", "verdict"), "job_id", "left")
        else:
            new = new.withColumn("verdict", F.lit(None).cast("string"))
        tested = with_test(new.join(jobs, "job_id")).withColumn("verdict", F.coalesce("verdict", F.when(F.col("status") != "running", F.col("status"))))
        tested.select("job_id", *sums, "verdict").write.mode("overwrite").parquet(f"{folder}/verdicts/version={batch}")

    return write
