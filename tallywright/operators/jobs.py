"""Jobs: statistics, progress and pace, lists with the stalled flag, and shares of the allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .coverage import target_of

HOUR = 3600


def job_stats(jobs: DataFrame, claims: DataFrame, results: DataFrame) -> DataFrame:
    """One wide row per job: claims by state, compute time, moves, games; each family is one aggregate, then joined."""
    counted = claims.groupBy("job_id").agg(
        F.count("*").alias("claims"),
        *(F.count_if(F.col("state") == s).alias(s) for s in ("completed", "claimed", "abandoned", "declined")),
        F.coalesce(F.sum(F.when(F.col("state") == "completed", F.col("held_ms"))), F.lit(0)).alias("compute_ms"),
        F.coalesce(F.sum(F.when(F.col("state") == "completed", F.col("movegens"))), F.lit(0)).alias("movegens"),
    )
    played = results.groupBy("job_id").agg(F.count("*").alias("batches"), F.sum("games").alias("games"))
    numbers = [c for c in (*counted.columns, *played.columns) if c != "job_id"]
    return jobs.select("job_id", "job_type", "status").join(counted, "job_id", "left").join(played, "job_id", "left").fillna(0, numbers)


def throughput(claims: DataFrame, as_of, activated_at=None) -> DataFrame:
    """Per job: completions in the trailing hour, or since activation if that is later; the window is a minute at least."""
    since = F.unix_micros(as_of) / 1e6 - (F.unix_micros(activated_at) / 1e6 if activated_at is not None else F.lit(0.0))
    window = F.greatest(F.lit(60.0), F.least(F.lit(float(HOUR)), since))
    recent = claims.filter((F.col("state") == "completed") & (F.unix_micros("completed_at") > F.unix_micros(as_of) - window * 1e6) & (F.col("completed_at") <= as_of))
    return recent.groupBy("job_id").agg(F.count("*").alias("recent")).withColumn("per_second", F.col("recent") / window)


def job_progress(jobs: DataFrame, results: DataFrame, claims: DataFrame, as_of) -> DataFrame:
    """Per match job: units played, fraction of the cap, and seconds left at the pace of the trailing hour (none without it)."""
    units = results.groupBy("job_id").agg(F.sum("games").alias("games"), F.avg("games").alias("batch"))
    rows = jobs.filter("job_type in ('games', 'game_pairs')").join(units, "job_id", "left").join(throughput(claims, as_of), "job_id", "left")
    played = F.coalesce(F.when(F.col("job_type") == "game_pairs", F.col("games") / 2).otherwise(F.col("games").cast("double")), F.lit(0.0))
    pace = F.col("per_second") * F.when(F.col("job_type") == "game_pairs", F.col("batch") / 2).otherwise(F.col("batch"))
    return rows.select("job_id", played.alias("units"), F.least(F.lit(1.0), played / F.col("max_units")).alias("fraction"), F.greatest(F.lit(0.0), F.try_divide(F.col("max_units") - played, pace)).alias("eta_seconds"))


def fewest_to_settle(margin, most) -> F.col:
    """The fewest analyses that can settle a key."""
    return F.greatest(F.lit(1), F.when(most > 1, F.least(margin, most)).otherwise(1))


def other_progress(jobs: DataFrame, standings: DataFrame, generations: DataFrame, claims: DataFrame, as_of) -> DataFrame:
    """Per rack or leave job: units (settled racks or closed generations) of their total; pace an hour and seconds left of active ones.

    jobs: per_claim (racks or games of a claim), total, margin, most; standings: job_id, settled; generations: job_id,
    closed. Racks left take the fewest analyses each, racks under way one; games of leave jobs tell no time left.
    """
    racks = standings.groupBy("job_id").agg(F.count("*").alias("analysed"), F.count_if("settled").alias("settled"))
    closed = generations.groupBy("job_id").agg(F.count_if("closed").alias("closed"))
    rows = jobs.filter("job_type in ('opening_rack', 'leave_gen')").join(racks, "job_id", "left").join(closed, "job_id", "left")
    rows = rows.fillna(0, ["analysed", "settled", "closed"]).join(throughput(claims, as_of), "job_id", "left")
    of_racks = F.col("job_type") == "opening_rack"
    pace = F.when(F.col("status") == "active", F.col("per_second") * F.greatest(F.lit(1), F.col("per_claim")))
    new, under_way = F.greatest(F.lit(0), F.col("total") - F.col("analysed")), F.greatest(F.lit(0), F.col("analysed") - F.col("settled"))
    units = F.when(of_racks, F.col("settled")).otherwise(F.col("closed"))
    left = new * fewest_to_settle(F.col("margin"), F.col("most")) + under_way
    fraction = F.least(F.lit(1.0), F.try_divide(units, F.col("total")))
    return rows.select("job_id", "job_type", units.alias("units"), F.col("total").alias("max_units"), fraction.alias("fraction"), (pace * HOUR).alias("per_hour"), F.when(of_racks, left / pace).alias("eta_seconds"))


def stalled_jobs(jobs: DataFrame, claims: DataFrame, gaps: DataFrame, as_of) -> DataFrame:
    """Active jobs with a data gap in the last day, no completion in it and no open claim."""
    day = as_of - F.expr("INTERVAL 1 DAY")
    gap = gaps.filter(F.col("reported_at") > day).select("job_id")
    done = claims.filter((F.col("state") == "completed") & (F.col("completed_at") > day)).select("job_id")
    open_claims = claims.filter("state = 'claimed'").select("job_id")
    return jobs.filter("status = 'active'").join(gap, "job_id", "left_semi").join(done, "job_id", "left_anti").join(open_claims, "job_id", "left_anti")


def job_list(jobs: DataFrame, results: DataFrame, stalled: DataFrame, limit: int, offset: int) -> DataFrame:
    """A page of jobs, active first, then paused, then completed; newest first, with display name and units."""
    units = results.groupBy("job_id").agg(F.sum("games").alias("games"))
    versus = F.concat_ws(" vs ", "p1_name", "p2_name")
    name = F.when(F.col("title").isNotNull(), F.concat_ws(": ", "title", versus)).otherwise(versus)
    played = F.coalesce(F.when(F.col("job_type") == "game_pairs", F.floor(F.col("games") / 2)).otherwise(F.col("games")), F.lit(0)).cast("long")
    rank = F.when(F.col("status") == "active", 0).when(F.col("status") == "paused", 1).otherwise(2)
    rows = jobs.join(units, "job_id", "left").join(stalled.select("job_id", F.lit(True).alias("stalled")), "job_id", "left")
    return rows.orderBy(rank, F.desc("job_id")).offset(offset).limit(limit).select("job_id", "status", name.alias("name"), played.alias("units"), F.coalesce("stalled", F.lit(False)).alias("stalled"))


def job_units(jobs: DataFrame, results: DataFrame, standings: DataFrame, generations: DataFrame) -> DataFrame:
    """(job_id, job_type, units, of): what a job has done and is to do, in its type's unit: games, pairs, settled racks or closed generations.

    jobs: max_units, racks and generations, of which each type reads its own; standings: job_id, settled; generations: job_id, closed.
    """
    parts = [results.groupBy("job_id").agg(F.sum("games").alias("games")), standings.groupBy("job_id").agg(F.count_if("settled").alias("settled")), generations.groupBy("job_id").agg(F.count_if("closed").alias("closed"))]
    rows = jobs
    for part in parts:
        rows = rows.join(part, "job_id", "left")
    rows = rows.fillna(0, ["games", "settled", "closed"])
    kind = F.col("job_type")
    units = F.when(kind == "games", F.col("games")).when(kind == "game_pairs", F.floor(F.col("games") / 2)).when(kind == "opening_rack", F.col("settled")).when(kind == "leave_gen", F.col("closed"))
    of = F.when(kind.isin("games", "game_pairs"), F.col("max_units")).when(kind == "opening_rack", F.col("racks")).when(kind == "leave_gen", F.col("generations"))
    return rows.select("job_id", "job_type", units.cast("long").alias("units"), of.cast("long").alias("of"))


def version_key(text) -> F.col:
    """Major, minor and patch as numbers; what can't be read counts as 0."""
    parts = F.split(text, r"\.")
    return F.struct(*(F.coalesce(F.when(F.get(parts, F.lit(i)).rlike("^[0-9]+$"), F.get(parts, F.lit(i)).try_cast("long")), F.lit(0).cast("long")).alias(n) for i, n in enumerate(("major", "minor", "patch"))))


def allocation_report(jobs: DataFrame, claims: DataFrame, serving_seconds: int, least_version: str) -> DataFrame:
    """Per active job: claims issued, ratio of issued (less baseline) to allocation, rank by ratio, and the joining ratio.

    A joining job starts at the least ratio of the jobs last claimed within `serving_seconds` of the latest claim, else
    at the greatest, else at 0. Claims of versions below the least one don't count.
    """
    allowed = claims.filter(version_key(F.col("version")) >= version_key(F.lit(least_version)))
    issued = allowed.groupBy("job_id").agg(F.count("*").alias("issued"), F.max(F.unix_micros("claimed_at")).alias("last_us"))
    rows = jobs.filter("status = 'active'").join(issued, "job_id", "left").withColumn("ratio", (F.coalesce("issued", F.lit(0)) - F.col("baseline")) / F.col("allocation"))
    everyone = W.partitionBy()  # a row per active job
    rows = rows.withColumn("served", F.col("last_us") >= F.max("last_us").over(everyone) - serving_seconds * 1_000_000)
    join = F.coalesce(F.min(F.when(F.col("served"), F.col("ratio"))).over(everyone), F.max("ratio").over(everyone), F.lit(0.0))
    return rows.select("job_id", F.coalesce("issued", F.lit(0)).alias("issued"), "ratio", F.rank().over(W.orderBy("ratio")).cast("long").alias("place"), join.alias("joining_ratio"))


def task_states(claims: DataFrame) -> DataFrame:
    """Per task: completed if any claim is, else in progress if one is open, else pending; with when it was completed."""
    rows = claims.groupBy("task_id").agg(F.count_if(F.col("state") == "completed").alias("accepted"), F.count_if(F.col("state") == "claimed").alias("open"), F.max("completed_at").alias("at"))
    state = F.when(F.col("accepted") > 0, "completed").when(F.col("open") > 0, "in_progress").otherwise("pending")
    return rows.select("task_id", "accepted", "open", state.alias("state"), F.unix_micros("at").alias("completed_us"))


def job_details(jobs: DataFrame, tasks: DataFrame, progress: DataFrame, audit: DataFrame, targets: list[int]) -> DataFrame:
    """One row per job: its tasks by state, first passes and reissues among the completed, its generation, and its completion.

    tasks: job_id, seed, state; jobs: first_pass (seeds below it are first passes); progress: job_id, generation, rack, n. The
    generation is the first with a key below its target, one behind the last when all are done. The completion is the last
    'job.completed' of a completed job: when, and whether somebody forced it.
    """
    done = F.col("state") == "completed"
    of_tasks = tasks.join(jobs.select("job_id", "first_pass"), "job_id").groupBy("job_id").agg(
        F.count("*").alias("tasks"), *(F.count_if(F.col("state") == s).alias(s) for s in ("completed", "in_progress", "pending")),
        F.count_if(done & (F.col("seed") < F.col("first_pass"))).alias("first_passes"), F.count_if(done & (F.col("seed") >= F.col("first_pass"))).alias("reissues"),
    )
    below = progress.groupBy("job_id", "generation").agg(F.count_if(F.col("n") < target_of(F.col("generation"), targets)).alias("below"))
    generation = below.groupBy("job_id").agg(F.coalesce(F.min(F.when(F.col("below") > 0, F.col("generation"))), F.max("generation") + 1).alias("generation"))
    ended = audit.filter("action = 'job.completed'").groupBy("job_id").agg(F.max_by(F.struct(F.unix_micros("created_at").alias("completed_us"), F.col("actor").isNotNull().alias("forced")), "audit_id").alias("e"))
    rows = jobs.select("job_id", "job_type", "status").join(of_tasks, "job_id", "left").join(generation, "job_id", "left").join(ended, "job_id", "left")
    over = F.col("status") == "completed"
    counts = ["tasks", "completed", "in_progress", "pending", "first_passes", "reissues"]
    return rows.fillna(0, counts).select("job_id", "job_type", "status", *counts, F.when(F.col("job_type") == "leave_gen", F.col("generation")).alias("generation"), F.when(over, F.col("e.completed_us")).alias("completed_us"), F.when(over, F.col("e.forced")).alias("forced"))
