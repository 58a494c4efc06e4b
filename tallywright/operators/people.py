"""Contributors: sums, leaderboards, contributions by type, pseudonyms and bans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pseudonym(identity: Column) -> Column:
    """The first 16 hexadecimal digits of the identity's SHA-256."""
    return F.substring(F.sha2(identity.cast("string"), 256), 1, 16)


def resolve_pseudonym(contributors: DataFrame, name: str) -> DataFrame:
    """Contributors behind a pseudonym; none if it hasn't the shape of one."""
    return contributors.filter(F.lit(name).rlike("^[0-9a-f]{16}$") & (pseudonym(F.col("worker")) == name))


def resolve_pseudonyms(contributors: DataFrame, names: DataFrame) -> DataFrame:
    """Contributors behind any number of pseudonyms (name), with them; a name that hasn't the shape of one is nobody's."""
    asked = names.filter(F.col("name").rlike("^[0-9a-f]{16}$")).select("name").distinct()
    return contributors.withColumn("name", pseudonym(F.col("worker"))).join(asked, "name", "left_semi")


def totals(claims: DataFrame) -> DataFrame:
    """Per contributor: completed tasks, milliseconds, moves generated and the last completion."""
    done = claims.filter("state = 'completed'")
    return done.groupBy("worker", "is_anon").agg(F.count("*").alias("tasks"), F.sum("held_ms").alias("compute_ms"), F.sum("movegens").alias("movegens"), F.max("completed_at").alias("last_at"))


def contributors(claims: DataFrame, job: int | None = None, top: int = 50) -> DataFrame:
    """The top contributors, with how many there are in all; anonymous ones by pseudonym."""
    rows = totals(claims if job is None else claims.filter(F.col("job_id") == job))
    name = F.when(F.col("is_anon"), pseudonym(F.col("worker"))).otherwise(F.concat(F.lit("user"), F.col("worker").cast("string")))
    # two small steps: the number of groups, and the top of them, which alone are named
    everyone = rows.agg(F.count("*").alias("contributors"))
    first = rows.orderBy(F.desc("tasks"), F.asc("worker")).limit(top)
    return first.join(F.broadcast(everyone)).select(name.alias("name"), "tasks", "compute_ms", "movegens", "contributors")


def leaderboard(claims: DataFrame, by: str, limit: int, offset: int) -> DataFrame:
    """A page of both kinds of contributors merged, ranked by one column; ties by kind and id."""
    if by not in ("tasks", "compute_ms", "movegens"):
        raise ValueError(f"can't rank by {by}")
    order = [F.desc(by), F.asc("is_anon"), F.asc("worker")]
    kinds = [totals(claims.filter(F.col("is_anon") == anon)).orderBy(*order).limit(limit + offset) for anon in (False, True)]
    return kinds[0].unionByName(kinds[1]).orderBy(*order).offset(offset).limit(limit).select("worker", "is_anon", "tasks", "compute_ms", "movegens")


def contributions_by_type(claims: DataFrame, jobs: DataFrame, types: list[str]) -> DataFrame:
    """Per job type: tasks, milliseconds and contributors; absent types are zero. Claims are summed per job first."""
    done = claims.filter("state = 'completed'")
    per_job = done.groupBy("job_id", "worker", "is_anon").agg(F.count("*").alias("tasks"), F.sum("held_ms").alias("compute_ms"))
    per_type = per_job.join(jobs.select("job_id", "job_type"), "job_id").groupBy("job_type").agg(F.sum("tasks").alias("tasks"), F.sum("compute_ms").alias("compute_ms"), F.count_distinct("worker", "is_anon").alias("contributors"))
    known = claims.sparkSession.range(1).select(F.explode(F.lit(types)).alias("job_type"))
    return known.join(per_type, "job_type", "left").fillna(0, ["tasks", "compute_ms", "contributors"])


def contributor_feed(claims: DataFrame, worker: int, before, limit: int) -> DataFrame:
    """Newest completed claims of a contributor behind the key (completed_at, claim_id)."""
    at, claim = before
    mine = claims.filter((F.col("worker") == worker) & (F.col("state") == "completed"))
    behind = (F.col("completed_at") <= at) & ~((F.col("completed_at") == at) & (F.col("claim_id") >= claim))
    return mine.filter(behind).orderBy(F.desc("completed_at"), F.desc("claim_id")).limit(limit)


def ban_status(claims: DataFrame, bans: DataFrame) -> DataFrame:
    """Contributors with their number of claims and whether they are banned."""
    rows = claims.groupBy("worker").agg(F.count("*").alias("claims"))
    return rows.join(bans.select(F.col("target").alias("worker"), F.lit(True).alias("banned")).distinct(), "worker", "left").fillna(False, ["banned"])


def overrun_streak(claims: DataFrame, trip: int = 3) -> DataFrame:
    """Per job: the longest run of abandoned claims without a completion between, and whether it trips."""
    # completions before a claim: those of earlier days, summed by day, and those of its own day; no window holds a whole job
    rows = claims.filter("state in ('completed', 'abandoned')").withColumn("day", F.coalesce(F.to_date("claimed_at"), F.lit("0001-01-01").cast("date")))
    done = F.count_if(F.col("state") == "completed")
    days = rows.groupBy("job_id", "day").agg(done.alias("done"))
    earlier = F.coalesce(F.sum("done").over(W.partitionBy("job_id").orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = done.over(W.partitionBy("job_id", "day").orderBy("claimed_at", "claim_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("own", own).join(days.select("job_id", "day", earlier.alias("earlier")), ["job_id", "day"])
    runs = rows.withColumn("island", F.col("own") + F.col("earlier")).filter("state = 'abandoned'").groupBy("job_id", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("job_id").agg(F.max("n").alias("longest"), F.count_if(F.col("n") >= trip).alias("trips"))


def lapsed_claims(claims: DataFrame, as_of, silent_seconds: int, grace_seconds: int) -> DataFrame:
    """Open claims that fell silent or are past deadline and grace at an instant, with whether they overran."""
    open_claims = claims.filter("state = 'claimed'")
    age = F.unix_micros(as_of) - F.unix_micros("claimed_at")
    late = age > (F.col("held_ms") * 1000 + grace_seconds * 1_000_000)
    return open_claims.filter((age > silent_seconds * 1_000_000) | late).select("claim_id", "job_id", late.alias("overran"))
