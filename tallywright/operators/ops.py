"""Repair and audit: recounts against stored counters, manifests, replays of actions, and anonymised copies."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .jobs import task_states

SCRUBBED = "[scrubbed]"


def recount(claims: DataFrame) -> DataFrame:
    """What contributors' counters should be, both kinds of identity."""
    done = claims.filter("state = 'completed'")
    return done.groupBy("worker", "is_anon").agg(F.count("*").alias("tasks"), F.sum("held_ms").alias("compute_ms"), F.sum("movegens").alias("movegens"))


def differences(stored: DataFrame, facts: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys whose stored values differ from the facts; absent ones count as 0."""
    both = stored.join(facts.withColumnsRenamed({v: f"fact_{v}" for v in values}), keys, "full").fillna(0, [*values, *(f"fact_{v}" for v in values)])
    return both.filter(~F.struct(*values).eqNullSafe(F.struct(*(f"fact_{v}" for v in values))))


def reconcile_counters(stored: DataFrame, claims: DataFrame) -> DataFrame:
    """Contributors whose stored counters don't match their claims."""
    return differences(stored, recount(claims), ["worker", "is_anon"], ["tasks", "compute_ms", "movegens"])


def reconcile_jobs(stored: DataFrame, claims: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs whose stored counters of finished tasks and games don't match the facts; each fact table is summed by job before they meet."""
    done = claims.filter("state = 'completed'").groupBy("job_id").agg(F.count("*").alias("tasks"))
    played = results.groupBy("job_id").agg(F.sum("games").alias("games"))
    facts = done.join(played, "job_id", "full").fillna(0, ["tasks", "games"])
    return differences(stored, facts, ["job_id"], ["tasks", "games"])


def reconcile_tasks(stored: DataFrame, claims: DataFrame) -> DataFrame:
    """Tasks whose stored counters or state don't follow from their claims; a task without claims is pending."""
    facts = task_states(claims).select("task_id", *(F.col(c).alias(f"fact_{c}") for c in ("accepted", "open", "state")))
    held = stored.select("task_id", "accepted", "open", "state")
    both = held.join(facts, "task_id", "full").fillna(0, ["fact_accepted", "fact_open"]).fillna("pending", ["fact_state"])
    return both.filter(~F.struct("accepted", "open", "state").eqNullSafe(F.struct("fact_accepted", "fact_open", "fact_state")))


def give_back(counters: DataFrame, claims: DataFrame, job: int) -> DataFrame:
    """Counters less what a purged job earned, never below 0."""
    earned = recount(claims.filter(F.col("job_id") == job)).withColumnsRenamed({v: f"e_{v}" for v in ("tasks", "compute_ms", "movegens")})
    rows = counters.join(earned, ["worker", "is_anon"], "left")
    return rows.select("worker", "is_anon", *(F.greatest(F.lit(0), F.col(v) - F.coalesce(f"e_{v}", F.lit(0))).alias(v) for v in ("tasks", "compute_ms", "movegens")))


def tagged_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): rows of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def census(tables: dict[str, DataFrame], job: int) -> DataFrame:
    """Rows of a job in each table."""
    return tagged_counts({k: df.filter(F.col("job_id") == job) for k, df in tables.items()})


def row_manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of all tables as one JSON object."""
    return tagged_counts(tables).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n"))))).alias("row_counts"))


def manifest_total(manifest: DataFrame) -> DataFrame:
    """Sum of a manifest's counts; 0 where it isn't an object."""
    counts = F.coalesce(F.map_values(F.from_json("row_counts", "map<string,bigint>")), F.array().cast("array<bigint>"))
    return manifest.select("row_counts", F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + F.coalesce(b, F.lit(0).cast("long"))).alias("total"))


def manifest_compare(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Tables whose recorded and actual counts differ, with those that only one side has."""
    both = manifest.select("name", F.col("n").alias("recorded")).join(actual.select("name", F.col("n").alias("actual")), "name", "full")
    return both.filter(~F.col("recorded").eqNullSafe(F.col("actual")))


def created_since(tables: dict[str, tuple[DataFrame, str]], since) -> DataFrame:
    """Rows of each table that are newer than an instant."""
    return tagged_counts({k: df.filter(F.col(at) > since) for k, (df, at) in tables.items()})


def audit_search(audit: DataFrame, limit: int, offset: int = 0, **only) -> DataFrame:
    """A page of the audit log, newest first, filtered by the given columns only, with the total of the filter."""
    for column, value in only.items():
        if value is not None:
            audit = audit.filter(F.col(column) == value)
    total = audit.agg(F.count("*").alias("total"))
    page = audit.orderBy(F.desc("created_at"), F.desc("audit_id")).offset(offset).limit(limit)
    return page.join(F.broadcast(total))


def destructive_actions(audit: DataFrame, limit: int = 20) -> DataFrame:
    """The last bans, deletions and censuses."""
    return audit.filter(F.col("action").isin("user.ban", "job.delete") | F.col("action").like("%.census")).orderBy(F.desc("created_at"), F.desc("audit_id")).limit(limit)


def busiest(audit: DataFrame, limit: int = 40) -> DataFrame:
    """The largest groups of actor and action."""
    return audit.groupBy("actor", "action").agg(F.count("*").alias("n"), F.count_distinct(F.struct("target", "job_id")).alias("subjects")).orderBy(F.desc("n"), "actor", "action").limit(limit)


def replay_actions(fresh: DataFrame, snapshot: DataFrame, excluded_ids: DataFrame, excluded_actors: DataFrame) -> DataFrame:
    """Per target: the last action since a snapshot, without excluded actions and actors."""
    new = fresh.join(snapshot.select("audit_id"), "audit_id", "left_anti").join(excluded_ids.select("audit_id"), "audit_id", "left_anti").join(excluded_actors.select("actor"), "actor", "left_anti")
    return new.groupBy("target").agg(F.max_by(F.struct("action", "actor"), "audit_id").alias("last"), F.count("*").alias("actions")).select("target", "last.*", "actions")


def apply_actions(dimension: DataFrame, actions: DataFrame, on: list[str], off: list[str], gone: list[str]) -> DataFrame:
    """A dimension (target, banned, ...) after actions: the last one that bans or lifts a ban decides, and a deletion drops the row; without any, what was stored stays."""
    bans = F.when(F.col("action").isin(on), True).when(F.col("action").isin(off), False)
    last = actions.groupBy("target").agg(F.max(F.when(bans.isNotNull(), F.struct("audit_id", bans.alias("now")))).alias("last"), F.max(F.col("action").isin(gone)).alias("gone"))
    rows = dimension.join(last, "target", "left").filter("not coalesce(gone, false)")
    return rows.withColumn("banned", F.coalesce("last.now", "banned")).drop("last", "gone")


def anonymise(claims: DataFrame, salt: str) -> DataFrame:
    """Claims with workers replaced through a mapping of the distinct ones, and no versions."""
    mapping = claims.select("worker").distinct().withColumn("key", F.substring(F.sha2(F.concat(F.lit(salt), F.col("worker").cast("string")), 256), 1, 12))
    return claims.join(mapping, "worker").select("claim_id", "job_id", F.col("key").alias("worker"), F.lit(None).cast("string").alias("version"))


def anonymised(table: DataFrame, salt: str, ids: list[str], blanked: list[str] = (), dropped: list[str] = ()) -> DataFrame:
    """A table with pseudonyms for ids (the same in every table with this salt), texts blanked where there is one, and columns dropped; null ids stay null."""
    pseudonym = lambda c: F.substring(F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256), 1, 12)
    blank = {c: F.when(F.col(c).isNotNull(), F.lit(SCRUBBED)) for c in blanked}
    return table.drop(*dropped).withColumns({**{c: pseudonym(c) for c in ids}, **blank})


def audit_rows(events: DataFrame, known: DataFrame) -> DataFrame:
    """Events (audit_id, action, actor, target, created_at) as rows of the log: each once, the actor's name as it is now; of a stream, a stream."""
    return events.join(known.select(F.col("worker").alias("actor"), "name"), "actor", "left").select("audit_id", "action", "actor", "name", "target", "created_at")


def stale_backups(backups: DataFrame, as_of, hours: int) -> DataFrame:
    """(name, age, stale): whole hours since each name's newest successful backup; a name without one is stale. backups: name, finished_at, succeeded."""
    newest = backups.groupBy("name").agg(F.max(F.when(F.col("succeeded"), F.col("finished_at"))).alias("last"))
    age = F.expr("timestampdiff(HOUR, last, as_of)")
    return newest.withColumn("as_of", as_of).select("name", age.cast("long").alias("age"), F.coalesce(age >= hours, F.lit(True)).alias("stale"))


def rack_counters(records: DataFrame, standings: DataFrame) -> DataFrame:
    """Per job: racks analysed, settled, and settled without consensus, from facts."""
    analysed = records.groupBy("job_id").agg(F.count_distinct("rack").alias("analysed"))
    counts = standings.groupBy("job_id").agg(F.count_if("settled").alias("settled"), F.count_if("without").alias("without"))
    return analysed.join(counts, "job_id", "left").fillna(0, ["settled", "without"])


def repaired(stored: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Stored counters as facts have them, and whether that changed them; keys without facts are zero, keys that weren't stored are added."""
    names = [c for c in facts.columns if c != key]
    both = facts.join(stored.select(key, F.lit(True).alias("held"), *(F.col(c).alias(f"old_{c}") for c in names)), key, "full").fillna(0, names)
    same = F.struct(*names).eqNullSafe(F.struct(*(F.col(f"old_{c}").alias(c) for c in names)))
    return both.select(key, *names, (F.col("held").isNull() | ~same).alias("changed"))


def job_purge(facts: DataFrame, jobs: list[int]) -> DataFrame:
    """What stays of a fact table when jobs go; rows without a job stay."""
    return facts.filter(~F.col("job_id").isin(jobs) | F.col("job_id").isNull())


def stored_tables(tables: dict[str, DataFrame], folder: str, buckets: int = 16) -> None:
    """Fact tables as folders of job buckets, version 0; a purge rewrites whole buckets."""
    for name, df in tables.items():
        df.withColumn("bucket", F.pmod(F.coalesce(F.col("job_id"), F.lit(0)), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{name}/version=0")


def finished(spark: SparkSession, folder: str) -> DataFrame:
    """(name, bucket, version) of what purges have written and listed."""
    kind = "name string, bucket int, version int"
    try:
        return spark.read.schema(kind).parquet(f"{folder}/done")
    except AnalysisException as e:  # no purge yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], kind)


def current_tables(spark: SparkSession, folder: str, names: list[str], below: int = 1 << 30) -> dict[str, DataFrame]:
    """Each table with the newest version of each of its buckets that a finished purge names; files of versions from `below` on aren't opened."""
    out = {}
    for name in names:
        rows = spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}").filter(F.col("version") < below)
        columns = [c for c in rows.columns if c not in ("version", "bucket")]
        newest = finished(spark, folder).filter(F.col("name") == name).groupBy("bucket").agg(F.max("version").alias("newest"))
        out[name] = rows.join(newest, "bucket", "left").filter(F.col("version") == F.coalesce("newest", F.lit(0))).select(*columns)
    return out


def purge_tables(spark: SparkSession, folder: str, names: list[str], jobs: list[int], version: int, buckets: int = 16) -> None:
    """Delete all facts of jobs from stored tables: their buckets are written anew as a version, and count from when a list of them is there.

    The list is the swap: until it is written, readers see the tables as they were. A purge that broke off is run again
    under its version and replaces what it had written; one that is listed isn't done twice. Versions grow.
    """
    touched = sorted({j % buckets for j in jobs})
    if not finished(spark, folder).filter(F.col("version") == version).isEmpty():
        return
    rows = current_tables(spark, folder, names, version)
    for name in names:
        kept = job_purge(rows[name], jobs).withColumn("bucket", F.pmod(F.coalesce(F.col("job_id"), F.lit(0)), F.lit(buckets))).filter(F.col("bucket").isin(touched))
        kept.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{name}/version={version}")
    listed = spark.createDataFrame([(name, b, version) for name in names for b in touched], "name string, bucket int, version int")
    listed.write.mode("overwrite").parquet(f"{folder}/done/purge={version}")


def user_census(tables: dict[str, tuple[DataFrame, str]], user) -> DataFrame:
    """Rows of an account in each table, by the column that names it there."""
    return tagged_counts({k: df.filter(F.col(c) == user) for k, (df, c) in tables.items()})


def newest_first():
    """The order of a list that is newest first, for places in a page."""
    return W.orderBy(F.desc("created_at"), F.desc("audit_id"))


def ban_list(audit: DataFrame, names: DataFrame, on: str = "user.ban", off: str = "user.unban") -> DataFrame:
    """Bans in force, newest first by place: the last action on a target decides; names: target, name, where there is one."""
    last = audit.filter(F.col("action").isin(on, off)).groupBy("target").agg(F.max_by(F.struct("audit_id", "action", "actor", "created_at"), "audit_id").alias("last")).select("target", "last.*")
    return last.filter(F.col("action") == on).join(names, "target", "left").select("target", "name", "actor", "created_at", "audit_id")
