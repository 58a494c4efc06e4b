"""Input files: diffs by path and content, files that jobs need, gaps that workers report, letter distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def input_diff(staged: DataFrame, known: DataFrame) -> DataFrame:
    """Staged (path, sha256): known as it is, a collision (path known with other content) or new."""
    same = known.select("path", "sha256", F.lit(True).alias("same")).distinct()
    path = known.select("path", F.lit(True).alias("named")).distinct()
    rows = staged.select("path", "sha256").distinct().join(same, ["path", "sha256"], "left").join(path, "path", "left")
    return rows.select("path", "sha256", F.when(F.col("same"), "known").when(F.col("named"), "collision").otherwise("new").alias("disposition"))


def nothing_new(diff: DataFrame) -> DataFrame:
    """Files by disposition; there is nothing to import where no row says new or collision."""
    return diff.groupBy("disposition").agg(F.count("*").alias("files"))


def expected_data(jobs: DataFrame, needs: DataFrame, files: DataFrame) -> DataFrame:
    """(job_id, path, sha256) of the files that a job's two players and board need; needs: (owner, path)."""
    owners = jobs.select("job_id", F.explode(F.array("p1_name", "p2_name", F.concat(F.lit("board"), F.col("letterdist").cast("string")))).alias("owner")).distinct()
    wanted = needs.join(owners, "owner").select("job_id", "path").distinct()
    return wanted.join(files, "path").select("job_id", "path", "sha256")


def derived_needs(jobs: DataFrame) -> DataFrame:
    """(job_id, kind, lexicon, leaves) of the tables that each job's matches need: a word map for all, one per leaves for pairs, a word table for racks."""
    one = jobs.select("job_id", F.lit("wordmap").alias("kind"), F.col("letterdist").alias("lexicon"), F.lit(None).cast("long").alias("leaves"))
    pair = jobs.filter("job_type = 'game_pairs'").select("job_id", F.lit("rackmap").alias("kind"), F.col("letterdist").alias("lexicon"), F.col("variant").alias("leaves"))
    rack = jobs.filter("job_type = 'opening_rack'").select("job_id", F.lit("wordtable").alias("kind"), F.col("letterdist").alias("lexicon"), F.lit(None).cast("long").alias("leaves"))
    return one.unionByName(pair).unionByName(rack).distinct()


def derived_readiness(needs: DataFrame, built: DataFrame) -> DataFrame:
    """Needs with the state of the built table (built: kind, lexicon, leaves, state), joined with nulls as values."""
    n, b = needs.alias("n"), built.alias("b")
    on = (F.col("n.kind") == F.col("b.kind")) & F.col("n.lexicon").eqNullSafe(F.col("b.lexicon")) & F.col("n.leaves").eqNullSafe(F.col("b.leaves"))
    return n.join(b, on, "left").select("n.job_id", "n.kind", "n.lexicon", "n.leaves", F.coalesce("b.state", F.lit("missing")).alias("state"))


def data_gaps(claims: DataFrame) -> DataFrame:
    """Per job: declined claims, distinct workers among them, and the last report."""
    return claims.filter("state = 'declined'").groupBy("job_id").agg(F.count("*").alias("declined"), F.count_distinct(F.concat_ws(":", "is_anon", "worker")).alias("workers"), F.max(F.unix_micros("claimed_at")).alias("last_us"))


#: Tables that a worker may do without, in the order of reports.
SKIPPABLE = ("wmp", "wit", "rit")


def skipped_tables(claims: DataFrame) -> DataFrame:
    """Per skipped table: claims and distinct workers, in the fixed order; skip_bits has a bit for each table."""
    names = F.filter(F.array(*(F.when(F.col("skip_bits").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(t)) for i, t in enumerate(SKIPPABLE))), lambda x: x.isNotNull())
    rows = claims.select("worker", F.explode(names).alias("role"))
    return rows.groupBy("role").agg(F.count("*").alias("claims"), F.count_distinct("worker").alias("workers")).withColumn("place", F.array_position(F.lit(list(SKIPPABLE)), F.col("role")))


def skips_allowed(claims: DataFrame, allowed: DataFrame) -> DataFrame:
    """Per job: claims whose skipped roles all are allowed for it, and the others; roles: an array, allowed: (job_id, allowed)."""
    within = F.size(F.array_except("roles", F.coalesce("allowed", F.array().cast("array<string>")))) == 0
    return claims.join(allowed, "job_id", "left").groupBy("job_id").agg(F.count_if(within).alias("within"), F.count_if(~within).alias("beyond"))


def versus(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, versus): the distinct names of each key in order, as one text."""
    names = rows.select(key, name).distinct().groupBy(key)
    return names.agg(F.concat_ws(" vs ", F.array_sort(F.collect_list(name))).alias("versus"))


def fleet(claims: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Workers and claims by version among claims completed in the last days and claims still open."""
    since = as_of - F.expr(f"INTERVAL {days} DAYS")
    done = claims.filter((F.col("state") == "completed") & (F.col("completed_at") > since)).select("version", "worker", "is_anon")
    still = claims.filter("state = 'claimed'").select("version", "worker", "is_anon")
    return done.unionByName(still).groupBy("version").agg(F.count("*").alias("claims"), F.count_distinct("worker", "is_anon").alias("workers"))


def read_distributions(spark: SparkSession, path: str, name: str = r"([^/]+)$") -> DataFrame:
    """Letter distributions without a header (letter, lower, count, score, is_vowel and two more at times), many files at once; name: the part of a path that names its file."""
    lines = spark.read.text(path).select("value", F.regexp_extract(F.input_file_name(), name, 1).alias("file"))
    cells = F.split(F.regexp_replace("value", "\r$", ""), ",")
    rows = lines.filter(F.trim("value") != "").select("file", cells.alias("x"))
    number = lambda i: F.trim(F.get("x", F.lit(i))).try_cast("int")
    return rows.select("file", F.trim(F.get("x", F.lit(0))).alias("letter"), number(2).alias("count"), number(3).alias("score"), number(4).alias("is_vowel"), F.size("x").alias("columns"))


def list_inputs(spark: SparkSession, path: str) -> DataFrame:
    """Files below data/<role>/<name>, with SHA-256; files of unknown roles are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.regexp_extract("path", r"data/([^/]+)/([^/]+)$", 1), F.regexp_extract("path", r"data/([^/]+)/([^/]+)$", 2)
    role = F.when(parts[0] == "lexica", "lexicon").when(parts[0] == "letterdistributions", "distribution").when(parts[0] == "layouts", "layout").when(parts[0] == "strategy", "leaves")
    return files.select(role.alias("role"), parts[1].alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")).filter("role is not null")
