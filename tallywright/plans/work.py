"""Queries by name: next work, draws, whole exports, purges, census and details of jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage, feeds, jobs, ops
from ..scratch import scratch
from ..sources.standins import sql
from .catalogue import CLAIMS, MARGIN, MERGED, MOST, MOVES, Tables, _standings, query
from .records import _PLIES, tables_of

# ---- coverage

#: Targets by which, in the given tables, a lap goes on, a new one begins, and the tail comes; cursors of two generations.
_TARGETS, _K, _SWITCH = [250, 400, 130], 12, 4
_BELOW = f"(SELECT *, generation = 1 AND rack > 60 AS behind FROM {MERGED} WHERE n < {_TARGETS}[greatest(1, least(generation, 3))])"
_BUSY = f"(SELECT job_id % 3 AS generation, worker AS rack FROM {CLAIMS} WHERE state = 'claimed' UNION SELECT generation, rack FROM {sql('deltas')} WHERE submission % 40 = 0)"


@query(
    f"""WITH b AS {_BELOW}, m AS (SELECT generation, CASE WHEN bool_or(behind) THEN 'sweep' WHEN count(*) > {_SWITCH * _K} THEN 'lap' ELSE 'tail' END AS mode FROM b GROUP BY generation)
    SELECT b.generation, mode, row_number() OVER (PARTITION BY b.generation ORDER BY CASE mode WHEN 'tail' THEN n ELSE 0 END, rack) AS place, rack, n FROM b JOIN m ON m.generation = b.generation
    WHERE mode = 'lap' OR mode = 'sweep' AND behind OR mode = 'tail' AND NOT EXISTS (SELECT 1 FROM {_BUSY} x WHERE x.generation = b.generation AND x.rack = b.rack) QUALIFY place <= {_K}"""
)
def select_coverage(spark, sf_dir):
    """Of all generations at once; staged keys are busy as well as those in flight."""
    t = Tables(spark, sf_dir)
    busy = t.claims.filter("state = 'claimed'").select((F.col("job_id") % 3).alias("generation"), F.col("worker").alias("rack"))
    busy = busy.unionByName(t.deltas.filter("submission % 40 = 0").select("generation", "rack"))
    cursors = spark.sql("SELECT 1L AS generation, 60L AS cursor")
    return coverage.select_coverage(t.merged, _TARGETS, cursors, busy, _K, _SWITCH)


_HOLES = f"(SELECT * FROM {MERGED} WHERE NOT (generation = 1 AND rack % 9 = 1))"


@query(
    f"""SELECT generation, count(*) FILTER (held IS NULL) AS missing, count(*) FILTER (wanted IS NULL) AS extra FROM (SELECT coalesce(w.generation, h.generation) AS generation, w.rack AS wanted, h.rack AS held
    FROM (SELECT g AS generation, rack FROM range(3) r(g), {sql('universe')} WHERE rack % 5 <> 2) w FULL JOIN {_HOLES} h ON h.generation = w.generation AND h.rack = w.rack) GROUP BY generation"""
)
def missing_keys(spark, sf_dir):
    """A generation that lacks some keys, against a universe that lacks others."""
    t = Tables(spark, sf_dir)
    return coverage.missing_keys(t.merged.filter("NOT (generation = 1 AND rack % 9 = 1)"), t.universe.filter("rack % 5 <> 2"), spark.range(3).select(F.col("id").alias("generation")))


_RECORDED = f"(SELECT generation, rack, n + CASE WHEN generation = 2 AND rack % 7 = 3 THEN 1 ELSE 0 END AS n, equity_cents FROM {MERGED} UNION ALL SELECT 7, rack, n, equity_cents FROM {MERGED} WHERE generation = 0)"


@query(
    f"""SELECT r.generation, r.generation IN (SELECT generation FROM {MERGED}) AS present, r.generation % 2 = 0 AS same_builder, r.generation IN (SELECT generation FROM {MERGED}) AND
    NOT EXISTS (SELECT 1 FROM {_RECORDED} a FULL JOIN {MERGED} b ON b.generation = a.generation AND b.rack = a.rack WHERE coalesce(a.generation, b.generation) = r.generation AND (a.n, a.equity_cents) IS DISTINCT FROM (b.n, b.equity_cents)) AS same
    FROM (SELECT DISTINCT generation FROM {_RECORDED}) r"""
)
def generation_integrity(spark, sf_dir):
    """Generations that were written by the CSV sink and are read again, against what was recorded: one differs in some rows, one isn't there."""
    merged, folder = Tables(spark, sf_dir).merged.select("generation", "rack", "n", "equity_cents"), scratch(spark, "integrity")
    for g in range(3):
        coverage.write_generation(coverage.generation_table(merged, g), f"{folder}/generation={g}")
    again = spark.read.schema("rack long, n long, equity_sum decimal(28,10), generation long").csv(folder)
    rebuilt = again.select("generation", "rack", "n", (F.col("equity_sum") * 100).cast("long").alias("equity_cents"))
    changed = merged.withColumn("n", F.col("n") + F.when((F.col("generation") == 2) & (F.col("rack") % 7 == 3), 1).otherwise(0))
    lost = merged.filter("generation = 0").withColumn("generation", F.lit(7).cast("long"))
    recorded = coverage.content_hash(changed.unionByName(lost)).select("generation", "content", F.concat(F.lit("b"), (F.col("generation") % 2).cast("string")).alias("builder"))
    return coverage.generation_integrity(rebuilt, recorded, "b0")


# ---- draws and exports

_DRAWN = "CAST('0x' || substring(md5('42:' || CAST(i AS VARCHAR)), 1, 15) AS BIGINT)"


@query(
    f"""WITH t AS (SELECT task, count(*) AS n, coalesce(sum(count(*)) OVER (ORDER BY task ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM {sql('positions')} WHERE record_id % 5 <> 0 OR task % 3 = 0 GROUP BY task),
    d AS (SELECT i AS draw, {_DRAWN} % (SELECT sum(n) FROM t) AS spot FROM range(60) r(i)), r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY record_id) - 1 AS place FROM {sql('positions')} WHERE record_id % 5 <> 0 OR task % 3 = 0)
    SELECT draw, t.task, CAST(spot - start AS BIGINT) AS "offset", r.record_id FROM d JOIN t ON spot >= start AND spot < start + n JOIN r ON r.task = t.task AND place = spot - start"""
)
def random_record(spark, sf_dir):
    """Sixty draws of positions, from tasks of unlike sizes."""
    rows = Tables(spark, sf_dir).positions.filter("record_id % 5 <> 0 OR task % 3 = 0")
    return feeds.random_records(rows, 60, 42)


#: What each record guesses of the other's rack: none, or up to six leaves; some have as many draws as others.
_LEAVES = f"(SELECT record_id, 100 + record_id % 50 AS total_draws, 'L' || CAST((record_id + j) % 9 AS VARCHAR) AS leave, (record_id * (j + 1)) % 7 AS draws, j * 3 - 5 AS equity FROM {sql('analyses')}, range(6) t(j) WHERE j < record_id % 7)"
_LINES = f"""(SELECT a.record_id, a.job_id, a.rack,
    coalesce((SELECT list({{'rank': m.rank, 'move': m.move, 'score': m.score, 'plies': coalesce((SELECT list({{'ply': p.ply, 'play': p.play, 'score': m.score}} ORDER BY p.ply) FROM {_PLIES} p WHERE p.record_id = m.record_id AND p.rank = m.rank AND p.ply < 2), [])}} ORDER BY m.rank)
        FROM {MOVES} m WHERE m.record_id = a.record_id AND m.rank <= 3 AND m.record_id % 11 <> 0), []) AS moves,
    (SELECT {{'num_leaves': count(*), 'total_draws': max(total_draws), 'leaves': list({{'leave': leave, 'draws': draws, 'equity': equity}} ORDER BY draws DESC, leave, equity)}} FROM {_LEAVES} l WHERE l.record_id = a.record_id HAVING count(*) > 0) AS inference,
    CASE WHEN c.job_id IS NOT NULL THEN {{'results': c.results, 'top_move': c.top_move, 'top_count': c.top_count, 'settled': c.settled}} END AS consensus
    FROM {sql('analyses')} a LEFT JOIN (SELECT * FROM {_standings(MARGIN, MOST)} WHERE rack % 4 <> 0) c ON c.job_id = a.job_id AND c.rack = a.rack)"""


def nested(t: Tables):
    """Records with all levels below them; some have no moves, no inference or no consensus."""
    moves = t.moves.filter("record_id % 11 <> 0")
    plies = t.moves.filter("rank <> 2").select("record_id", "rank", "score", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("ply"))
    plies = plies.withColumn("play", F.concat(F.lit("R"), ((F.col("record_id") + F.col("rank") * F.col("ply")) % 5).cast("string")))
    j, record = F.col("j"), F.col("record_id")
    leaves = t.analyses.select("record_id", F.explode(F.filter(F.lit([0, 1, 2, 3, 4, 5]).cast("array<bigint>"), lambda x: x < F.col("record_id") % 7)).alias("j"))
    leaves = leaves.select("record_id", (100 + record % 50).alias("total_draws"), F.concat(F.lit("L"), ((record + j) % 9).cast("string")).alias("leave"), (record * (j + 1) % 7).alias("draws"), (j * 3 - 5).alias("equity"))
    return feeds.nested_export(t.analyses.select("record_id", "job_id", "rack"), moves, plies, leaves, t.standings.filter("rack % 4 <> 0"), 3, 2)


@query(f"SELECT record_id, to_json(x) AS line FROM {_LINES} x")
def export_nested(spark, sf_dir):
    """Whole lines of the export: records, moves, plies, inference and consensus."""
    rows = nested(Tables(spark, sf_dir))
    return rows.select("record_id", feeds.json_line(rows).alias("line"))


@query(f"SELECT to_json(x) AS line, count(*) OVER () AS listed FROM {_LINES} x")
def export_lines(spark, sf_dir):
    """The same lines through the compressed sink, read again, and the rows that its manifest lists."""
    path = scratch(spark, "export")
    manifest = feeds.export_ndjson(nested(Tables(spark, sf_dir)), path)
    lines = spark.read.text(path, pathGlobFilter="*.gz").select(F.col("value").alias("line"))
    return lines.crossJoin(manifest.agg(F.sum("rows").alias("listed")))  # of one row


# ---- purges, census, bans, jobs

_FACTS = {"results": ("result_id", sql("results")), "claims": ("claim_id", CLAIMS), "analyses": ("record_id", sql("analyses")), "audit": ("audit_id", sql("audit"))}


@query(" UNION ALL ".join(f"SELECT '{k}' AS name, job_id, count(*) AS n, CAST(sum({key}) AS BIGINT) AS ids FROM {v} WHERE job_id NOT IN (3, 19, 8) GROUP BY job_id" for k, (key, v) in _FACTS.items()))
def purge_tables(spark, sf_dir):
    """Jobs go from all stored fact tables, two in one purge, which runs twice, and one in another, which broke off once."""
    t, folder = Tables(spark, sf_dir), scratch(spark, "facts")
    names = list(_FACTS)
    ops.stored_tables(tables_of(t), folder)
    for jobs_gone, version in (([3, 19], 1), ([3, 19], 1)):
        ops.purge_tables(spark, folder, names, jobs_gone, version)
    # what a purge leaves that broke off: a version of one table, listed nowhere
    ops.current_tables(spark, folder, names)["claims"].limit(0).withColumn("bucket", F.lit(8)).write.parquet(f"{folder}/claims/version=2/bucket=8")
    ops.purge_tables(spark, folder, names, [8], 2)
    out = None
    for name, df in ops.current_tables(spark, folder, names).items():
        rows = df.groupBy("job_id").agg(F.count("*").alias("n"), F.sum(_FACTS[name][0]).alias("ids")).select(F.lit(name).alias("name"), "job_id", "n", "ids")
        out = rows if out is None else out.unionByName(rows)
    return out


#: Nine tables of a job; what a stand-in doesn't say of its job goes by what it does.
_NINE = {
    "tasks": f"(SELECT DISTINCT task_id, task_id * 4 % 40 AS job_id FROM {CLAIMS})", "claims": CLAIMS, "results": sql("results"), "analyses": sql("analyses"), "audit": sql("audit"),
    "standings": _standings(MARGIN, MOST), "progress": f"(SELECT *, rack % 10 AS job_id FROM {MERGED})", "staged": f"(SELECT DISTINCT submission, submission % 40 AS job_id FROM {sql('deltas')})",
    "artifacts": f"(SELECT DISTINCT generation, 4 + generation AS job_id FROM {MERGED})",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS name, count(*) AS n FROM {v} WHERE job_id = 4" for k, v in _NINE.items()))
def job_census(spark, sf_dir):
    """Rows of one job in all nine tables that a purge would empty."""
    t = Tables(spark, sf_dir)
    tables = {
        "tasks": t.claims.select("task_id").distinct().withColumn("job_id", F.col("task_id") * 4 % 40), "claims": t.claims, "results": t.results, "analyses": t.analyses, "audit": t.audit,
        "standings": t.standings, "progress": t.merged.withColumn("job_id", F.col("rack") % 10), "staged": t.deltas.select("submission").distinct().withColumn("job_id", F.col("submission") % 40),
        "artifacts": t.merged.select("generation").distinct().withColumn("job_id", 4 + F.col("generation")),
    }
    return ops.census(tables, 4)


_OF_USER = {"claims": (CLAIMS, "worker"), "actions": (sql("audit"), "actor"), "targets": (sql("audit"), "target"), "jobs": (sql("jobs"), "job_id"), "gaps": (f"(SELECT * FROM {CLAIMS} WHERE state = 'declined')", "worker")}


@query(" UNION ALL ".join(f"SELECT '{k}' AS name, count(*) AS n FROM {v} WHERE {c} = 7" for k, (v, c) in _OF_USER.items()))
def user_census(spark, sf_dir):
    """Rows of one account in the tables that name it."""
    t = Tables(spark, sf_dir)
    return ops.user_census({"claims": (t.claims, "worker"), "actions": (t.audit, "actor"), "targets": (t.audit, "target"), "jobs": (t.jobs, "job_id"), "gaps": (t.claims.filter("state = 'declined'"), "worker")}, 7)


@query(
    f"""SELECT a.target, CASE WHEN a.target % 3 <> 0 THEN 'user' || CAST(a.target AS VARCHAR) END AS name, actor, epoch_us(created_at) AS banned_us, row_number() OVER (ORDER BY created_at DESC, audit_id DESC) AS place
    FROM (SELECT *, actor * 10 + audit_id % 10 AS target FROM (SELECT * EXCLUDE (target) FROM {sql('audit')}) QUALIFY row_number() OVER (PARTITION BY target ORDER BY CASE WHEN action IN ('user.ban', 'user.census') THEN audit_id ELSE -1 END DESC) = 1) a WHERE action = 'user.ban' ORDER BY created_at DESC, audit_id DESC LIMIT 100"""
)
def ban_list(spark, sf_dir):
    """The newest hundred bans in force; a census stands for lifting one, and some of the banned have no name."""
    audit = Tables(spark, sf_dir).audit.withColumn("target", F.col("actor") * 10 + F.col("audit_id") % 10)
    names = audit.select("target").distinct().filter("target % 3 <> 0").withColumn("name", F.concat(F.lit("user"), F.col("target").cast("string")))
    rows = ops.ban_list(audit, names, off="user.census").orderBy(F.desc("created_at"), F.desc("audit_id")).limit(100)
    place = F.row_number().over(ops.newest_first())  # over the hundred rows
    return rows.select("target", "name", "actor", F.unix_micros("created_at").alias("banned_us"), place.cast("long").alias("place"))


_TASKS = f"(SELECT task_id, task_id * 3 % 40 AS job_id, task_id // 10 AS seed, CASE WHEN count(*) FILTER (state = 'completed') > 0 THEN 'completed' WHEN count(*) FILTER (state = 'claimed') > 0 THEN 'in_progress' ELSE 'pending' END AS state FROM {CLAIMS} GROUP BY task_id)"
_BY_JOB = f"(SELECT 6 + 8 * (rack % 4) AS job_id, generation, n FROM {MERGED})"
_GOALS = [120, 200, 300]


@query(
    f"""WITH j AS (SELECT *, 40 + job_id AS first_pass FROM {sql('jobs')}), t AS (SELECT t.job_id, count(*) AS tasks, {', '.join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ('completed', 'in_progress', 'pending'))}, count(*) FILTER (state = 'completed' AND seed < first_pass) AS first_passes,
        count(*) FILTER (state = 'completed' AND seed >= first_pass) AS reissues FROM {_TASKS} t JOIN j ON j.job_id = t.job_id GROUP BY t.job_id),
    g AS (SELECT job_id, coalesce(min(generation) FILTER (below > 0), max(generation) + 1) AS generation FROM (SELECT job_id, generation, count(*) FILTER (n < {_GOALS}[greatest(1, least(generation, 3))]) AS below FROM {_BY_JOB} GROUP BY ALL) GROUP BY job_id),
    e AS (SELECT job_id, arg_max(epoch_us(created_at), audit_id) AS completed_us, arg_max(actor % 2 = 0, audit_id) AS forced FROM {sql('audit')} WHERE action = 'job.view' GROUP BY job_id)
    SELECT j.job_id, job_type, status, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('tasks', 'completed', 'in_progress', 'pending', 'first_passes', 'reissues'))}, CASE WHEN job_type = 'leave_gen' THEN generation END AS generation,
    CASE WHEN status = 'completed' THEN completed_us END AS completed_us, CASE WHEN status = 'completed' THEN forced END AS forced FROM j LEFT JOIN t ON t.job_id = j.job_id LEFT JOIN g ON g.job_id = j.job_id LEFT JOIN e ON e.job_id = j.job_id"""
)
def job_details(spark, sf_dir):
    """Tasks, passes, generations and completions; a view in the log stands for a completion, which an odd actor didn't force."""
    t = Tables(spark, sf_dir)
    tasks = jobs.task_states(t.claims).select((F.col("task_id") * 3 % 40).alias("job_id"), F.floor(F.col("task_id") / 10).alias("seed"), "state")
    progress = t.merged.select((6 + 8 * (F.col("rack") % 4)).alias("job_id"), "generation", "rack", "n")
    log = t.audit.filter("action = 'job.view'").select("audit_id", "job_id", "created_at", F.lit("job.completed").alias("action"), F.when(F.col("actor") % 2 == 0, F.col("actor")).alias("actor"))
    return jobs.job_details(t.jobs.withColumn("first_pass", 40 + F.col("job_id")), tasks, progress, log, _GOALS)
