"""Queries that replay tables as streams; each equals its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import PENT
from ..operators import coverage
from ..sources.standins import sql
from ..streaming import streams, timers
from .catalogue import CLAIMS, DONE, MEMBERS, MERGED, Tables, _EVIDENCE, query

#: Files of a replay at least, rows of a file, and batches that a long replay has about.
FILES, FILE_ROWS, BATCHES = 4, 250_000, 16
#: Slices of the keys of timed messages for each file of a replay, those of a partition of the state, and such partitions at least.
FILE_SLICES, TOGETHER, PARTITIONS = 4, 8, 8
#: Times of leases in milliseconds: how long a claim may be silent, and may overrun its deadline; life of a staged import.
SILENT, GRACE, DAY = 20 * 60_000, 30 * 60_000, 24 * 3_600_000


def shape(rows):
    """Files of a replay, which grow with the rows, and how many of them make a batch."""
    files = max(FILES, -(-rows.count() // FILE_ROWS))
    return files, max(1, files // BATCHES)


def replayed(rows, folder, *order, **more):
    files, at_once = shape(rows)
    return streams.replayed(rows, folder, files, *order, **{"at_once": at_once, **more})


def claims_stream(spark, sf_dir, folder):
    return replayed(Tables(spark, sf_dir).claims, f"{folder}/in", "claimed_at")


def timed(spark, messages, folder):
    """Messages (key, kind, ms, deadline) as a stream in their order of time, behind which time goes on until all timers are due; and how many slices its keys fill."""
    files, at_once = shape(messages)
    stream = streams.in_order(messages, folder, files, at_once, "ms")
    last = messages.agg(F.coalesce(F.max("ms"), F.lit(0)).alias("ms"))
    for days in (10, 11):  # two batches: what one tells of the time holds from the next one on
        end = last.select(F.lit(-1).cast("long").alias("key"), F.lit(1).alias("kind"), (F.col("ms") + days * DAY).alias("ms"), F.lit(None).cast("long").alias("deadline"))
        end.write.mode("append").parquet(folder)
    return stream, files * FILE_SLICES


@query(f"SELECT job_id, count(*) FILTER (state = 'completed') AS completed, CAST(coalesce(sum(movegens) FILTER (state = 'completed'), 0) AS BIGINT) AS movegens FROM {CLAIMS} GROUP BY job_id")
def stream_counters(spark, sf_dir):
    folder = streams.scratch(spark, "counters")
    streams.drained(streams.job_counters(claims_stream(spark, sf_dir, folder)), folder, streams.upsert(folder, ["job_id"]), "update")
    return streams.current(spark, folder, ["job_id"])


@query(f"SELECT worker, is_anon, count(*) AS tasks, CAST(sum(held_ms) AS BIGINT) AS compute_ms FROM {DONE} GROUP BY ALL")
def stream_contributors(spark, sf_dir):
    folder = streams.scratch(spark, "contributors")
    streams.drained(streams.contributor_counters(claims_stream(spark, sf_dir, folder)), folder, streams.upsert(folder, ["worker"]), "update")
    return streams.current(spark, folder, ["worker", "is_anon"])


@query(f"SELECT DISTINCT task_id FROM {DONE}")
def stream_dedupe(spark, sf_dir):
    folder = streams.scratch(spark, "dedupe")
    streams.drained(streams.accepted_once(claims_stream(spark, sf_dir, folder), "60 days"), folder)
    return spark.read.parquet(f"{folder}/out").select("task_id")


@query(f"SELECT * FROM {MERGED}")
def stream_merge(spark, sf_dir):
    folder, t = streams.scratch(spark, "merge"), Tables(spark, sf_dir)
    staged = replayed(coverage.stage(t.deltas), f"{folder}/in", "submission")
    streams.drained(staged, folder, streams.fold_staged(folder, t.progress))
    return streams.latest_progress(spark, folder).select("generation", "rack", "n", "equity_cents")


@query(f"SELECT generation = 0 AS late, count(*) AS deltas, CAST(sum(n) AS BIGINT) AS n FROM {sql('deltas')} GROUP BY ALL")
def stream_late(spark, sf_dir):
    folder, t = streams.scratch(spark, "late"), Tables(spark, sf_dir)
    closed = t.deltas.filter("generation = 0").select("generation").distinct()
    streams.drained(replayed(t.deltas, f"{folder}/in", "submission"), folder, streams.split_late(folder, closed))
    return spark.read.parquet(f"{folder}/split").withColumn("late", F.col("late").cast("boolean")).groupBy("late").agg(F.count("*").alias("deltas"), F.sum("n").alias("n"))


@query(
    f"""SELECT job_id, CAST(coalesce(max(n), 0) AS BIGINT) AS longest FROM (SELECT DISTINCT job_id FROM {CLAIMS}) LEFT JOIN (SELECT job_id, island, count(*) AS n FROM (SELECT *, count(*) FILTER (state = 'completed') OVER (PARTITION BY job_id ORDER BY claimed_at, claim_id ROWS UNBOUNDED PRECEDING) AS island FROM {CLAIMS})
    WHERE state = 'abandoned' GROUP BY ALL) USING (job_id) GROUP BY job_id"""
)
def stream_streaks(spark, sf_dir):
    folder, claims = streams.scratch(spark, "streaks"), Tables(spark, sf_dir).claims
    order = F.col("claimed_at").asc_nulls_last(), F.col("claim_id")
    streams.drained(replayed(claims, f"{folder}/in", *order, at_once=4 * FILES, number="slice"), folder, streams.fold_streaks(folder))
    return streams.streaks(spark, folder).select("job_id", "longest")


# ---- native state

def leases(t: Tables):
    """Messages of claims: opened, seen up to five times at intervals, closed where completed."""
    ms = F.unix_millis("claimed_at")
    base = t.claims.select(F.col("claim_id").alias("key"), "state", ms.alias("ms"))
    opened = base.select("key", F.lit(timers.OPENED).alias("kind"), "ms", (F.col("ms") + (30 + F.col("key") % 90) * 60_000).alias("deadline"))
    none = F.lit(None).cast("long").alias("deadline")
    times = F.sequence(F.lit(1).cast("long"), F.col("key") % 6)
    seen = base.filter("key % 6 > 0").select("key", F.lit(timers.SEEN).alias("kind"), "ms", F.explode(times).alias("j")).select("key", "kind", (F.col("ms") + F.col("j") * (10 + F.col("key") % 25) * 60_000).alias("ms"), none)
    closed = base.filter("state = 'completed'").select("key", F.lit(timers.CLOSED).alias("kind"), (F.col("ms") + (F.col("key") % 150) * 60_000).alias("ms"), none)
    return opened.unionByName(seen).unionByName(closed)


_LEASES = f"""(SELECT claim_id AS key, 0 AS kind, epoch_us(claimed_at) // 1000 AS ms, epoch_us(claimed_at) // 1000 + (30 + claim_id % 90) * 60000 AS deadline FROM {CLAIMS}
    UNION ALL SELECT claim_id, 1, epoch_us(claimed_at) // 1000 + j * (10 + claim_id % 25) * 60000, NULL FROM {CLAIMS}, range(1, 6) t(j) WHERE j <= claim_id % 6
    UNION ALL SELECT claim_id, 2, epoch_us(claimed_at) // 1000 + (claim_id % 150) * 60000, NULL FROM {CLAIMS} WHERE state = 'completed')"""


def _lapsed(messages: str, silent: int, grace: int) -> str:
    """The first message of each key after which the time ran out, if nothing closed it before."""
    return f"""(WITH o AS (SELECT key, kind, ms, max(deadline) OVER (PARTITION BY key) AS deadline, row_number() OVER w AS place, lead(ms) OVER w AS following FROM {messages} WINDOW w AS (PARTITION BY key ORDER BY ms, kind)),
        d AS (SELECT *, least(ms + {silent}, coalesce(deadline + {grace}, ms + {silent})) AS due FROM o),
        s AS (SELECT key, min(place) FILTER (kind = 2) AS closed, min(place) FILTER (kind < 2 AND coalesce(following > due, true)) AS lapse FROM d GROUP BY key)
        SELECT d.key, due AS lapsed_ms, coalesce(ms + {silent} >= deadline + {grace}, false) AS overran FROM d JOIN s ON s.key = d.key AND s.lapse = place WHERE closed IS NULL OR closed > lapse)"""


@query(f"SELECT key AS claim_id, lapsed_ms, overran FROM {_lapsed(_LEASES, SILENT, GRACE)}")
def stream_lapses(spark, sf_dir):
    """Claims that fall silent or overrun their deadline, while what they report moves the time that they have."""
    folder = streams.scratch(spark, "lapses")
    stream, slices = timed(spark, leases(Tables(spark, sf_dir)), f"{folder}/in")
    with timers.native_state(spark, max(PARTITIONS, slices // TOGETHER)):
        streams.drained(timers.lapses(stream, SILENT, GRACE, slices=slices), folder)
    return spark.read.parquet(f"{folder}/out").withColumnRenamed("key", "claim_id")


_IMPORTS = f"""(SELECT key, kind, ms, CAST(NULL AS BIGINT) AS deadline FROM (SELECT audit_id // 5 AS key, CASE audit_id % 5 WHEN 0 THEN 0 WHEN 4 THEN 2 ELSE 1 END AS kind, epoch_us(created_at) // 1000 AS ms FROM {sql('audit')}) WHERE kind < 2 OR key % 3 = 0)"""


@query(f"SELECT key AS import_id, lapsed_ms AS expired_ms FROM {_lapsed(_IMPORTS, DAY, 0)}")
def stream_expiry(spark, sf_dir):
    """Staged imports that go a day after they were staged or last refreshed, unless they are confirmed."""
    folder, audit = streams.scratch(spark, "expiry"), Tables(spark, sf_dir).audit
    kind = F.when(F.col("audit_id") % 5 == 0, timers.OPENED).when(F.col("audit_id") % 5 == 4, timers.CLOSED).otherwise(timers.SEEN)
    rows = audit.select(F.floor(F.col("audit_id") / 5).alias("key"), kind.alias("kind"), F.unix_millis("created_at").alias("ms"), F.lit(None).cast("long").alias("deadline")).filter("kind < 2 OR key % 3 = 0")
    stream, slices = timed(spark, rows, f"{folder}/in")
    with timers.native_state(spark, max(PARTITIONS, slices // TOGETHER)):
        streams.drained(timers.lapses(stream, DAY, slices=slices), folder)
    return spark.read.parquet(f"{folder}/out").select(F.col("key").alias("import_id"), F.col("lapsed_ms").alias("expired_ms"))


_TIMES = f"(SELECT job_id, epoch_us(completed_at) // 1000 AS ms FROM {DONE})"


@query(f"SELECT job_id, step_ms, CAST(sum(n) OVER (PARTITION BY job_id ORDER BY step_ms) AS BIGINT) AS total FROM (SELECT job_id, ms - ms % 60000 AS step_ms, count(*) AS n FROM {_TIMES} GROUP BY ALL)")
def stream_updates(spark, sf_dir):
    """What is pushed of each job: its completions so far, once a minute at most."""
    folder, claims = streams.scratch(spark, "updates"), Tables(spark, sf_dir).claims
    done = claims.filter("state = 'completed'").select(F.col("job_id").alias("key"), F.lit(timers.SEEN).alias("kind"), F.unix_millis("completed_at").alias("ms"), F.lit(None).cast("long").alias("deadline"))
    stream, _ = timed(spark, done, f"{folder}/in")
    with timers.native_state(spark):
        streams.drained(timers.coalesced(stream, 60_000), folder)
    return spark.read.parquet(f"{folder}/out").filter("key >= 0").withColumnRenamed("key", "job_id")


@query(f"SELECT job_id, ms - ms % 900000 - k * 900000 AS start_ms, count(*) AS recent FROM {_TIMES}, range(4) t(k) GROUP BY ALL")
def stream_throughput(spark, sf_dir):
    """Completions of each job in every hour that begins at a quarter, told when the hour is over."""
    folder, claims = streams.scratch(spark, "pace"), Tables(spark, sf_dir).claims
    done = claims.filter("state = 'completed'").select("job_id", "state", "completed_at")
    stream = streams.in_order(done, f"{folder}/in", *shape(done), "completed_at")
    for days in (1, 2):
        done.agg(F.max("completed_at").alias("t")).select(F.lit(-1).cast("long").alias("job_id"), F.lit("completed").alias("state"), (F.col("t") + F.expr(f"INTERVAL {days} DAYS")).alias("completed_at")).write.mode("append").parquet(f"{folder}/in")
    streams.drained(streams.trailing_throughput(stream, "15 minutes"), folder)
    return spark.read.parquet(f"{folder}/out").filter("job_id >= 0").select("job_id", F.unix_millis("start").alias("start_ms"), "recent")


#: The batch in which a result comes: results of the second scope first, those of the first in two batches, the others last.
_PART = "CASE WHEN job_type <> 'game_pairs' THEN 2 WHEN variant = 1 OR result_id % 2 = 0 THEN 0 ELSE 1 END"
_BATCHED = f"(SELECT r.*, {_PART} AS part FROM {sql('results')} r JOIN {sql('jobs')} j ON j.job_id = r.job_id)"


def _seen(batch: int, pool: int | None = None) -> str:
    """Evidence of the members and results of a batch and those before."""
    text = _EVIDENCE.replace(sql("results"), f"(SELECT * EXCLUDE (part) FROM {_BATCHED} WHERE part <= {batch})")
    return text.replace(MEMBERS, f"(SELECT * FROM {MEMBERS} m WHERE pool <> 1 OR config <> 8 OR {batch} >= 3)")


_RUNS = [(0, "true"), (1, "pool = 0"), (3, "pool = 1")]


@query(" UNION ALL ".join(f"SELECT {b} AS batch, CAST(pool AS BIGINT) AS pool, CAST(sum(pent_0 + pent_1 + pent_2 + pent_3 + pent_4) AS DOUBLE) * 2 AS pairs FROM {_seen(b)} WHERE {which} GROUP BY pool" for b, which in _RUNS))
def stream_refit(spark, sf_dir):
    """Runs of the pools whose evidence or members changed in a batch: both, the first one, none, and the one with a new member."""
    folder, t = streams.scratch(spark, "refit"), Tables(spark, sf_dir)
    part = F.expr(_PART)
    rows = t.results.join(t.jobs.select("job_id", "job_type", "variant"), "job_id").withColumn("part", part).drop("job_type", "variant")
    streams.fed(spark, [rows.filter(F.col("part") == b).drop("part") for b in range(4)], folder, streams.refit(folder, t.jobs, t.pools, lambda batch: t.members.filter(F.expr(f"pool <> 1 OR config <> 8 OR {batch} >= 3"))))
    runs = spark.read.parquet(f"{folder}/runs")
    return runs.groupBy("batch", "pool").agg(F.sum("pairs").alias("pairs"))


#: Messages of generations in four batches: counts; claims that open in the first batch and end in a later one; submissions
#: that are staged in the first and merged in a later one.
_CLOSING = f"""(SELECT submission % 4 AS part, generation, 'count' AS kind, rack, n FROM {sql('deltas')} WHERE submission % 50 <> 0
    UNION ALL SELECT part, generation, 'open', NULL, n FROM (SELECT generation, submission % 4 AS done FROM {sql('deltas')} WHERE generation = 1 AND submission % 50 = 0), (VALUES (0, 1), (1, -1)) v(ends, n), LATERAL (SELECT CASE WHEN ends = 0 THEN 0 ELSE greatest(done, 2) END AS part)
    UNION ALL SELECT part, generation, 'staged', NULL, n FROM (SELECT generation FROM {sql('deltas')} WHERE generation = 2 AND submission % 50 = 0), (VALUES (0, 1), (3, -1)) v(part, n))"""
_SO_FAR = f"(SELECT b.b AS batch, g.g AS generation, u.rack, coalesce(sum(c.n), 0) AS n FROM range(4) b(b) CROSS JOIN range(3) g(g) CROSS JOIN {sql('universe')} u LEFT JOIN {_CLOSING} c ON c.kind = 'count' AND c.part <= b.b AND c.generation = g.g AND c.rack = u.rack GROUP BY ALL)"


@query(
    f"""SELECT CAST(min(batch) AS BIGINT) AS batch, generation FROM (SELECT batch, generation FROM {_SO_FAR} GROUP BY ALL HAVING min(n) >= 10) f
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT part, generation, kind, n FROM {_CLOSING}) c WHERE c.kind <> 'count' AND c.part <= f.batch AND c.generation = f.generation GROUP BY c.kind HAVING sum(c.n) > 0) GROUP BY generation"""
)
def stream_closing(spark, sf_dir):
    """The batch in which each generation closes: all keys at target, nothing in flight, nothing staged."""
    folder, t = streams.scratch(spark, "closing"), Tables(spark, sf_dir)
    counts = t.deltas.filter("submission % 50 <> 0").selectExpr("submission % 4 AS part", "generation", "'count' AS kind", "rack", "n")
    held = t.deltas.filter("submission % 50 = 0").selectExpr("generation", "submission % 4 AS done")
    flight = held.filter("generation = 1").selectExpr("explode(array(struct(0L AS part, 1L AS n), struct(greatest(done, 2L) AS part, -1L AS n))) AS x", "generation").selectExpr("x.part", "generation", "'open' AS kind", "CAST(NULL AS BIGINT) AS rack", "x.n")
    staged = held.filter("generation = 2").selectExpr("explode(array(struct(0L AS part, 1L AS n), struct(3L AS part, -1L AS n))) AS x", "generation").selectExpr("x.part", "generation", "'staged' AS kind", "CAST(NULL AS BIGINT) AS rack", "x.n")
    rows = counts.unionByName(flight).unionByName(staged)
    universe = t.universe.select(F.explode(F.lit([0, 1, 2]).cast("array<bigint>")).alias("generation"), "rack")
    streams.fed(spark, [rows.filter(F.col("part") == b).drop("part") for b in range(4)], folder, streams.close_generations(folder, universe, [10, 10, 10]))
    return spark.read.parquet(f"{folder}/closed").select(F.col("batch").cast("long").alias("batch"), "generation")
