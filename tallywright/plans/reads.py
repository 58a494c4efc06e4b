"""Queries by name: scores as printed, counters repaired, units, keys, files, messages, pseudonyms and canonical racks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import PENT
from ..operators import boards, feeds, inputs, jobs, ops, outcomes, people
from ..scratch import scratch
from ..sources import messages
from ..sources.standins import sql
from ..streaming import streams
from .catalogue import AS_OF_SQL, DONE, MARGIN, MOST, ORACLES, Tables, _MATCH_JOBS, _TOTALS, _standings, _tested, as_of, query

# ---- matches

_LINE = f"(SELECT job_id, sum(wins) AS wins, sum(losses) AS losses, sum(ties) AS ties, {', '.join(f'sum({c}) AS {c}' for c in PENT)}, sum(games * p1_score_mean) / sum(games) AS p1, sum(games * p2_score_mean) / sum(games) AS p2, sum(games * (p1_score_mean - p2_score_mean)) / sum(games) AS spread FROM {sql('results_skewed')} GROUP BY job_id)"
_pairs = " + ".join(PENT)


def _sign(x: str) -> str:
    return f"CASE WHEN round({x}, 1) > 0 THEN '+' WHEN round({x}, 1) < 0 THEN '-' ELSE '' END || format('{{:.1f}}', abs(round({x}, 1)))"


@query(
    f"""SELECT job_id, CAST(wins + losses + ties AS BIGINT) AS played, format('{{:.2f}}%', round(100 * share, 2)) AS share1, format('{{:.2f}}%', round(100 * (1 - share), 2)) AS share2, CASE WHEN wins > losses THEN 1 WHEN losses > wins THEN 2 ELSE 0 END AS leader,
    format('{{:.2f}}', round(p1, 2)) AS p1_mean, format('{{:.2f}}', round(p2, 2)) AS p2_mean, format('{{:.2f}}', abs(round(spread, 2))) AS points, CASE WHEN round(spread, 2) > 0 THEN 1 WHEN round(spread, 2) < 0 THEN 2 ELSE 0 END AS ahead,
    {_sign('spread')} AS spread, {" || '/' || ".join(f"format('{{:.1f}}', round(100 * CAST({c} AS DOUBLE) / ({_pairs}), 1))" for c in PENT)} AS pair_shares FROM (SELECT *, (wins + ties / 2) / (wins + losses + ties) AS share FROM {_LINE})"""
)
def score_lines(spark, sf_dir):
    return outcomes.score_lines(outcomes.match_summary(Tables(spark, sf_dir).results_skewed))


_PARTED = f"(SELECT p.part, r.* EXCLUDE (job_id), j.job_id, j.job_type, j.min_units, j.max_units, j.confidence_pct FROM range(4) p(part) CROSS JOIN {_MATCH_JOBS} j JOIN {sql('results_skewed')} r ON r.job_id = j.job_id AND r.result_id % 4 <= p.part)"
_BY_PART = f"(SELECT part, job_id, job_type, min_units, max_units, confidence_pct, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('wins', 'losses', 'ties', *PENT))} FROM {_PARTED} GROUP BY ALL)"


@query(f"SELECT job_id, arg_min(status, part) FILTER (status <> 'running') AS verdict FROM {_tested(_BY_PART)} GROUP BY job_id")
def stream_verdicts(spark, sf_dir):
    """Results in four batches; each job's first verdict stays."""
    folder, t = streams.scratch(spark, "verdicts"), Tables(spark, sf_dir)
    rows = t.results_skewed.select("job_id", "result_id", "wins", "losses", "ties", *PENT)
    streams.fed(spark, [rows.filter(F.col("result_id") % 4 == k) for k in range(4)], folder, streams.latch_verdicts(folder, t.jobs.filter("job_type in ('games', 'game_pairs')"), ["wins", "losses", "ties", *PENT]))
    held = spark.read.parquet(f"{folder}/verdicts")
    last = held.agg(F.max("version")).head()[0]
    return held.filter(F.col("version") == last).select("job_id", "verdict")


# ---- counters and units

_RACK_FACTS = f"(SELECT job_id, count(DISTINCT rack) AS analysed, count(*) FILTER (settled) AS settled, count(*) FILTER (without) AS without FROM {_standings(MARGIN, MOST)} GROUP BY job_id)"


@query(
    f"""SELECT coalesce(f.job_id, s.job_id) AS job_id, coalesce(f.analysed, 0) AS analysed, coalesce(f.settled, 0) AS settled, coalesce(f.without, 0) AS without, s.job_id IS NULL OR (coalesce(f.analysed, 0), coalesce(f.settled, 0), coalesce(f.without, 0)) <> (s.analysed, s.settled, s.without) AS changed
    FROM {_RACK_FACTS} f FULL JOIN (SELECT job_id + CASE WHEN job_id = 5 THEN 90 ELSE 0 END AS job_id, analysed, settled + CASE WHEN job_id % 3 = 0 THEN 1 ELSE 0 END AS settled, without FROM {_RACK_FACTS}) s ON s.job_id = f.job_id"""
)
def repair_rack_counters(spark, sf_dir):
    """The stored side counts one too many for some jobs, lacks one job and has one that no fact knows."""
    t = Tables(spark, sf_dir)
    facts = ops.rack_counters(t.analyses, t.standings)
    stored = facts.withColumns({"job_id": F.col("job_id") + F.when(F.col("job_id") == 5, 90).otherwise(0), "settled": F.col("settled") + F.when(F.col("job_id") % 3 == 0, 1).otherwise(0)})
    return ops.repaired(stored, facts, "job_id")


@query(
    f"""SELECT j.job_id, job_type, CAST(CASE job_type WHEN 'games' THEN coalesce(games, 0) WHEN 'game_pairs' THEN coalesce(games, 0) // 2 WHEN 'opening_rack' THEN coalesce(settled, 0) ELSE coalesce(closed, 0) END AS BIGINT) AS units,
    CASE job_type WHEN 'opening_rack' THEN 60 + j.job_id WHEN 'leave_gen' THEN 3 ELSE max_units END AS "of" FROM {sql('jobs')} j LEFT JOIN (SELECT job_id, sum(games) AS games FROM {sql('results')} GROUP BY ALL) r ON r.job_id = j.job_id
    LEFT JOIN (SELECT 4 + 8 * (job_id % 5) AS job_id, count(*) FILTER (settled) AS settled FROM {_standings(MARGIN, MOST)} GROUP BY 1) s ON s.job_id = j.job_id
    LEFT JOIN (SELECT job_id, count(*) FILTER (n % 2 = 0) AS closed FROM (SELECT 6 + 8 * (submission % 4) AS job_id, generation, sum(n) AS n FROM {sql('deltas')} GROUP BY ALL) GROUP BY job_id) g ON g.job_id = j.job_id"""
)
def job_units(spark, sf_dir):
    """Standings and generations of the stand-ins are spread over jobs of their types."""
    t = Tables(spark, sf_dir)
    rows = t.jobs.select("job_id", "job_type", "max_units", (60 + F.col("job_id")).alias("racks"), F.lit(3).cast("long").alias("generations"))
    generations = t.deltas.groupBy((6 + 8 * (F.col("submission") % 4)).alias("job_id"), "generation").agg((F.sum("n") % 2 == 0).alias("closed"))
    return jobs.job_units(rows, t.results, t.standings.select((4 + 8 * (F.col("job_id") % 5)).alias("job_id"), "settled"), generations)


_BACKUPS = f"(SELECT 'store' || CAST(worker % 40 AS VARCHAR) AS name, claimed_at AS finished_at, worker % 40 <> 3 AND event_id % 7 <> 0 AS succeeded FROM (SELECT claim_id AS event_id, * FROM {sql('claims')}))"


@query(f"SELECT name, age, coalesce(age >= 30, true) AS stale FROM (SELECT name, date_diff('second', max(finished_at) FILTER (succeeded), {AS_OF_SQL}) // 3600 AS age FROM {_BACKUPS} GROUP BY name)")
def stale_backups(spark, sf_dir):
    """Claims as the backups of forty stores, of which one never had a good one."""
    rows = Tables(spark, sf_dir).claims.select(F.concat(F.lit("store"), (F.col("worker") % 40).cast("string")).alias("name"), F.col("claimed_at").alias("finished_at"), ((F.col("worker") % 40 != 3) & (F.col("claim_id") % 7 != 0)).alias("succeeded"))
    return ops.stale_backups(rows, as_of(), 30)


# ---- keys, files, logs


@query(f"SELECT record_id FROM {sql('positions')} p WHERE EXISTS (SELECT 1 FROM {sql('positions')} k WHERE k.record_id % 9 = 0 AND k.task = p.task AND xor(k.game_index, 1) = p.game_index AND k.turn = p.turn)")
def positions_by_keys(spark, sf_dir):
    """The other game's positions of every ninth one, by their keys."""
    rows = Tables(spark, sf_dir).positions
    keys = rows.filter("record_id % 9 = 0").select("task", F.col("game_index").bitwiseXOR(F.lit(1).cast("long")).alias("game_index"), "turn")
    return feeds.by_keys(rows, keys).select("record_id")


@query(f"SELECT audit_id, action, actor, CASE WHEN actor % 3 <> 0 THEN 'user' || CAST(actor AS VARCHAR) END AS name, target FROM {sql('audit')}")
def stream_audit(spark, sf_dir):
    """The log as an append stream: a row for each event, named where the actor has a name."""
    folder, t = streams.scratch(spark, "audit"), Tables(spark, sf_dir)
    known = t.audit.select(F.col("actor").alias("worker")).distinct().filter("worker % 3 <> 0").withColumn("name", F.concat(F.lit("user"), F.col("worker").cast("string")))
    events = t.audit.select("audit_id", "action", "actor", "target", "created_at")
    source = streams.replayed(events, f"{folder}/in", max(4, -(-events.count() // 250_000)), "created_at")
    streams.drained(ops.audit_rows(source, known), folder)
    return spark.read.parquet(f"{folder}/out").drop("created_at")


@query("SELECT 'f' || CAST(p_partkey % 25 AS VARCHAR) || '.csv' AS file, substring(p_name, 1, 2) AS letter, CAST(p_size * 100000 AS INT) AS count, CAST(p_size % 11 AS INT) AS score, CAST(CASE WHEN p_partkey % 13 <> 5 THEN p_partkey % 3 END AS INT) AS is_vowel, CAST(CASE WHEN p_partkey % 2 = 0 THEN 5 ELSE 7 END AS INT) AS columns FROM part")
def letter_files(spark, sf_dir):
    """Letter distributions that are written as files of five or seven columns, and read again; some flags aren't numbers."""
    folder = scratch(spark, "letters")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("k", F.col("p_partkey") % 25)
    flag = F.when(F.col("p_partkey") % 13 == 5, "x").otherwise((F.col("p_partkey") % 3).cast("string"))
    cells = [F.substring("p_name", 1, 2), F.lower(F.substring("p_name", 1, 2)), (F.col("p_size") * 100_000).cast("string"), (F.col("p_size") % 11).cast("string"), flag]
    line = F.concat_ws(",", *cells, F.when(F.col("p_partkey") % 2 == 1, F.lit("A,a")))
    part.select("k", F.concat(line, F.when(F.col("p_partkey") % 5 == 0, "\r").otherwise("")).alias("value")).repartition("k").write.partitionBy("k").text(folder)
    rows = inputs.read_distributions(spark, f"{folder}/*/*.txt", r"k=(\d+)/")
    return rows.withColumn("file", F.concat(F.lit("f"), "file", F.lit(".csv")))


@query(f"SELECT d.worker, name FROM (SELECT DISTINCT worker FROM {DONE}) d, LATERAL (SELECT substring(sha256(CAST(worker AS VARCHAR)), 1, 16) AS name) WHERE worker % 10 = 3")
def resolve_pseudonyms(spark, sf_dir):
    """Contributors behind pseudonyms; those that were asked for in upper case or cut short are nobody's."""
    people_ = people.totals(Tables(spark, sf_dir).claims)
    name = people.pseudonym(F.col("worker"))
    asked = people_.filter("worker % 5 = 3").select(F.when(F.col("worker") % 10 == 3, name).otherwise(F.upper(F.substring(name, 1, 15))).alias("name")).distinct()
    return people.resolve_pseudonyms(people_, asked).select("worker", "name")


_ALPHABET = sorted({chr(65 + i) for i in range(26)} | {"QU"})
_PIECES = "regexp_extract_all(upper(word), '\\[QU\\]|QU|[A-Z]|\\?')"


@query(
    f"""SELECT id, array_to_string([CASE WHEN x = 'QU' THEN '[QU]' WHEN x = '~' THEN '?' ELSE x END for x in list_sort([CASE WHEN y = '?' THEN '~' ELSE replace(replace(y, '[', ''), ']', '') END for y in {_PIECES}])], '') AS rack
    FROM (SELECT id, CASE WHEN id % 3 = 0 THEN '?' ELSE '' END || rack || CASE WHEN id % 4 = 0 THEN 'qu' WHEN id % 4 = 1 THEN '[QU]' ELSE '' END AS word FROM {sql('racks_text')})"""
)
def canonical_racks(spark, sf_dir):
    """Racks with blanks and a letter of two characters, which stands before R and is written in brackets."""
    word = F.concat(F.when(F.col("id") % 3 == 0, "?").otherwise(""), "rack", F.when(F.col("id") % 4 == 0, "qu").when(F.col("id") % 4 == 1, "[QU]").otherwise(""))
    return Tables(spark, sf_dir).racks_text.select("id", boards.canonical_rack(word, _ALPHABET).alias("rack"))


# ---- messages


@query(f"SELECT rack, count(*) AS moves, CAST(sum(rank) AS BIGINT) AS ranks, CAST(sum(rank % 3) AS BIGINT) AS plies, CAST(sum(score) AS BIGINT) AS score FROM (SELECT record_id, 'R' || CAST(record_id % 50 AS VARCHAR) AS rack, rank, record_id * rank % 60 AS score FROM {sql('analyses')}, range(1, 6) t(rank) WHERE rank <= 1 + record_id % 5) GROUP BY rack")
def rack_messages(spark, sf_dir):
    """Analyses as JSON messages of racks, parsed and flattened to moves."""
    t = Tables(spark, sf_dir)
    rank = F.filter(F.lit([1, 2, 3, 4, 5]).cast("array<bigint>"), lambda r: r <= 1 + F.col("record_id") % 5)
    plies = lambda r: F.transform(F.filter(F.lit([0, 1, 2]).cast("array<bigint>"), lambda p: p < r % 3), lambda p: F.struct(p.alias("ply")))
    moves = F.transform(rank, lambda r: F.struct(F.concat(F.lit("M"), r.cast("string")).alias("move"), (F.col("record_id") * r % 60).alias("score"), plies(r).alias("plies")))
    rack = F.struct(F.concat(F.lit("R"), (F.col("record_id") % 50).cast("string")).alias("rack"), F.size(rank).alias("num_moves"), moves.alias("moves"))
    text = F.to_json(F.struct(F.col("record_id").cast("string").alias("claim_token"), F.struct(F.array(rack).alias("racks")).alias("result")))
    rows = messages.analyses(t.analyses.select(messages.parsed(text, "opening_rack").alias("m")).select("m.*"))
    return rows.groupBy("rack").agg(F.count("*").alias("moves"), F.sum("rank").alias("ranks"), F.sum("plies").cast("long").alias("plies"), F.sum("score").alias("score"))


@query(f"SELECT game_index, turn AS turn_number, count(*) AS n, CAST(sum(record_id % 3) AS BIGINT) AS leaves, CAST(sum(100 + record_id % 7) FILTER (record_id % 4 <> 0) AS BIGINT) AS draws FROM (SELECT *, CASE WHEN record_id % 4 = 0 THEN 0 ELSE record_id % 3 END AS k FROM {sql('positions')}) GROUP BY ALL".replace("sum(record_id % 3)", "sum(k)"))
def position_messages(spark, sf_dir):
    """Positions as JSON messages of games, some with an inference, parsed and flattened."""
    t = Tables(spark, sf_dir)
    record = F.col("record_id")
    leaves = F.transform(F.filter(F.lit([0, 1]).cast("array<bigint>"), lambda i: i < record % 3), lambda i: F.struct(F.concat(F.lit("L"), i.cast("string")).alias("leave"), i.alias("draws")))
    inference = F.when(record % 4 != 0, F.struct((100 + record % 7).alias("total_draws"), leaves.alias("leaves")))
    position = F.struct("game_index", F.col("turn").alias("turn_number"), F.lit(1).alias("player"), F.col("rack").cast("string").alias("rack"), inference.alias("inference"))
    text = F.to_json(F.struct(record.cast("string").alias("claim_token"), F.struct(F.array(position).alias("positions")).alias("result")))
    rows = messages.captured(t.positions.select(messages.parsed(text, "games").alias("m")).select("m.*"))
    return rows.groupBy("game_index", "turn_number").agg(F.count("*").alias("n"), F.sum("leaves").cast("long").alias("leaves"), F.sum("total_draws").alias("draws"))


@query(f"SELECT generation, rack, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * 125) AS BIGINT) AS equity_cents FROM {sql('deltas')} GROUP BY ALL")
def leave_messages(spark, sf_dir):
    """Deltas as JSON messages of leaves, parsed, staged and folded."""
    from ..operators import coverage

    t = Tables(spark, sf_dir)
    rack = F.struct(F.col("rack").cast("string").alias("rack"), F.col("n").alias("count"), F.lit(1.25).alias("mean"))
    sent = t.deltas.groupBy("submission").agg(F.collect_list(rack).alias("racks"))
    text = F.to_json(F.struct(F.col("submission").cast("string").alias("claim_token"), F.struct("racks").alias("result")))
    staged = messages.leave_deltas(sent.select(messages.parsed(text, "leave_gen").alias("m")).select("m.*"), F.col("claim_token").cast("long") % 3)
    return coverage.fold(staged).withColumn("rack", F.col("rack").cast("long"))
