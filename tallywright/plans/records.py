"""More queries by name: jobs, feeds, validation, inputs, repair and boards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import PENT
from ..operators import boards, coverage, feeds, inputs, jobs, ops, quality, ratings
from ..sources import messages
from ..sources.standins import sql
from ..streaming.streams import scratch
from .catalogue import AS_OF_SQL, CLAIMS, DONE, MARGIN, MERGED, MOST, MOVES, Tables, _standings, as_of, query, rounded

# ---- jobs


@query(
    f"""SELECT j.job_id, j.job_type, j.status, coalesce(c.claims, 0) AS claims, coalesce(c.completed, 0) AS completed, coalesce(c.claimed, 0) AS claimed, coalesce(c.abandoned, 0) AS abandoned, coalesce(c.declined, 0) AS declined,
    coalesce(c.compute_ms, 0) AS compute_ms, coalesce(c.movegens, 0) AS movegens, coalesce(r.batches, 0) AS batches, coalesce(r.games, 0) AS games FROM {sql("jobs")} j LEFT JOIN
    (SELECT job_id, count(*) AS claims, {", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ("completed", "claimed", "abandoned", "declined"))}, CAST(coalesce(sum(held_ms) FILTER (state = 'completed'), 0) AS BIGINT) AS compute_ms,
    CAST(coalesce(sum(movegens) FILTER (state = 'completed'), 0) AS BIGINT) AS movegens FROM {CLAIMS} GROUP BY ALL) c ON c.job_id = j.job_id LEFT JOIN (SELECT job_id, count(*) AS batches, CAST(sum(games) AS BIGINT) AS games FROM {sql("results")} GROUP BY ALL) r ON r.job_id = j.job_id"""
)
def job_stats(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return jobs.job_stats(t.jobs, t.claims, t.results)


_RECENT = f"(SELECT job_id, count(*) AS recent, count(*) / 3600.0 AS per_second FROM {DONE} WHERE completed_at > {AS_OF_SQL} - INTERVAL 1 HOUR AND completed_at <= {AS_OF_SQL} GROUP BY ALL)"


@query(f"SELECT job_id, recent, round(per_second, 6) AS per_second FROM {_RECENT}")
def throughput(spark, sf_dir):
    return rounded(jobs.throughput(Tables(spark, sf_dir).claims, as_of()), "per_second")


@query(
    f"""SELECT job_id, units, round(least(1.0, units / max_units), 6) AS fraction, round(greatest(0.0, (max_units - units) / (per_second * pace)), 6) AS eta_seconds FROM
    (SELECT j.job_id, j.max_units, coalesce(r.games, 0) / f AS units, r.batch / f AS pace, t.per_second FROM (SELECT *, CASE job_type WHEN 'game_pairs' THEN 2.0 ELSE 1.0 END AS f FROM {sql("jobs")} WHERE job_type IN ('games', 'game_pairs')) j
    LEFT JOIN (SELECT job_id, CAST(sum(games) AS DOUBLE) AS games, avg(games) AS batch FROM {sql("results")} GROUP BY ALL) r ON r.job_id = j.job_id LEFT JOIN {_RECENT} t ON t.job_id = j.job_id)"""
)
def job_progress(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rounded(jobs.job_progress(t.jobs, t.results, t.claims, as_of()), "fraction", "eta_seconds")


_OTHER = f"(SELECT *, 60 + job_id AS total FROM {sql('jobs')} WHERE job_type IN ('opening_rack', 'leave_gen'))"
_RACKS = f"(SELECT 4 + 8 * (job_id % 5) AS job_id, count(*) AS analysed, count(*) FILTER (settled) AS settled FROM {_standings(MARGIN, MOST)} GROUP BY 1)"
_CLOSED = f"(SELECT job_id, count(*) FILTER (n % 2 = 0) AS closed FROM (SELECT 6 + 8 * (submission % 4) AS job_id, generation, sum(n) AS n FROM {sql('deltas')} GROUP BY ALL) GROUP BY job_id)"


@query(
    f"""SELECT job_id, job_type, units, total AS max_units, round(least(1.0, units / total), 6) AS fraction, round(pace * 3600, 6) AS per_hour,
    round(CASE job_type WHEN 'opening_rack' THEN (greatest(0, total - analysed) * {min(MARGIN, MOST)} + analysed - settled) / pace END, 6) AS eta_seconds FROM
    (SELECT j.job_id, job_type, total, coalesce(analysed, 0) AS analysed, coalesce(settled, 0) AS settled, CASE job_type WHEN 'opening_rack' THEN coalesce(settled, 0) ELSE coalesce(closed, 0) END AS units,
    CASE status WHEN 'active' THEN per_second * allocation END AS pace FROM {_OTHER} j LEFT JOIN {_RACKS} r ON r.job_id = j.job_id LEFT JOIN {_CLOSED} c ON c.job_id = j.job_id LEFT JOIN {_RECENT} t ON t.job_id = j.job_id)"""
)
def other_progress(spark, sf_dir):
    """Rack and leave jobs; their standings and generations are spread over jobs of those types."""
    t = Tables(spark, sf_dir)
    rows = t.jobs.select("job_id", "job_type", "status", F.col("allocation").alias("per_claim"), (60 + F.col("job_id")).alias("total"), F.lit(MARGIN).alias("margin"), F.lit(MOST).alias("most"))
    standings = t.standings.select((4 + 8 * (F.col("job_id") % 5)).alias("job_id"), "settled")
    generations = t.deltas.groupBy((6 + 8 * (F.col("submission") % 4)).alias("job_id"), "generation").agg((F.sum("n") % 2 == 0).alias("closed"))
    return rounded(jobs.other_progress(rows, standings, generations, t.claims, as_of()), "fraction", "per_hour", "eta_seconds")


_GAP = f"(SELECT job_id FROM {CLAIMS} WHERE state = 'declined' AND claimed_at > TIMESTAMP '2024-01-10' - INTERVAL 1 DAY)"
_QUIET = f"(SELECT * FROM {CLAIMS} WHERE job_id % 4 <> 0)"
_STALLED = f"(SELECT job_id FROM {sql('jobs')} WHERE status = 'active' AND job_id IN {_GAP} AND job_id NOT IN (SELECT job_id FROM {_QUIET} WHERE state = 'completed' AND completed_at > TIMESTAMP '2024-01-10' - INTERVAL 1 DAY) AND job_id NOT IN (SELECT job_id FROM {_QUIET} WHERE state = 'claimed'))"


def stalled(t: Tables):
    gaps = t.claims.filter("state = 'declined'").select("job_id", F.col("claimed_at").alias("reported_at"))
    return jobs.stalled_jobs(t.jobs, t.claims.filter("job_id % 4 <> 0"), gaps, F.expr("TIMESTAMP '2024-01-10 00:00:00'"))


@query(f"SELECT job_id FROM {_STALLED}")
def stalled_jobs(spark, sf_dir):
    return stalled(Tables(spark, sf_dir)).select("job_id")


@query(
    f"""SELECT j.job_id, j.status, CASE WHEN title IS NOT NULL THEN title || ': ' ELSE '' END || p1_name || ' vs ' || p2_name AS name, coalesce(CASE job_type WHEN 'game_pairs' THEN games // 2 ELSE games END, 0) AS units, s.job_id IS NOT NULL AS stalled
    FROM {sql("jobs")} j LEFT JOIN (SELECT job_id, CAST(sum(games) AS BIGINT) AS games FROM {sql("results")} GROUP BY ALL) r ON r.job_id = j.job_id LEFT JOIN {_STALLED} s ON s.job_id = j.job_id
    ORDER BY CASE status WHEN 'active' THEN 0 WHEN 'paused' THEN 1 ELSE 2 END, j.job_id DESC LIMIT 20 OFFSET 5"""
)
def job_list(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return jobs.job_list(t.jobs, t.results, stalled(t), 20, 5)


_RATIOS = f"""(SELECT j.job_id, coalesce(c.issued, 0) AS issued, (coalesce(c.issued, 0) - baseline) / allocation AS ratio, last_us >= max(last_us) OVER () - 3600000000 AS served FROM (SELECT * FROM {sql("jobs")} WHERE status = 'active') j
    LEFT JOIN (SELECT job_id, count(*) AS issued, max(epoch_us(claimed_at)) AS last_us FROM {CLAIMS} WHERE version >= '0.1.3' GROUP BY ALL) c ON c.job_id = j.job_id)"""


@query(f"SELECT job_id, issued, round(ratio, 6) AS ratio, rank() OVER (ORDER BY ratio) AS place, round(coalesce(min(ratio) FILTER (served) OVER (), max(ratio) OVER (), 0), 6) AS joining_ratio FROM {_RATIOS}")
def allocation_report(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rounded(jobs.allocation_report(t.jobs, t.claims, 3600, "0.1.3"), "ratio", "joining_ratio")


_TASKS = f"(SELECT task_id, count(*) FILTER (state = 'completed') AS accepted, count(*) FILTER (state = 'claimed') AS open, epoch_us(max(completed_at)) AS completed_us FROM {CLAIMS} GROUP BY ALL)"


@query(f"SELECT task_id, accepted, open, CASE WHEN accepted > 0 THEN 'completed' WHEN open > 0 THEN 'in_progress' ELSE 'pending' END AS state, completed_us FROM {_TASKS}")
def task_states(spark, sf_dir):
    return jobs.task_states(Tables(spark, sf_dir).claims)


# ---- feeds


@query(
    f"""SELECT r.result_id, r.job_id, epoch_us(submitted_at) AS submitted_us, games, j.job_type, j.p1_name, j.p2_name FROM (SELECT * FROM {sql("results")} WHERE (submitted_at, result_id) < (TIMESTAMP '1996-06-01', 5000) ORDER BY submitted_at DESC, result_id DESC LIMIT 50) r JOIN {sql("jobs")} j ON j.job_id = r.job_id"""
)
def results_feed(spark, sf_dir):
    t = Tables(spark, sf_dir)
    page = feeds.results_feed(t.results, t.jobs, (F.expr("TIMESTAMP '1996-06-01 00:00:00'"), 5000), 50)
    return page.select("result_id", "job_id", F.unix_micros("submitted_at").alias("submitted_us"), "games", "job_type", "p1_name", "p2_name")


@query(f"SELECT generation, rack, n FROM {MERGED} WHERE generation < 2 OR generation = 2 AND rack > 150 ORDER BY generation DESC, rack LIMIT 100")
def progress_feed(spark, sf_dir):
    return feeds.progress_feed(Tables(spark, sf_dir).merged, (2, 150), 100).select("generation", "rack", "n")


@query(
    f"""SELECT a.job_id, a.record_id, analysis, rank, move, score FROM (SELECT *, dense_rank() OVER (PARTITION BY job_id, rack ORDER BY record_id) AS analysis, 12 // count(*) OVER (PARTITION BY rack) AS share FROM {sql("analyses")} WHERE rack = 7) a JOIN {MOVES} m ON m.record_id = a.record_id WHERE rank <= share"""
)
def rack_lookup(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return feeds.rack_lookup(t.analyses, t.moves, 7, 12).withColumn("analysis", F.col("analysis").cast("long"))


@query(f"SELECT rack FROM (SELECT DISTINCT rack FROM {sql('analyses')}) ORDER BY CAST('0x' || substring(md5('42:' || CAST(rack AS VARCHAR)), 1, 15) AS BIGINT), rack LIMIT 20")
def rack_samples(spark, sf_dir):
    return feeds.rack_samples(Tables(spark, sf_dir).analyses, 20, 42)


@query(
    f"""SELECT probe, coalesce((SELECT min(rack) FROM {sql("analyses")} a WHERE a.rack >= p.probe), (SELECT min(rack) FROM {sql("analyses")})) AS rack FROM (SELECT DISTINCT p_partkey AS probe FROM part) p"""
)
def next_key_probe(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return feeds.next_key(t.analyses, spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("probe")).distinct())


@query(f"SELECT a.record_id, a.task, a.game_index, a.turn, a.rack, b.record_id AS partner_id, b.rack AS partner_rack FROM {sql('positions')} a LEFT JOIN {sql('positions')} b ON b.task = a.task AND b.turn = a.turn AND b.game_index = xor(a.game_index, 1)")
def saved_positions_partner(spark, sf_dir):
    rows = feeds.partners(Tables(spark, sf_dir).positions)
    return rows.select("record_id", "task", "game_index", "turn", "rack", F.col("partner.record_id").alias("partner_id"), F.col("partner.rack").alias("partner_rack"))


@query(f"SELECT record_id FROM {sql('positions')} a WHERE game_index % 2 = 0 OR NOT EXISTS (SELECT 1 FROM {sql('positions')} b WHERE b.task = a.task AND b.turn = a.turn AND b.rack = a.rack AND b.game_index = a.game_index - 1)")
def partner_dedup(spark, sf_dir):
    return feeds.without_repeats(Tables(spark, sf_dir).positions).select("record_id")


@query(
    f"""SELECT a.job_id, a.record_id, a.rack, string_agg(m.move || ':' || CAST(m.score AS VARCHAR), ',' ORDER BY m.rank) AS moves, c.top_move AS agreed_move, c.settled FROM {sql("analyses")} a JOIN {MOVES} m ON m.record_id = a.record_id
    JOIN {_standings(MARGIN, MOST)} c ON c.job_id = a.job_id AND c.rack = a.rack GROUP BY ALL"""
)
def export_corpus(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = feeds.nested_records(t.analyses.drop("top_move"), t.moves, t.standings)
    moves = F.array_join(F.transform("moves", lambda m: F.concat_ws(":", m["move"], m["score"])), ",")
    return rows.select("job_id", "record_id", "rack", moves.alias("moves"), F.col("consensus.top_move").alias("agreed_move"), F.col("consensus.settled").alias("settled"))


@query(f"SELECT job_id, status = 'completed' AND job_id NOT IN (SELECT job_id FROM {_QUIET} WHERE state = 'claimed') AND job_id NOT IN (SELECT l_orderkey % 40 FROM lineitem WHERE l_orderkey % 5 = 1) AS final FROM {sql('jobs')}")
def export_finality(spark, sf_dir):
    t = Tables(spark, sf_dir)
    staged = t.deltas.filter("submission % 5 = 1").select((F.col("submission") % 40).alias("job_id"))
    return feeds.export_finality(t.jobs, t.claims.filter("job_id % 4 <> 0"), staged)


# ---- validation

_P = "(pent_0 + pent_1 + pent_2 + pent_3 + pent_4)"
_RULES = {
    "tally_sum": "wins + losses + ties <> games",
    "tally_negative": "least(games, wins, losses, ties) < 0",
    "mean_range": "p1_score_mean NOT BETWEEN -100 AND 3000 OR p2_score_mean NOT BETWEEN -100 AND 3000",
    "pent_games": f"{_P} * 2 <> games",
    "pent_range": "least(pent_0, pent_1, pent_2, pent_3, pent_4) < 0 OR greatest(pent_0, pent_1, pent_2, pent_3, pent_4) > games",
    "pent_half_points": "pent_1 + 2 * pent_2 + 3 * pent_3 + 4 * pent_4 <> 2 * wins + ties",
    "pent_draws": "ties < pent_1 + pent_3 OR (ties - pent_1 - pent_3) % 2 <> 0 OR ties > pent_1 + pent_3 + 2 * pent_2",
    "divergent_exceeds": "divergent_games > games OR divergent_wins > wins OR divergent_losses > losses OR divergent_ties > ties",
    "divergent_rest": "wins - divergent_wins <> losses - divergent_losses OR (ties - divergent_ties) % 2 <> 0",
    "divergent_unsplit": "pent_2 - (games - divergent_games) / 2 > divergent_games / 2",
}


@query(" UNION ALL ".join(f"SELECT result_id, '{name}' AS rule FROM {sql('results_faulty')} WHERE {rule}" for name, rule in _RULES.items()))
def validate_results(spark, sf_dir):
    return quality.validate_results(Tables(spark, sf_dir).results_faulty)


@query(f"SELECT count(*) AS rows, CAST(sum(CAST(bad AS INT)) AS BIGINT) AS quarantined FROM (SELECT {' OR '.join(f'({r})' for r in _RULES.values())} AS bad FROM {sql('results_faulty')})")
def quarantine_results(spark, sf_dir):
    rows = Tables(spark, sf_dir).results_faulty
    clean, bad = quality.quarantined(rows, quality.validate_results(rows), "result_id")
    return clean.select(F.lit(0).alias("q")).unionByName(bad.select(F.lit(1).alias("q"))).agg(F.count("*").alias("rows"), F.sum("q").alias("quarantined"))


_FAULTY_POSITIONS = f"(SELECT record_id, task, game_index % 3 AS game_index, turn + CASE WHEN record_id % 97 = 0 THEN 401 ELSE 0 END AS turn, record_id % 4 AS player, record_id % 5 AS num_moves FROM {sql('positions')})"


@query(
    f"""WITH p AS (SELECT *, count(*) OVER (PARTITION BY task, game_index, turn) AS n FROM {_FAULTY_POSITIONS})
    SELECT record_id, 'position_repeated' AS rule FROM p WHERE n > 1 UNION ALL SELECT record_id, 'game_range' FROM p WHERE game_index NOT BETWEEN 0 AND 1 UNION ALL SELECT record_id, 'turn_range' FROM p WHERE turn NOT BETWEEN 0 AND 400
    UNION ALL SELECT record_id, 'player' FROM p WHERE player NOT IN (1, 2) UNION ALL SELECT record_id, 'no_moves' FROM p WHERE num_moves < 1"""
)
def validate_positions(spark, sf_dir):
    rows = Tables(spark, sf_dir).positions
    turn = F.col("turn") + F.when(F.col("record_id") % 97 == 0, 401).otherwise(0)
    return quality.validate_positions(rows.withColumns({"game_index": F.col("game_index") % 3, "turn": turn, "player": F.col("record_id") % 4, "num_moves": F.col("record_id") % 5}), 2)


@query(
    f"""WITH p AS (SELECT CAST(task AS VARCHAR) || ':' || CAST(game_index // 2 AS VARCHAR) AS id, count(*) AS n, count(DISTINCT game_index) AS g, min(turn) AS t0, max(turn) AS t1, min(rack) AS r0, max(rack) AS r1 FROM {sql("positions")} WHERE record_id % 7 <> 0 GROUP BY task, game_index // 2)
    SELECT id, 'not_two' AS rule FROM p WHERE n <> 2 UNION ALL SELECT id, 'not_one_each' FROM p WHERE g <> 2 UNION ALL SELECT id, 'turns_differ' FROM p WHERE t0 <> t1 UNION ALL SELECT id, 'racks_differ' FROM p WHERE r0 <> r1"""
)
def validate_divergences(spark, sf_dir):
    return quality.validate_divergences(Tables(spark, sf_dir).positions.filter("record_id % 7 <> 0"))


#: Moves with faults of every kind: columns as Spark SQL and DuckDB both read them.
_FAULTY_MOVES = {
    "move": "CASE WHEN record_id % 31 = 0 THEN repeat('x', 257) WHEN record_id % 37 = 0 THEN 'a' || chr(0) ELSE move END",
    "rank": "rank - CASE WHEN record_id % 41 = 0 THEN 1 ELSE 0 END",
    "score": "score - 3",
    "equity": "CASE WHEN record_id % 43 = 0 THEN CAST('NaN' AS DOUBLE) WHEN record_id % 47 = 0 THEN -200001.0 ELSE 200000.0 END",
    "win_percentage": "CAST(record_id % 103 AS DOUBLE) - 1",
    "blended_utility": "CASE WHEN record_id % 53 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN record_id % 59 = 0 THEN -0.2 ELSE 0.5 END",
}
_MOVE_RULES = {
    "score_range": "score NOT BETWEEN 0 AND 100000",
    "play_text": "length(move) > 256 OR contains(move, chr(0))",
    "rank": "rank < 1",
    "equity_range": "isnan(equity) OR abs(equity) > 200000",
    "win_range": "win_percentage NOT BETWEEN 0 AND 100",
    "utility": "blended_utility NOT BETWEEN 0 AND 1",
}
_MOVES_SQL = f"(SELECT record_id, {', '.join(f'{v} AS {k}' for k, v in _FAULTY_MOVES.items())} FROM {MOVES})"


@query(" UNION ALL ".join(f"SELECT CAST(record_id AS VARCHAR) || ':' || CAST(rank AS VARCHAR) AS id, '{k}' AS rule FROM {_MOVES_SQL} WHERE {v}" for k, v in _MOVE_RULES.items()))
def validate_moves(spark, sf_dir):
    moves = Tables(spark, sf_dir).moves
    return quality.validate_moves(moves.selectExpr("record_id", *(f"{v} AS {k}" for k, v in _FAULTY_MOVES.items())))


_FAULTY_RECORDS = {
    "num_moves": "record_id % 7",
    "listed": "record_id % 5",
    "position": "CASE WHEN record_id % 61 = 0 THEN repeat('p', 4097) ELSE 'p' END",
    "rack": "CASE WHEN record_id % 67 = 0 THEN 'A' || chr(0) ELSE 'A' END",
    "previous_move": "CASE WHEN record_id % 71 = 0 THEN repeat('m', 300) ELSE 'm' END",
}
_RECORD_RULES = {
    "listed": "listed > num_moves",
    "position_length": "length(position) > 4096",
    "play_length": "greatest(length(rack), length(previous_move)) > 256",
    "nul": "contains(rack, chr(0))",
}
_RECORDS_SQL = f"(SELECT record_id, {', '.join(f'{v} AS {k}' for k, v in _FAULTY_RECORDS.items())} FROM {sql('analyses')})"


@query(" UNION ALL ".join(f"SELECT record_id, '{k}' AS rule FROM {_RECORDS_SQL} WHERE {v}" for k, v in _RECORD_RULES.items()))
def validate_records(spark, sf_dir):
    return quality.validate_records(Tables(spark, sf_dir).analyses.selectExpr("record_id", *(f"{v} AS {k}" for k, v in _FAULTY_RECORDS.items())))


_DEVIATIONS = {"games": "result_id % 3", "p1_score_sd": "CAST(result_id % 13 AS DOUBLE) - 1", "p2_score_sd": "CASE WHEN result_id % 29 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE 0.0 END"}
_DEVIATION_RULES = {"sd_range": "least(p1_score_sd, p2_score_sd) < 0 OR isinf(p2_score_sd)", "sd_of_one": "games <= 1 AND greatest(p1_score_sd, p2_score_sd) > 0"}
_DEVIATIONS_SQL = f"(SELECT result_id, {', '.join(f'{v} AS {k}' for k, v in _DEVIATIONS.items())} FROM {sql('results')})"


@query(" UNION ALL ".join(f"SELECT result_id, '{k}' AS rule FROM {_DEVIATIONS_SQL} WHERE {v}" for k, v in _DEVIATION_RULES.items()))
def validate_deviations(spark, sf_dir):
    return quality.validate_deviations(Tables(spark, sf_dir).results.selectExpr("result_id", *(f"{v} AS {k}" for k, v in _DEVIATIONS.items())))


_LEXICON_NAMES = ("CSW24", "nwl23", "OSPD6", "OSW", "TWL06", "America", "data/lexica/CEL23", "RD29", "NSF23", "DISC2", "FRA24", "OSPS49", "dsw15", "english", "csw/odd")
_BOARD_NAMES = ("english", "english_super", "German", "letterdistributions/norwegian", "catalan", "french", "polish", "dutch", "CSW24")


def _named(names, expression):
    return f"CASE ({expression}) % {len(names)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(names)) + " END"


_FILES = {
    "p1_lexicon": _named(_LEXICON_NAMES, "result_id"),
    "p1_leaves": _named(_LEXICON_NAMES, "result_id + CASE WHEN result_id % 8 = 0 THEN 1 ELSE 0 END"),
    "p2_lexicon": _named(_LEXICON_NAMES, "result_id + CASE WHEN result_id % 9 = 0 THEN 1 ELSE 0 END"),
    "p2_leaves": _named(_LEXICON_NAMES, "result_id + CASE WHEN result_id % 9 = 0 THEN 1 ELSE 0 END"),
    "distribution": f"CASE WHEN result_id % 4 <> 0 AND result_id % {len(_LEXICON_NAMES)} < 7 THEN 'english' ELSE {_named(_BOARD_NAMES, 'result_id')} END",
}


def _language(column, table):
    base = f"lower(regexp_extract({column}, '[^/]*$'))"
    return "CASE " + " ".join(f"WHEN starts_with({base}, '{start.lower()}') THEN '{language}'" for language, starts in table.items() for start in starts) + " END"


_LANGUAGES = {k: _language(k, quality.DISTRIBUTIONS if k == "distribution" else quality.LEXICONS) for k in _FILES}
_FILE_RULES = {"p1_leaves": ("p1_lexicon", "p1_leaves"), "p1_distribution": ("p1_lexicon", "distribution"), "p2_leaves": ("p2_lexicon", "p2_leaves"), "p2_distribution": ("p2_lexicon", "distribution"), "lexicons_differ": ("p1_lexicon", "p2_lexicon"), "leaves_differ": ("p1_leaves", "p2_leaves")}
_FILES_SQL = f"(SELECT result_id, {', '.join(f'{v} AS {k}' for k, v in _LANGUAGES.items())} FROM (SELECT result_id, {', '.join(f'{v} AS {k}' for k, v in _FILES.items())} FROM {sql('results')}))"


@query(" UNION ALL ".join(f"SELECT result_id, '{rule}' AS rule FROM {_FILES_SQL} WHERE coalesce({a} <> {b}, true)" for rule, (a, b) in _FILE_RULES.items()))
def validate_job_files(spark, sf_dir):
    return quality.validate_job_files(Tables(spark, sf_dir).results.selectExpr("result_id", *(f"{v} AS {k}" for k, v in _FILES.items())), "result_id")


@query(
    f"""WITH a AS (SELECT submission, list(rack) AS keys FROM {sql("deltas")} WHERE submission % 11 <> 0 GROUP BY 1), r AS (SELECT submission, list_distinct(list(rack)) AS sent FROM {sql("deltas")} WHERE submission % 13 <> 0 AND rack % 17 <> 0 GROUP BY 1)
    SELECT a.submission AS id, 'unknown_request' AS rule FROM a LEFT JOIN r ON r.submission = a.submission WHERE sent IS NULL UNION ALL SELECT a.submission, 'key_count' FROM a JOIN r ON r.submission = a.submission WHERE len(keys) <> len(sent)
    UNION ALL SELECT a.submission, 'key_unknown' FROM a JOIN r ON r.submission = a.submission WHERE len(list_filter(keys, lambda x: NOT list_contains(sent, x))) > 0
    UNION ALL SELECT a.submission, 'key_repeated' FROM a WHERE len(list_distinct(keys)) <> len(keys)"""
)
def validate_keys(spark, sf_dir):
    rows = Tables(spark, sf_dir).deltas
    keys = lambda df, gather: df.groupBy(F.col("submission").alias("id")).agg(gather("rack").alias("keys"))
    return quality.validate_keys(keys(rows.filter("submission % 11 <> 0"), F.collect_list), keys(rows.filter("submission % 13 <> 0 and rack % 17 <> 0"), F.collect_set))


@query(f"SELECT result_id, 'batch_size' AS rule FROM {sql('results')} WHERE games <> (result_id % 9 + 1) * CASE WHEN job_id % 4 = 1 THEN 1 ELSE 2 END")
def validate_batches(spark, sf_dir):
    rows = Tables(spark, sf_dir).results
    return quality.validate_batches(rows, rows.select("result_id", (F.col("result_id") % 9 + 1).alias("dispatched"), (F.col("job_id") % 4 != 1).alias("paired")))


@query(f"SELECT claim_id, 'throughput' AS rule FROM {CLAIMS} WHERE movegens * 1000000 > 1000000 * greatest(held_ms, 1) UNION ALL SELECT claim_id, 'negative' FROM {CLAIMS} WHERE least(movegens, held_ms) < 0")
def validate_claims(spark, sf_dir):
    return quality.validate_claims(Tables(spark, sf_dir).claims.withColumn("movegens", F.col("movegens") * 1_000_000))


@query(f"SELECT 'data/' || CAST(doc_id * 2 // 3 AS VARCHAR) AS path, count(DISTINCT sha256) AS contents FROM {sql('input_data')} GROUP BY 1 HAVING count(DISTINCT sha256) > 1")
def name_conflicts(spark, sf_dir):
    # of three files in a row the first two share a name
    files = Tables(spark, sf_dir).input_data.withColumn("path", F.concat(F.lit("data/"), F.expr("doc_id * 2 div 3").cast("string")))
    return quality.name_conflicts(files)


_COUNTERS = f"(SELECT job_id, count(*) FILTER (state = 'completed') + CAST(job_id = 7 AS INT) AS completed FROM {CLAIMS} GROUP BY job_id)"


@query(
    f"""SELECT 'orphan_claims' AS "check", count(*) AS n FROM {CLAIMS} WHERE job_id NOT IN (SELECT job_id FROM {sql("jobs")} WHERE job_id % 10 <> 3) UNION ALL SELECT 'counter_differences', count(*) FROM {_COUNTERS} c JOIN (SELECT job_id, count(*) FILTER (state = 'completed') AS n FROM {CLAIMS} GROUP BY ALL) f ON f.job_id = c.job_id WHERE c.completed <> f.n
    UNION ALL SELECT 'endless_claims', count(*) FROM {CLAIMS} WHERE state = 'completed' AND completed_at IS NULL"""
)
def check_restore(spark, sf_dir):
    t = Tables(spark, sf_dir)
    counters = t.claims.groupBy("job_id").agg(F.count_if(F.col("state") == "completed").alias("c")).select("job_id", (F.col("c") + (F.col("job_id") == 7).cast("int")).alias("completed"))
    return quality.check_restore(t.claims, t.jobs.filter("job_id % 10 <> 3"), counters)


# ---- inputs

_STAGED = f"(SELECT DISTINCT path, sha256 FROM {sql('input_data')})"
_KNOWN = f"(SELECT path, sha256 FROM {sql('input_data')} WHERE doc_id % 3 <> 0)"
_DIFF = f"(SELECT s.path, s.sha256, CASE WHEN (s.path, s.sha256) IN (SELECT (path, sha256) FROM {_KNOWN}) THEN 'known' WHEN s.path IN (SELECT path FROM {_KNOWN}) THEN 'collision' ELSE 'new' END AS disposition FROM {_STAGED} s)"


def diff(t: Tables):
    return inputs.input_diff(t.input_data, t.input_data.filter("doc_id % 3 <> 0"))


@query(f"SELECT * FROM {_DIFF}")
def input_diff(spark, sf_dir):
    return diff(Tables(spark, sf_dir))


@query(f"SELECT disposition, count(*) AS files FROM {_DIFF} GROUP BY disposition")
def input_diff_counts(spark, sf_dir):
    return inputs.nothing_new(diff(Tables(spark, sf_dir)))


_NEEDS = "(SELECT DISTINCT CASE WHEN doc_id % 12 < 9 THEN 'P' || CAST(doc_id % 12 AS VARCHAR) ELSE 'board' || CAST(doc_id % 12 - 9 AS VARCHAR) END AS owner, path FROM {src})".replace("{src}", sql("input_data"))
_OWNERS = f"(SELECT job_id, unnest([p1_name, p2_name, 'board' || CAST(letterdist AS VARCHAR)]) AS owner FROM {sql('jobs')})"


@query(f"SELECT DISTINCT o.job_id, n.path, f.sha256 FROM {_OWNERS} o JOIN {_NEEDS} n ON n.owner = o.owner JOIN (SELECT path, min(sha256) AS sha256 FROM {sql('input_data')} GROUP BY ALL) f ON f.path = n.path")
def expected_data(spark, sf_dir):
    t = Tables(spark, sf_dir)
    k = F.col("doc_id") % 12
    owner = F.when(k < 9, F.concat(F.lit("P"), k.cast("string"))).otherwise(F.concat(F.lit("board"), (k - 9).cast("string")))
    needs = t.input_data.select(owner.alias("owner"), "path").distinct()
    return inputs.expected_data(t.jobs, needs, t.input_data.groupBy("path").agg(F.min("sha256").alias("sha256")))


_DERIVED = f"(SELECT job_id, 'wordmap' AS kind, letterdist AS lexicon, CAST(NULL AS BIGINT) AS leaves FROM {sql('jobs')} UNION SELECT job_id, 'rackmap', letterdist, variant FROM {sql('jobs')} WHERE job_type = 'game_pairs' UNION SELECT job_id, 'wordtable', letterdist, NULL FROM {sql('jobs')} WHERE job_type = 'opening_rack')"


@query(f"SELECT * FROM {_DERIVED}")
def derived_needs(spark, sf_dir):
    return inputs.derived_needs(Tables(spark, sf_dir).jobs)


@query(f"SELECT n.*, coalesce(b.state, 'missing') AS state FROM {_DERIVED} n LEFT JOIN (SELECT DISTINCT kind, lexicon, leaves, 'ready' AS state FROM {_DERIVED} WHERE lexicon <> 1) b ON b.kind = n.kind AND b.lexicon IS NOT DISTINCT FROM n.lexicon AND b.leaves IS NOT DISTINCT FROM n.leaves")
def derived_readiness(spark, sf_dir):
    needs = inputs.derived_needs(Tables(spark, sf_dir).jobs)
    return inputs.derived_readiness(needs, needs.filter("lexicon <> 1").select("kind", "lexicon", "leaves", F.lit("ready").alias("state")).distinct())


@query(f"SELECT job_id, count(*) AS declined, count(DISTINCT (worker, is_anon)) AS workers, max(epoch_us(claimed_at)) AS last_us FROM {CLAIMS} WHERE state = 'declined' GROUP BY job_id")
def data_gaps(spark, sf_dir):
    return inputs.data_gaps(Tables(spark, sf_dir).claims)


@query(f"SELECT role, count(*) AS claims, count(DISTINCT worker) AS workers, place FROM {CLAIMS} JOIN (VALUES ('wmp', 1, 1), ('wit', 2, 2), ('rit', 4, 3)) t(role, bit, place) ON (skip_bits & bit) <> 0 GROUP BY role, place".replace("AS workers, place", "AS workers, CAST(place AS BIGINT) AS place"))
def skipped_tables(spark, sf_dir):
    return inputs.skipped_tables(Tables(spark, sf_dir).claims).withColumn("place", F.col("place").cast("long"))


@query(f"SELECT version, count(*) AS claims, count(DISTINCT (worker, is_anon)) AS workers FROM {CLAIMS} WHERE state = 'claimed' OR state = 'completed' AND completed_at > {AS_OF_SQL} - INTERVAL 7 DAY GROUP BY version")
def fleet(spark, sf_dir):
    return inputs.fleet(Tables(spark, sf_dir).claims, as_of())


# ---- repair and audit

_FACTS = f"(SELECT worker, is_anon, count(*) AS tasks, CAST(sum(held_ms) AS BIGINT) AS compute_ms, CAST(sum(movegens) AS BIGINT) AS movegens FROM {DONE} GROUP BY ALL)"
_STORED = f"(SELECT worker, is_anon, tasks + CAST(worker % 10 = 0 AS INT) AS tasks, compute_ms, movegens FROM {_FACTS} WHERE worker % 17 <> 1)"


def stored(t: Tables):
    return ops.recount(t.claims).filter("worker % 17 <> 1").withColumn("tasks", F.col("tasks") + (F.col("worker") % 10 == 0).cast("int"))


@query(f"SELECT worker, is_anon, tasks, compute_ms, movegens FROM {_FACTS}")
def contributor_recount(spark, sf_dir):
    return ops.recount(Tables(spark, sf_dir).claims)


@query(
    f"""SELECT coalesce(s.worker, f.worker) AS worker, coalesce(s.is_anon, f.is_anon) AS is_anon, coalesce(s.tasks, 0) AS tasks, coalesce(s.compute_ms, 0) AS compute_ms, coalesce(s.movegens, 0) AS movegens, coalesce(f.tasks, 0) AS fact_tasks, coalesce(f.compute_ms, 0) AS fact_compute_ms, coalesce(f.movegens, 0) AS fact_movegens
    FROM {_STORED} s FULL JOIN {_FACTS} f ON f.worker = s.worker AND f.is_anon = s.is_anon WHERE (coalesce(s.tasks, 0), coalesce(s.compute_ms, 0), coalesce(s.movegens, 0)) <> (coalesce(f.tasks, 0), coalesce(f.compute_ms, 0), coalesce(f.movegens, 0))"""
)
def reconcile_counters(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ops.reconcile_counters(stored(t), t.claims)


@query(
    f"""SELECT s.worker, s.is_anon, greatest(0, s.tasks - coalesce(e.tasks, 0)) AS tasks, greatest(0, s.compute_ms - coalesce(e.compute_ms, 0)) AS compute_ms, greatest(0, s.movegens - coalesce(e.movegens, 0)) AS movegens FROM {_STORED} s
    LEFT JOIN (SELECT worker, is_anon, count(*) AS tasks, CAST(sum(held_ms) AS BIGINT) AS compute_ms, CAST(sum(movegens) AS BIGINT) AS movegens FROM {DONE} WHERE job_id = 5 GROUP BY ALL) e ON e.worker = s.worker AND e.is_anon = s.is_anon"""
)
def give_back(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ops.give_back(stored(t), t.claims, 5)


_CENSUS = {"results": sql("results"), "claims": CLAIMS, "analyses": sql("analyses"), "audit": sql("audit")}


def tables_of(t: Tables):
    return {"results": t.results, "claims": t.claims, "analyses": t.analyses, "audit": t.audit}


@query(" UNION ALL ".join(f"SELECT '{k}' AS name, count(*) AS n FROM {v} WHERE job_id = 5" for k, v in _CENSUS.items()))
def census(spark, sf_dir):
    return ops.census(tables_of(Tables(spark, sf_dir)), 5)


@query("SELECT '{' || string_agg('\"' || name || '\":' || CAST(n AS VARCHAR), ',' ORDER BY name) || '}' AS row_counts, CAST(sum(n) AS BIGINT) AS total FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) AS n FROM {v}" for k, v in _CENSUS.items()) + ")")
def row_manifest(spark, sf_dir):
    return ops.manifest_total(ops.row_manifest(tables_of(Tables(spark, sf_dir))))


@query("SELECT coalesce(m.name, a.name) AS name, m.n AS recorded, a.n AS actual FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) + {int(k == 'claims')} AS n FROM {v}" for k, v in _CENSUS.items() if k != "audit") + ") m FULL JOIN (" + " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) AS n FROM {v}" for k, v in _CENSUS.items() if k != "results") + ") a ON a.name = m.name WHERE m.n IS DISTINCT FROM a.n")
def manifest_compare(spark, sf_dir):
    counts = ops.tagged_counts(tables_of(Tables(spark, sf_dir)))
    recorded = counts.filter("name <> 'audit'").select("name", (F.col("n") + (F.col("name") == "claims").cast("int")).alias("n"))
    return ops.manifest_compare(recorded, counts.filter("name <> 'results'"))


@query(f"SELECT 'claims' AS name, count(*) AS n FROM {CLAIMS} WHERE claimed_at > TIMESTAMP '2024-01-20' UNION ALL SELECT 'audit', count(*) FROM {sql('audit')} WHERE created_at > TIMESTAMP '2024-01-20' UNION ALL SELECT 'results', count(*) FROM {sql('results')} WHERE submitted_at > TIMESTAMP '2024-01-20'")
def created_since(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ops.created_since({"claims": (t.claims, "claimed_at"), "audit": (t.audit, "created_at"), "results": (t.results, "submitted_at")}, F.expr("TIMESTAMP '2024-01-20 00:00:00'"))


@query(f"SELECT audit_id, action, actor, target, (SELECT count(*) FROM {sql('audit')} WHERE action = 'job.view' AND job_id = 4) AS total FROM {sql('audit')} WHERE action = 'job.view' AND job_id = 4 ORDER BY created_at DESC, audit_id DESC LIMIT 25 OFFSET 5")
def audit_search(spark, sf_dir):
    return ops.audit_search(Tables(spark, sf_dir).audit, 25, 5, action="job.view", actor=None, job_id=4).select("audit_id", "action", "actor", "target", "total")


@query(f"SELECT audit_id, action, actor, target FROM {sql('audit')} WHERE action IN ('user.ban', 'job.delete') OR action LIKE '%.census' ORDER BY created_at DESC, audit_id DESC LIMIT 20")
def destructive_actions(spark, sf_dir):
    return ops.destructive_actions(Tables(spark, sf_dir).audit).select("audit_id", "action", "actor", "target")


@query(f"SELECT actor, action, count(*) AS n, count(DISTINCT (target, job_id)) AS subjects FROM {sql('audit')} GROUP BY ALL ORDER BY n DESC, actor, action LIMIT 40")
def busiest_actors(spark, sf_dir):
    return ops.busiest(Tables(spark, sf_dir).audit)


@query(f"SELECT target, arg_max(action, audit_id) AS action, arg_max(actor, audit_id) AS actor, count(*) AS actions FROM {sql('audit')} WHERE audit_id % 2 <> 0 AND audit_id % 5 <> 0 AND actor % 7 <> 0 GROUP BY target")
def replay_actions(spark, sf_dir):
    a = Tables(spark, sf_dir).audit
    return ops.replay_actions(a, a.filter("audit_id % 2 = 0"), a.filter("audit_id % 5 = 0"), a.filter("actor % 7 = 0").select("actor").distinct())


@query(f"SELECT claim_id, job_id, substring(sha256('salt' || CAST(worker AS VARCHAR)), 1, 12) AS worker, CAST(NULL AS VARCHAR) AS version FROM {CLAIMS}")
def anonymise(spark, sf_dir):
    return ops.anonymise(Tables(spark, sf_dir).claims, "salt")


@query(f"SELECT claim_id, job_id FROM {CLAIMS} WHERE job_id NOT IN (3, 8)")
def job_purge(spark, sf_dir):
    return ops.job_purge(Tables(spark, sf_dir).claims, [3, 8]).select("claim_id", "job_id")


# ---- boards

_SORTED = "array_to_string(list_sort(string_split(rack, '')), '')"


@query(f"SELECT id, {_SORTED} AS spelling, {_SORTED} = array_to_string(list_sort(string_split(upper(reverse(rack)), '')), '') AS same_seat FROM {sql('racks_text')}")
def rack_spelling(spark, sf_dir):
    racks = Tables(spark, sf_dir).racks_text
    return racks.select("id", boards.rack_spelling(F.col("rack")).alias("spelling"), (boards.rack_spelling(F.col("rack")) == boards.rack_spelling(F.reverse("rack"))).alias("same_seat"))


@query(f"SELECT id, letter, count(*) AS n FROM (SELECT id, unnest(string_split(rack, '')) AS letter FROM {sql('racks_text')}) GROUP BY ALL")
def rack_tiles(spark, sf_dir):
    return boards.rack_tiles(Tables(spark, sf_dir).racks_text)


_REST = "array_to_string(list_sort(string_split(substring(rack, 1, 1) || substring(rack, 5), '')), '')"


@query(f"SELECT id, {_REST} AS leave, substring(rack, 1, 1) AS first FROM {sql('racks_text')}")
def leave_of(spark, sf_dir):
    racks = Tables(spark, sf_dir).racks_text
    return racks.select("id", boards.leave_of(F.col("rack"), F.col("used")).alias("leave"), F.substring("rack", 1, 1).alias("first"))


@query(f"SELECT leave, count(*) AS plays, CAST(sum(equity_cents) AS BIGINT) AS equity_cents FROM (SELECT {_REST} AS leave, equity_cents FROM {sql('racks_text')} t JOIN {sql('deltas')} d ON d.rack = t.id) GROUP BY leave".replace("substring(rack", "substring(t.rack"))
def leave_values(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return boards.leave_values(t.deltas.select(F.col("rack").alias("id"), "equity_cents"), t.racks_text)


@query(
    """SELECT CAST(r AS INT) AS "row", CAST(p_partkey % 7 + i AS INT) AS col, count(*) AS n FROM (SELECT p_partkey, p_partkey % 15 AS r, least(length(replace(p_name, ' ', '')), 7) AS n FROM part), range(7) t(i) WHERE i < n GROUP BY ALL"""
)
def board_occupancy(spark, sf_dir):
    """Boards with one word each: the part's name in row id % 15 from column id % 7."""
    parts = Tables(spark, sf_dir).racks_text
    row, col = F.col("id") % 15, F.col("id") % 7
    line = F.concat(F.when(col > 0, col.cast("string")).otherwise(""), "rack", (15 - col - F.length("rack")).cast("string"))
    board = F.concat(F.repeat(F.lit("15/"), row.cast("int")), line, F.repeat(F.lit("/15"), (14 - row).cast("int")), F.lit(" AB/ 0/0"))
    return boards.occupancy(boards.board_squares(parts.select(F.col("id").alias("record_id"), board.alias("position"))))


@query("SELECT kind, direction, CAST(o_orderkey % 15 AS INT) AS \"row\", CAST(o_custkey % 15 AS INT) AS col, count(*) AS n FROM (SELECT *, 'place' AS kind, CASE o_orderkey % 2 WHEN 0 THEN 'across' ELSE 'down' END AS direction FROM orders) GROUP BY ALL")
def move_squares(spark, sf_dir):
    """Plays noted from orders, counted by where they start."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 15 + 1).cast("string").alias("r"), F.char(65 + F.col("o_custkey") % 15).alias("c"))
    moves = o.select(F.when(F.col("k") % 2 == 0, F.concat("r", "c", F.lit(".WORD"))).otherwise(F.concat("c", "r", F.lit(".WORD"))).alias("move"))
    return boards.explode_moves(moves).groupBy("kind", "direction", "row", "col").agg(F.count("*").alias("n"))


_SPELT_RACK, _SPELT_USED = ("array_to_string(string_split(" + c + ", ''), '+')" for c in ("rack", "used"))


@query(
    f"""SELECT id, readable, CASE WHEN readable THEN {_SPELT_RACK} END AS rack1, CASE WHEN readable THEN CASE WHEN id % 13 = 6 THEN 'NY+' ELSE '' END || {_SPELT_USED} END AS rack2,
    CASE WHEN readable THEN CAST(id % 500 - 20 AS INT) END AS score1, CASE WHEN readable THEN CAST(id % 300 AS INT) END AS score2, CASE WHEN readable THEN CAST(id % 4 AS INT) END AS zeros
    FROM (SELECT *, id % 13 NOT BETWEEN 1 AND 5 AS readable FROM {sql("racks_text")})"""
)
def position_fields(spark, sf_dir):
    """Positions of one word each; the stand-in leaves out the turns, spoils a score, leaves out a rack, adds a row, opens a bracket."""
    rows = Tables(spark, sf_dir).racks_text
    fault = lambda k, bad, good: F.when(F.col("id") % 13 == k, bad).otherwise(good)
    row = F.concat("rack", (15 - F.length("rack")).cast("string"))
    board = F.concat(row, F.repeat(F.lit("/15"), 14), fault(4, F.lit("/15"), F.lit("")))
    second = fault(6, F.concat(F.lit("[NY]"), "used"), fault(5, F.concat(F.lit("["), "used"), F.col("used")))
    racks = F.concat("rack", fault(3, F.lit(""), F.concat(F.lit("/"), second)))
    scores = F.concat((F.col("id") % 500 - 20).cast("string"), F.lit("/"), fault(2, F.lit("x"), (F.col("id") % 300).cast("string")))
    text = F.concat_ws(" ", board, racks, scores, fault(1, F.lit(None), F.concat((F.col("id") % 4).cast("string"), F.lit(" lex X;"))))
    read = boards.position_fields(rows.select("id", text.alias("position")))
    return read.select("id", "readable", *(F.array_join(c, "+").alias(c) for c in ("rack1", "rack2")), "score1", "score2", "zeros")


def noted(t: Tables):
    """Moves noted from racks: across, down, exchanges, passes and two that can't be read."""
    n, c = (F.col("id") % 15 + 1).cast("string"), F.char(65 + F.col("id") % 15)
    first, rest = F.substring("rack", 1, 1), F.expr("substring(rack, 2)")
    move = (
        F.when(F.col("id") % 5 == 0, F.concat(n, c, F.lit(" ("), first, F.lit(")"), rest))
        .when(F.col("id") % 5 == 1, F.concat(c, n, F.lit(" "), first, F.lit("."), F.lower(rest)))
        .when(F.col("id") % 5 == 2, F.concat(F.lit("(exch "), "rack", F.lit(")")))
        .when(F.col("id") % 5 == 3, F.lit("pass"))
        .otherwise(F.when(F.col("id") % 2 == 0, F.concat(F.lit("0A "), "rack")).otherwise(F.concat(F.lit("8H ("), "rack")))
    )
    return t.racks_text.select("id", move.alias("move"))


@query(
    f"""SELECT kind, direction, count(*) AS n, CAST(sum(CASE kind WHEN 'exchange' THEN length(rack) END) AS BIGINT) AS tiles, CAST(sum(CASE direction WHEN 'across' THEN length(rack) WHEN 'down' THEN length(rack) + 1 END) AS BIGINT) AS squares FROM
    (SELECT *, CASE id % 5 WHEN 0 THEN 'play' WHEN 1 THEN 'play' WHEN 2 THEN 'exchange' WHEN 3 THEN 'pass' END AS kind, CASE id % 5 WHEN 0 THEN 'across' WHEN 1 THEN 'down' END AS direction FROM {sql("racks_text")}) GROUP BY kind, direction"""
)
def move_kinds(spark, sf_dir):
    sizes = [F.sum(F.when(F.col(c).isNotNull(), F.size(c))).alias(c) for c in ("tiles", "squares")]
    return boards.parse_moves(noted(Tables(spark, sf_dir))).groupBy("kind", "direction").agg(F.count("*").alias("n"), *sizes)


@query(
    f"""SELECT direction, "row", col, letter, count(*) AS n FROM (
    SELECT 'across' AS direction, CAST(id % 15 AS INT) AS "row", CAST(id % 15 + i AS INT) AS col, substring(rack, CAST(i + 1 AS INT), 1) AS letter FROM {sql("racks_text")}, range(1, 8) t(i) WHERE id % 5 = 0 AND i < length(rack)
    UNION ALL SELECT 'down', CAST(id % 15 + i AS INT), CAST(id % 15 AS INT), CASE WHEN i = 0 THEN substring(rack, 1, 1) ELSE lower(substring(rack, CAST(i AS INT), 1)) END FROM {sql("racks_text")}, range(9) t(i) WHERE id % 5 = 1 AND i <> 1 AND i <= length(rack)
    ) GROUP BY ALL"""
)
def play_squares(spark, sf_dir):
    """How often plays put each tile on each square."""
    squares = boards.placed_squares(boards.parse_moves(noted(Tables(spark, sf_dir))))
    return squares.groupBy("direction", "row", "col", "letter").agg(F.count("*").alias("n"))


# ---- nested exports, cursors, reissues and job counters

_FRESH = f"(SELECT audit_id, action, actor * 1000 + audit_id % 100 AS target FROM {sql('audit')})"


@query(
    f"""SELECT u.target, coalesce(a.now, u.target % 2 = 0) AS banned FROM (SELECT DISTINCT target FROM {_FRESH}) u LEFT JOIN
    (SELECT target, arg_max(action = 'user.ban', audit_id) FILTER (action IN ('user.ban', 'user.census')) AS now, bool_or(action = 'job.delete') AS gone FROM {_FRESH} GROUP BY target) a ON a.target = u.target
    WHERE NOT coalesce(a.gone, FALSE)"""
)
def apply_actions(spark, sf_dir):
    """Identities (a hundred of each actor) as a dimension, after all actions on them. A census stands for lifting a ban, a deleted job for a deletion."""
    fresh = Tables(spark, sf_dir).audit.select("audit_id", "action", (F.col("actor") * 1000 + F.col("audit_id") % 100).alias("target"))
    users = fresh.select("target").distinct().withColumn("banned", F.col("target") % 2 == 0)
    return ops.apply_actions(users, fresh, ["user.ban"], ["user.census"], ["job.delete"])


_TASK_FACTS = f"(SELECT task_id, accepted, open, CASE WHEN accepted > 0 THEN 'completed' WHEN open > 0 THEN 'in_progress' ELSE 'pending' END AS state FROM {_TASKS})"


@query(
    f"""SELECT f.task_id, s.accepted, s.open, s.state, f.accepted AS fact_accepted, f.open AS fact_open, f.state AS fact_state FROM {_TASK_FACTS} f
    LEFT JOIN (SELECT task_id, accepted + CAST(task_id % 7 = 1 AS INT) AS accepted, open, CASE WHEN task_id % 9 = 2 THEN 'pending' ELSE state END AS state FROM {_TASK_FACTS} WHERE task_id % 11 <> 3) s ON s.task_id = f.task_id
    WHERE s.task_id IS NULL OR (s.accepted, s.open, s.state) <> (f.accepted, f.open, f.state)"""
)
def reconcile_tasks(spark, sf_dir):
    """The stored side lacks some tasks, counts one too many for others, and holds a state that has passed for others."""
    claims = Tables(spark, sf_dir).claims
    held = jobs.task_states(claims).filter("task_id % 11 <> 3")
    state = F.when(F.col("task_id") % 9 == 2, "pending").otherwise(F.col("state"))
    held = held.select("task_id", (F.col("accepted") + (F.col("task_id") % 7 == 1).cast("int")).alias("accepted"), "open", state.alias("state"))
    return ops.reconcile_tasks(held, claims)


_SECRET = "substring(sha256('salt' || CAST({} AS VARCHAR)), 1, 12)"


@query(
    f"""SELECT 'claims' AS name, claim_id AS id, {_SECRET.format("worker")} AS who, CAST(NULL AS VARCHAR) AS reason FROM {CLAIMS}
    UNION ALL SELECT 'audit', audit_id, {_SECRET.format("actor")}, CASE WHEN action = 'user.ban' THEN '[scrubbed]' END FROM {sql("audit")}"""
)
def anonymised_tables(spark, sf_dir):
    """Claims and the audit log rewritten with one salt, and read again."""
    t, folder = Tables(spark, sf_dir), scratch(spark, "anonymised")
    reasons = F.when(F.col("action") == "user.ban", F.concat(F.lit("user "), F.col("target").cast("string")))
    ops.anonymised(t.claims, "salt", ["worker"], dropped=["version"]).write.parquet(f"{folder}/claims")
    ops.anonymised(t.audit.withColumn("reason", reasons), "salt", ["actor"], ["reason"]).write.parquet(f"{folder}/audit")
    claims = spark.read.parquet(f"{folder}/claims").select(F.lit("claims").alias("name"), F.col("claim_id").alias("id"), F.col("worker").alias("who"), F.lit(None).cast("string").alias("reason"))
    return claims.unionByName(spark.read.parquet(f"{folder}/audit").select(F.lit("audit").alias("name"), F.col("audit_id").alias("id"), F.col("actor").alias("who"), "reason"))


_PLIES = f"(SELECT record_id, rank, ply, 'R' || CAST((record_id + rank * ply) % 5 AS VARCHAR) AS play FROM {MOVES}, range(0, 4) p(ply) WHERE rank <> 2)"
_SPELT = f"(SELECT record_id, rank, string_agg(play, '+' ORDER BY ply) AS plies FROM {_PLIES} WHERE ply < 3 GROUP BY ALL)"


@query(
    f"""SELECT m.record_id, string_agg(m.move || ':' || coalesce(p.plies, ''), ',' ORDER BY m.rank) AS moves FROM {MOVES} m
    LEFT JOIN {_SPELT} p ON p.record_id = m.record_id AND p.rank = m.rank WHERE m.rank <= 3 GROUP BY m.record_id"""
)
def export_plies(spark, sf_dir):
    """Records with moves that hold plies; the stand-in gives the second move none."""
    moves = Tables(spark, sf_dir).moves
    plies = moves.filter("rank <> 2").select("record_id", "rank", "score", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("ply"))
    plies = plies.withColumn("play", F.concat(F.lit("R"), ((F.col("record_id") + F.col("rank") * F.col("ply")) % 5).cast("string")))
    spelt = lambda m: F.concat(m["move"], F.lit(":"), F.array_join(F.transform(m["plies"], lambda p: p["play"]), "+"))
    return feeds.nested_moves(moves, plies, 3, 3).select("record_id", F.array_join(F.transform("moves", spelt), ",").alias("moves"))


@query(f"SELECT claim_id, CASE WHEN claim_id % 7 <> 0 AND claim_id % 11 <> 0 THEN epoch_us(claimed_at) END AS back_us FROM {CLAIMS}")
def cursor_round_trip(spark, sf_dir):
    """Cursors of claims and back; the stand-in spoils some with a sign and some with a letter."""
    text = feeds.cursor_text(F.col("claimed_at"))
    spoilt = F.when(F.col("claim_id") % 7 == 0, F.concat(F.lit("-"), text)).when(F.col("claim_id") % 11 == 0, F.concat(text, F.lit("x"))).otherwise(text)
    return Tables(spark, sf_dir).claims.select("claim_id", F.unix_micros(feeds.cursor_time(spoilt)).alias("back_us"))


@query(f"SELECT record_id AS id, 'not_a_candidate' AS rule FROM {MOVES} m WHERE rank = 1 AND NOT EXISTS (SELECT 1 FROM {MOVES} s WHERE s.record_id = m.record_id AND s.rank > 1 AND s.move = m.move)")
def validate_reissues(spark, sf_dir):
    """The first move of each record as the answer, the others as what was sent."""
    moves = Tables(spark, sf_dir).moves.withColumnRenamed("record_id", "id")
    return quality.validate_reissues(moves.filter("rank = 1").select("id", "move"), moves.filter("rank > 1"))


_JOB_FACTS = f"(SELECT coalesce(d.job_id, r.job_id) AS job_id, coalesce(tasks, 0) AS tasks, coalesce(games, 0) AS games FROM (SELECT job_id, count(*) AS tasks FROM {DONE} GROUP BY ALL) d FULL JOIN (SELECT job_id, CAST(sum(games) AS BIGINT) AS games FROM {sql('results')} GROUP BY ALL) r ON r.job_id = d.job_id)"
_JOB_STORED = f"(SELECT job_id, tasks + CAST(job_id % 6 = 0 AS INT) AS tasks, games + CAST(job_id % 10 = 1 AS INT) AS games FROM {_JOB_FACTS} WHERE job_id % 13 <> 2)"


@query(
    f"""SELECT f.job_id, coalesce(s.tasks, 0) AS tasks, coalesce(s.games, 0) AS games, f.tasks AS fact_tasks, f.games AS fact_games FROM {_JOB_FACTS} f
    LEFT JOIN {_JOB_STORED} s ON s.job_id = f.job_id WHERE (coalesce(s.tasks, 0), coalesce(s.games, 0)) <> (f.tasks, f.games)"""
)
def reconcile_jobs(spark, sf_dir):
    """The stored side lacks some jobs, and is one off for others."""
    t = Tables(spark, sf_dir)
    done = t.claims.filter("state = 'completed'").groupBy("job_id").agg(F.count("*").alias("tasks"))
    held = done.join(t.results.groupBy("job_id").agg(F.sum("games").alias("games")), "job_id", "full").fillna(0).filter("job_id % 13 <> 2")
    held = held.select("job_id", (F.col("tasks") + (F.col("job_id") % 6 == 0).cast("int")).alias("tasks"), (F.col("games") + (F.col("job_id") % 10 == 1).cast("int")).alias("games"))
    return ops.reconcile_jobs(held, t.claims, t.results)


@query(f"SELECT job_id, count(*) FILTER ((skip_bits & ~(job_id % 4 + 1)) = 0) AS within, count(*) FILTER ((skip_bits & ~(job_id % 4 + 1)) <> 0) AS beyond FROM {CLAIMS} GROUP BY job_id")
def skips_allowed(spark, sf_dir):
    t = Tables(spark, sf_dir)
    roles = lambda bits: F.array_compact(F.array(*(F.when(bits.bitwiseAND(1 << i) != 0, F.lit(r)) for i, r in enumerate(("wmp", "wit", "rit")))))
    allowed = t.jobs.select("job_id", roles(F.col("job_id") % 4 + 1).alias("allowed"))
    return inputs.skips_allowed(t.claims.select("job_id", roles(F.col("skip_bits")).alias("roles")), allowed)


@query(f"SELECT worker, string_agg(DISTINCT version, ' vs ' ORDER BY version) AS versus FROM {CLAIMS} GROUP BY worker")
def versions_versus(spark, sf_dir):
    return inputs.versus(Tables(spark, sf_dir).claims, "worker", "version")


# ---- sinks and messages


@query(f"SELECT CAST(rack AS VARCHAR) AS rack, CAST(n AS VARCHAR) AS n, CAST(equity_cents // 100 AS VARCHAR) || '.' || lpad(CAST(equity_cents % 100 AS VARCHAR), 2, '0') || '00000000' AS equity_sum FROM {MERGED} WHERE generation = 2")
def generation_csv(spark, sf_dir):
    """A generation through the CSV sink, and read again."""
    path = scratch(spark, "generation")
    coverage.write_generation(coverage.generation_table(Tables(spark, sf_dir).merged, 2), path)
    return spark.read.schema("rack string, n string, equity_sum string").csv(path)


@query(f"SELECT job_id, count(*) AS messages, CAST(sum(games) AS BIGINT) AS games, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in PENT)}, count(*) FILTER (wins + losses + ties <> games) AS broken FROM {sql('results_faulty')} GROUP BY job_id")
def result_messages(spark, sf_dir):
    """Faulty results as JSON messages, parsed, flattened and validated."""
    rows = Tables(spark, sf_dir).results_faulty
    games = F.struct(*(F.col(c).cast("int").alias(c) for c in ("games", "wins", "losses", "ties")), "p1_score_mean", "p2_score_mean")
    text = F.to_json(F.struct(F.concat_ws(":", "job_id", "result_id").alias("claim_token"), F.struct(games.alias("all_games"), F.array(*(F.col(c).cast("long") for c in PENT)).alias("pentanomial")).alias("result")))
    flat = messages.tallies(rows.select(messages.parsed(text, "games").alias("m")).select("m.*"))
    job = F.element_at(F.split("claim_token", ":"), 1).cast("long")
    broken = F.count_if(F.col("wins") + F.col("losses") + F.col("ties") != F.col("games"))
    return flat.groupBy(job.alias("job_id")).agg(F.count("*").alias("messages"), F.sum("games").alias("games"), *(F.sum(c).alias(c) for c in PENT), broken.alias("broken"))


@query(
    f"""SELECT pool, config, low, high, round(min(low) OVER p - greatest(10, 0.08 * (max(high) OVER p - min(low) OVER p)), 6) AS axis_low, round(max(high) OVER p + greatest(10, 0.08 * (max(high) OVER p - min(low) OVER p)), 6) AS axis_high FROM
    (SELECT pool, run_id AS config, round(rating - least(1.96 * (run_id % 300), 400), 6) AS low, round(rating + least(1.96 * (run_id % 300), 400), 6) AS high FROM {sql("runs")}) WINDOW p AS (PARTITION BY pool)"""
)
def rating_bounds(spark, sf_dir):
    runs = Tables(spark, sf_dir).runs.select("pool", F.col("run_id").alias("config"), "rating", (F.col("run_id") % 300).cast("double").alias("stderr"))
    return rounded(ratings.rating_bounds(runs), "low", "high", "axis_low", "axis_high")


@query(f"SELECT pool, run_id AS config, rating, row_number() OVER (PARTITION BY pool ORDER BY rating DESC, run_id) AS place FROM {sql('runs')} WHERE run_id % 3 <> 0 QUALIFY place <= 6")
def top_members(spark, sf_dir):
    rated = Tables(spark, sf_dir).runs.select("pool", F.col("run_id").alias("config"), "rating", (F.col("run_id") % 3 != 0).alias("connected"))
    return ratings.top_members(rated).select("pool", "config", "rating", F.col("place").cast("long").alias("place"))
