"""Validators over stand-ins with faults of every kind, and all of them as one registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage, quality
from ..sources.standins import sql
from .catalogue import ORACLES, QUERIES, Tables, query

_ARRAY = "array<bigint>"


def told(key: str, rows: str, rules: dict[str, str]) -> str:
    """(key, rule) of every rule's condition over rows, in SQL."""
    return " UNION ALL ".join(f"SELECT {key}, '{name}' AS rule FROM {rows} WHERE {condition}" for name, condition in rules.items())


def faulty(t: Tables, table: str, *keys: str, **columns: str):
    return getattr(t, table).selectExpr(*keys, *(f"{v} AS {k}" for k, v in columns.items()))


def in_sql(table: str, *keys: str, **columns: str) -> str:
    return f"(SELECT {', '.join([*keys, *(f'{v} AS {k}' for k, v in columns.items())])} FROM {sql(table)})"


# ---- analyses: kinds and settings

_KINDS = {
    "analysis": "CASE record_id % 5 WHEN 0 THEN 'static' WHEN 1 THEN 'sim' WHEN 2 THEN 'peg' WHEN 3 THEN 'endgame' ELSE 'odd' END",
    "win_percentage": "CASE WHEN record_id % 3 < 2 THEN CAST(50 AS DOUBLE) END",
    "blended_utility": "CASE WHEN record_id % 4 < 2 THEN CAST(0.5 AS DOUBLE) END",
    "iterations": "CASE WHEN record_id % 7 < 4 THEN 100 END",
}
_carried = {"win_percentage": "('sim', 'peg')", "blended_utility": "('sim', 'peg')", "iterations": "('sim')"}


@query(told("record_id", in_sql("positions", "record_id", **_KINDS), {"unknown_kind": "analysis = 'odd'"} | {f"{k}_carried": f"analysis <> 'odd' AND ({k} IS NOT NULL) <> (analysis IN {v})" for k, v in _carried.items()}))
def validate_kinds(spark, sf_dir):
    return quality.validate_kinds(faulty(Tables(spark, sf_dir), "positions", "record_id", **_KINDS))


_SETTINGS = {"analysis": _KINDS["analysis"], "config": "record_id % 6", "has_inference": "record_id % 4 = 0", "plies": "record_id % 8"}


@query(
    told(
        "record_id",
        in_sql("positions", "record_id", **_SETTINGS),
        {
            "unknown_player": "config = 5",
            "cannot_simulate": "config < 5 AND analysis = 'sim' AND config % 2 = 1",
            "cannot_solve": "config < 5 AND analysis = 'endgame' AND config % 3 <> 0",
            "cannot_infer": "config = 1 AND has_inference",
            "too_deep": "config < 5 AND plies > 2 + config",
        },
    )
)
def validate_settings(spark, sf_dir):
    configs = spark.range(5).select(F.col("id").alias("config"), (F.col("id") % 2 == 0).alias("can_simulate"), (F.col("id") % 3 == 0).alias("can_solve"), (F.col("id") != 1).alias("can_infer"), (2 + F.col("id")).alias("max_plies"))
    return quality.validate_settings(faulty(Tables(spark, sf_dir), "positions", "record_id", **_SETTINGS), configs)


# ---- nested: inferences and plies

#: Up to twelve leaves; every fifth record has them the wrong way round, some have a full rack or a broken one.
_DRAWS, _LEAF = "CASE WHEN record_id % 5 = 0 THEN i ELSE 20 - i END", "CASE WHEN record_id % 11 = 0 AND i = 0 THEN 'ABCDEFG' WHEN record_id % 17 = 0 AND i = 1 THEN '[AB' ELSE 'A[QU]B' END"
_INFERENCES = f"(SELECT record_id, 60 + record_id % 100 AS total_draws, [{_DRAWS} for i in range(record_id % 13)] AS draws, [{_LEAF} for i in range(record_id % 13)] AS leaves FROM {sql('positions')})"
_TILE = r"\[[^\[\]]{1,8}\]|[^\[\]]"


@query(
    told(
        "record_id",
        _INFERENCES,
        {
            "too_many": "len(leaves) > 10",
            "not_sorted": "draws <> list_reverse_sort(draws)",
            "above_total": "coalesce(list_sum(draws), 0) > total_draws",
            "tiles": f"len([x for x in leaves if array_to_string(regexp_extract_all(x, '{_TILE}'), '') <> x OR len(regexp_extract_all(x, '{_TILE}')) >= 7]) > 0",
        },
    )
)
def validate_inference(spark, sf_dir):
    rows = Tables(spark, sf_dir).positions
    number = F.filter(F.lit(list(range(13))).cast(_ARRAY), lambda i: i < F.col("record_id") % 13)
    draws = lambda i: F.when(F.col("record_id") % 5 == 0, i).otherwise(20 - i)
    leaf = lambda i: F.when((F.col("record_id") % 11 == 0) & (i == 0), "ABCDEFG").when((F.col("record_id") % 17 == 0) & (i == 1), "[AB").otherwise("A[QU]B")
    return quality.validate_inference(rows.select("record_id", (60 + F.col("record_id") % 100).alias("total_draws"), F.transform(number, lambda i: F.struct(leaf(i).alias("leave"), draws(i).alias("draws"))).alias("leaves")))


_PLY = {"ply": "i - CASE WHEN record_id % 9 = 0 AND i = 2 THEN 2 WHEN record_id % 10 = 0 THEN 1 ELSE 0 END", "bingo": "10 * i + CASE WHEN record_id % 13 = 0 THEN 95 ELSE 0 END", "score": "50 * i + CASE WHEN record_id % 19 = 0 THEN 100000 ELSE 0 END"}
_PLY_LISTS = f"(SELECT record_id, {', '.join(f'[{v} for i in range(record_id % 5)] AS {k}' for k, v in _PLY.items())} FROM {sql('positions')})"


@query(
    told(
        "record_id AS move_id",
        _PLY_LISTS,
        {"ply_order": "ply <> list_sort(list_distinct(ply)) OR ply[1] < 0", "bingo_range": "len([x for x in bingo if x NOT BETWEEN 0 AND 100]) > 0", "score_range": "len([x for x in score if x NOT BETWEEN -100000 AND 100000]) > 0"},
    )
)
def validate_plies(spark, sf_dir):
    record = F.col("record_id")
    number = F.filter(F.lit([0, 1, 2, 3]).cast(_ARRAY), lambda i: i < record % 5)
    ply = lambda i: i - F.when((record % 9 == 0) & (i == 2), 2).when(record % 10 == 0, 1).otherwise(0)
    one = lambda i: F.struct(ply(i).alias("ply"), (10 * i + F.when(record % 13 == 0, 95).otherwise(0)).cast("double").alias("bingo_percentage"), (50 * i + F.when(record % 19 == 0, 100_000).otherwise(0)).cast("double").alias("average_score"))
    return quality.validate_plies(Tables(spark, sf_dir).positions.select(record.alias("move_id"), F.transform(number, one).alias("plies")))


# ---- occurrences, staging, distributions

_OCCURRED = {
    "batch": "task",
    "rack": "CASE record_id % 4 WHEN 0 THEN 'AAAAAAA' WHEN 1 THEN 'AAAAAAB' WHEN 2 THEN 'ABC' ELSE '[QU]AAAAAA' END",
    "count": "record_id % 400",
    "mean": "CAST((record_id % 97 - 48) * 110 AS DOUBLE)",
}


@query(
    told(
        "id",
        f"(SELECT CAST(batch AS VARCHAR) || ':' || rack AS id, *, count(*) OVER (PARTITION BY batch, rack) AS same, sum(count) OVER (PARTITION BY batch) AS total FROM {in_sql('positions', **_OCCURRED)})",
        {"tiles": "rack = 'ABC'", "count": "count < 1", "mean": "abs(mean) > 5000", "repeated": "same > 1", "total": "total > 1000"},
    )
)
def validate_occurrences(spark, sf_dir):
    return quality.validate_occurrences(faulty(Tables(spark, sf_dir), "positions", **_OCCURRED), 1)


@query(f"SELECT submission, 'array_lengths' AS rule FROM (SELECT generation, submission, count(*) AS n FROM {sql('deltas')} GROUP BY ALL) WHERE (submission % 13 = 0) <> (submission % 17 = 0) AND n > 0")
def validate_staging(spark, sf_dir):
    """Staged arrays, of which some lack the last count and some the last sum; where both do, keys are one too many."""
    staged = coverage.stage(Tables(spark, sf_dir).deltas)
    short = lambda name, k: F.when(F.col("submission") % k == 0, F.slice(name, 1, F.size(name) - 1)).otherwise(F.col(name))
    return quality.validate_staging(staged.select("submission", F.when((F.col("submission") % 13 == 0) & (F.col("submission") % 17 == 0), F.slice("rack", 1, F.size("rack") - 1)).otherwise(F.col("rack")).alias("rack"), short("n", 13).alias("n"), short("equity_cents", 17).alias("equity_cents")))


_LETTERS = {"file": "p_partkey % 30", "letter": "substring(p_name, 1, 3)", "count": "p_size * 6", "score": "p_size % 11", "is_vowel": "p_partkey % 3", "columns": "4 + p_partkey % 4"}


@query(
    told(
        "id",
        f"(SELECT CAST(file AS VARCHAR) || ':' || letter AS id, *, count(*) OVER (PARTITION BY file, letter) AS same, count(*) OVER (PARTITION BY file) AS letters FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in _LETTERS.items())} FROM part))",
        {"count": "count NOT BETWEEN 0 AND 255", "vowel": "is_vowel NOT IN (0, 1)", "letters": "letters > 50", "repeated": "same > 1", "columns": "columns NOT IN (5, 7)"},
    )
)
def validate_distributions(spark, sf_dir):
    """Parts as the lines of thirty files of letters."""
    return quality.validate_distribution(spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(*(f"{v} AS {k}" for k, v in _LETTERS.items())))


# ---- pairs

_BOARD = "'b' || CAST(CASE WHEN record_id % 23 = 0 THEN 1 ELSE 0 END AS VARCHAR(9)) || ' AB/C 0/0'"


@query(
    f"""WITH k AS (SELECT task, count(*) AS kept, count(*) FILTER (b0 <> b1) AS unlike FROM (SELECT task, game_index // 2 AS pair, min(CASE WHEN record_id % 23 = 0 THEN 1 ELSE 0 END) AS b0, max(CASE WHEN record_id % 23 = 0 THEN 1 ELSE 0 END) AS b1 FROM {sql('positions')} WHERE record_id % 29 > 3 GROUP BY ALL) GROUP BY task),
    b AS (SELECT DISTINCT task, 2 + CASE WHEN task % 5 = 0 THEN 1 ELSE 0 END AS pairs FROM {sql('positions')}), r AS (SELECT b.task, pairs, coalesce(kept, 0) AS kept, coalesce(unlike, 0) AS unlike FROM b LEFT JOIN k ON k.task = b.task)
    SELECT task, 'divergent_count' AS rule FROM r WHERE kept <> pairs UNION ALL SELECT task, 'boards_differ' FROM r WHERE unlike > 0"""
)
def validate_boards(spark, sf_dir):
    """Batches of two pairs, some of which say three; some positions are missing, and some show another board."""
    rows = Tables(spark, sf_dir).positions
    batches = rows.select("task").distinct().withColumn("pairs", 2 + F.when(F.col("task") % 5 == 0, 1).otherwise(0))
    return quality.validate_boards(rows.filter("record_id % 29 > 3").withColumn("position", F.expr(_BOARD)), batches)


_MODELS = "CASE {0} % 4 WHEN 0 THEN NULL WHEN 3 THEN 'new' ELSE 'old' END"


@query(f"SELECT job_id, 'win_models_differ' AS rule FROM (SELECT job_id, job_id % 9 AS p1, (job_id * 5 + 3) % 9 AS p2 FROM {sql('jobs')}) WHERE p1 <> p2 AND {_MODELS.format('p1')} <> {_MODELS.format('p2')}")
def validate_pairings(spark, sf_dir):
    """Players with an old model, a new one or none."""
    t = Tables(spark, sf_dir)
    configs = spark.range(9).select(F.col("id").alias("config"), F.expr(_MODELS.format("id")).alias("model"))
    return quality.validate_pairings(t.jobs.select("job_id", (F.col("job_id") % 9).alias("p1"), ((F.col("job_id") * 5 + 3) % 9).alias("p2")), configs)


# ---- the registry

#: Validators by name: their keys are the first column of what they tell.
_ALL = [k for k in QUERIES if k.startswith("validate_")]


_REGISTRY = " UNION ALL ".join(f"SELECT '{k}' AS \"table\", * FROM (SELECT CAST(key AS VARCHAR) AS key, rule FROM ({ORACLES[k]}) AS v(key, rule))" for k in _ALL)


@query(f"SELECT \"table\", key, rule FROM ({_REGISTRY})")
def violation_registry(spark, sf_dir):
    """What all validators find, in one table."""
    return quality.registered({k: QUERIES[k](spark, sf_dir) for k in _ALL})


@query(f"SELECT \"table\", rule, count(*) AS n, count(DISTINCT key) AS keys FROM ({_REGISTRY}) GROUP BY ALL")
def violation_counts(spark, sf_dir):
    """How often each rule of each table fires."""
    rows = quality.registered({k: QUERIES[k](spark, sf_dir) for k in _ALL})
    return rows.groupBy("table", "rule").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


@query(f"SELECT p.record_id, coalesce(rules, '') AS rules FROM {sql('positions')} p LEFT JOIN (SELECT key, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM ({_REGISTRY}) WHERE \"table\" = 'validate_settings' GROUP BY key) v ON v.key = CAST(p.record_id AS VARCHAR)")
def quarantine_positions(spark, sf_dir):
    """Positions with the rules of their settings that they break, by the registry; clean ones have none."""
    t = Tables(spark, sf_dir)
    registry = quality.registered({"validate_settings": validate_settings(spark, sf_dir)})
    return quality.split(t.positions.select("record_id"), F.col("record_id"), "validate_settings", registry).select("record_id", F.array_join("rules", ",").alias("rules"))
