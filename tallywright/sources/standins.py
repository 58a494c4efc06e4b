"""Result tables derived from the driver's tables by expressions that Spark and DuckDB both read.

A table is a base table and levels of expressions, each over the level before. Integer arithmetic only; money enters once
as rounded hundredths. `sql(name)` is the same table as a DuckDB subquery, for oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "TIMESTAMP '2024-01-30 23:00:00'"

_PENT = [f"(o_orderkey * {k} + o_custkey * {c}) % 4 AS pent_{i}" for i, (k, c) in enumerate(((3, 1), (5, 1), (7, 1), (9, 1), (11, 1)))]
_TALLY = [
    "*",
    "2 * (pent_0 + pent_1 + pent_2 + pent_3 + pent_4) AS games",
    "pent_2 + pent_3 + 2 * pent_4 AS wins",
    "pent_1 + pent_3 AS ties",
    "2 * pent_0 + pent_1 + pent_2 AS losses",
    "CASE WHEN pent_2 >= 2 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS identical",
    "job_id % 9 AS p1",
    "(job_id * 5 + 3) % 9 AS p2",
    "CAST(380 + result_id % 100 AS DOUBLE) AS p1_score_mean",
    "CAST(380 + cust % 90 AS DOUBLE) AS p2_score_mean",
]
_DIVERGENT = ["*", "games - 2 * identical AS divergent_games", "wins - identical AS divergent_wins", "losses - identical AS divergent_losses", "ties AS divergent_ties"]
_RESULT = ["o_orderkey AS result_id", "o_custkey % 40 AS job_id", "o_custkey AS cust", "CAST(o_orderdate AS TIMESTAMP) AS submitted_at"]

#: name -> (base table, distinct, levels)
TABLES: dict[str, tuple[str, bool, list[list[str]]]] = {
    "results": ("orders", False, [[*_RESULT, *_PENT], _TALLY, _DIVERGENT]),
    "results_skewed": (
        "orders",
        False,
        [[*_RESULT, *_PENT[:4], "(o_orderkey * 11 + o_custkey) % 4 + (o_custkey % 40) % 3 AS pent_4"], _TALLY, _DIVERGENT],
    ),
    # one rule in a hundred is broken: rule k where the id leaves k
    "results_faulty": (
        "orders",
        False,
        [
            [*_RESULT, *_PENT],
            _TALLY,
            _DIVERGENT,
            [
                "result_id", "job_id", "submitted_at", "identical", "pent_1", "pent_2", "pent_3", "divergent_ties", "divergent_losses",
                "CASE WHEN result_id % 97 = 1 THEN -1 ELSE pent_0 END AS pent_0", "CASE WHEN result_id % 97 = 2 THEN pent_4 + 1 ELSE pent_4 END AS pent_4",
                "CASE WHEN result_id % 97 = 3 THEN games + 1 ELSE games END AS games", "CASE WHEN result_id % 97 = 4 THEN wins + 1 ELSE wins END AS wins",
                "CASE WHEN result_id % 97 = 5 THEN -ties - 1 ELSE ties END AS ties", "losses",
                "CASE WHEN result_id % 97 = 6 THEN CAST(-200 AS DOUBLE) WHEN result_id % 97 = 7 THEN CAST(4000 AS DOUBLE) ELSE p1_score_mean END AS p1_score_mean", "p2_score_mean",
                "CASE WHEN result_id % 97 = 8 THEN games + 2 ELSE divergent_games END AS divergent_games",
                "CASE WHEN result_id % 97 = 9 THEN divergent_wins - 1 ELSE divergent_wins END AS divergent_wins",
            ],
        ],
    ),
    "jobs": (
        "orders",
        True,
        [
            ["o_custkey % 40 AS job_id"],
            [
                "job_id",
                "CASE job_id % 8 WHEN 0 THEN 'games' WHEN 4 THEN 'opening_rack' WHEN 6 THEN 'leave_gen' WHEN 7 THEN 'games' ELSE 'game_pairs' END AS job_type",
                "CASE job_id % 5 WHEN 2 THEN 'paused' WHEN 3 THEN 'completed' ELSE 'active' END AS status",
                "CAST(100 AS BIGINT) AS min_units", "CAST(2000 AS BIGINT) AS max_units", "CAST(95 AS DOUBLE) AS confidence_pct", "1 + job_id % 7 AS allocation",
                "job_id % 2 AS variant", "CASE WHEN job_id % 11 = 5 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS letterdist", "CASE WHEN job_id % 13 = 6 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS layout", "CASE WHEN job_id % 6 = 0 THEN 'Job ' || CAST(job_id AS VARCHAR(20)) END AS title",
                "'P' || CAST(job_id % 9 AS VARCHAR(20)) AS p1_name", "'P' || CAST((job_id * 5 + 3) % 9 AS VARCHAR(20)) AS p2_name", "(job_id * 13) % 11 AS baseline",
            ],
        ],
    ),
    "claims": (
        "events",
        False,
        [
            ["event_id AS claim_id", "user_id AS worker", "user_id % 3 = 0 AS is_anon", "event_id % 40 AS job_id", "CAST(ts AS TIMESTAMP) AS claimed_at", "event_type", "CAST(round(value * 100) AS BIGINT) AS cents"],
            [
                "claim_id", "worker", "is_anon", "job_id", "claimed_at",
                "CASE event_type WHEN 'purchase' THEN 'claimed' WHEN 'error' THEN 'abandoned' WHEN 'signup' THEN 'declined' ELSE 'completed' END AS state",
                "cents * 10 AS held_ms", "cents * 17 AS movegens", "'0.1.' || CAST(2 + claim_id % 3 AS VARCHAR(20)) AS version", "claim_id % 8 AS skip_bits", "CAST(floor(claim_id / 4) AS BIGINT) AS task_id",
            ],
        ],
    ),
    "analyses": ("orders", False, [["o_orderkey AS record_id", "o_custkey % 10 AS job_id", "o_custkey AS rack", "'M' || CAST(o_orderkey % 4 AS VARCHAR(20)) AS top_move"]]),
    "runs": ("orders", False, [["o_custkey % 5 AS pool", "o_orderkey AS run_id", "CAST(o_orderdate AS TIMESTAMP) AS computed_at", "CAST(1500 + o_custkey % 700 AS DOUBLE) AS rating"]]),
    "deltas": (
        "lineitem",
        False,
        [["l_orderkey AS submission", "l_partkey AS rack", "CAST(l_quantity AS BIGINT) AS n", "CAST(round(l_extendedprice * 100) AS BIGINT) AS equity_cents", "l_orderkey % 3 AS generation"]],
    ),
    "universe": ("part", False, [["p_partkey AS rack", "p_partkey % 50 AS r"], ["rack", "r"]]),
    "positions": (
        "events",
        False,
        [["event_id AS record_id", "CAST(floor(event_id / 8) AS BIGINT) AS task", "CAST(floor(event_id / 2) AS BIGINT) % 4 AS game_index", "event_id % 2 AS turn", "CAST(floor(event_id / 16) AS BIGINT) % 5 AS rack"]],
    ),
    "input_data": ("documents", False, [["doc_id", "source || '/' || CAST(CAST(floor(doc_id / 2) AS BIGINT) AS VARCHAR(20)) AS path", "sha2(coalesce(text, ''), 256) AS sha256"]]),
    "audit": (
        "events",
        False,
        [["event_id AS audit_id", "CASE event_type WHEN 'purchase' THEN 'user.ban' WHEN 'error' THEN 'job.delete' WHEN 'signup' THEN 'user.census' ELSE 'job.' || event_type END AS action", "user_id AS actor", "event_id % 50 AS target", "event_id % 40 AS job_id", "CAST(ts AS TIMESTAMP) AS created_at"]],
    ),
    "racks_text": ("part", False, [["p_partkey AS id", "substring(upper(replace(p_name, ' ', '')), 1, 7) AS rack", "substring(upper(replace(p_name, ' ', '')), 2, 3) AS used"]]),
}
TABLES["universe"][2][1][:] = ["rack"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, distinct, levels = TABLES[name]
    df = spark.read.parquet(f"{sf_dir}/{base}.parquet")
    for i, level in enumerate(levels):
        df = df.selectExpr(*level)
        if distinct and i == 0:
            df = df.distinct()
    return df.filter("rack % 50 <> 0") if name == "universe" else df


def sql(name: str) -> str:
    base, distinct, levels = TABLES[name]
    text = base
    for i, level in enumerate(levels):
        text = f"(SELECT {'DISTINCT ' if distinct and i == 0 else ''}{', '.join(level)} FROM {text})"
    text = text.replace("sha2(coalesce(text, ''), 256)", "sha256(coalesce(text, ''))")
    return f"(SELECT * FROM {text} WHERE rack % 50 <> 0)" if name == "universe" else text
