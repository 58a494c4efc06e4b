"""Queries by name over the stand-in tables, and the same results in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import PENT
from ..operators import consensus, coverage, outcomes, people, ratings
from ..sources.standins import load, sql
from ..scratch import scratch

QUERIES = {}
ORACLES: dict[str, str] = {}
AS_OF_SQL = "TIMESTAMP '2024-01-30 23:00:00'"
TYPES = ["games", "game_pairs", "opening_rack", "leave_gen"]
MARGIN, MOST = 2, 4
TARGETS = [60, 80, 100]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def as_of():
    return F.expr(AS_OF_SQL)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


class Tables:
    """Stand-ins of one folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        df = load(self.spark, self.sf_dir, name)
        if name == "claims":
            return df.withColumn("completed_at", F.when(F.col("state") == "completed", F.expr("timestampadd(MILLISECOND, CAST(held_ms AS INT), claimed_at)")))
        return df

    @property
    def pools(self) -> DataFrame:
        return self.spark.sql("SELECT * FROM VALUES (0L, 0L, 0L, 0L, 0L, 2000.0D), (1L, 1L, 0L, 0L, 2L, 2000.0D) AS t(pool, variant, letterdist, layout, anchor, anchor_rating)")

    @property
    def members(self) -> DataFrame:
        rows = [(0, i, i) for i in range(6)] + [(1, i, 8 - i) for i in range(2, 9)]
        return self.spark.sql(f"SELECT * FROM VALUES {', '.join(f'({p}L, {c}L, {s})' for p, c, s in rows)} AS t(pool, config, seat)")

    @property
    def ratings(self) -> DataFrame:
        return self.members.select("pool", "config", (2000.0 + 37 * F.col("config")).alias("rating"))

    @property
    def moves(self) -> DataFrame:
        """Five moves per analysis; the first is the record's own."""
        record = F.col("record_id")
        rows = self.analyses.select("record_id", "top_move", F.explode(F.lit([1, 2, 3, 4, 5]).cast("array<bigint>")).alias("rank"))
        move = F.when(F.col("rank") == 1, F.col("top_move")).otherwise(F.concat(F.lit("M"), ((record + F.col("rank")) % 7).cast("string")))
        return rows.select("record_id", "rank", move.alias("move"), (record * F.col("rank") % 60).alias("score"))

    @property
    def progress(self) -> DataFrame:
        return self.universe.select(F.explode(F.lit([0, 1, 2]).cast("array<bigint>")).alias("generation"), "rack", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("equity_cents"))

    @property
    def merged(self) -> DataFrame:
        return coverage.added(coverage.fold_rows(self.deltas), self.progress)

    @property
    def standings(self) -> DataFrame:
        return consensus.key_consensus(self.analyses, MARGIN, MOST)


CLAIMS = f"(SELECT *, CASE WHEN state = 'completed' THEN claimed_at + held_ms * INTERVAL 1 MILLISECOND END AS completed_at FROM {sql('claims')})"
DONE = f"(SELECT * FROM {CLAIMS} WHERE state = 'completed')"
POOLS = "(VALUES (0, 0, 0, 0, 0, 2000.0), (1, 1, 0, 0, 2, 2000.0)) AS pools(pool, variant, letterdist, layout, anchor, anchor_rating)"
MEMBERS = "(SELECT 0 AS pool, i AS config, i AS seat FROM range(6) t(i) UNION ALL SELECT 1, i, 8 - i FROM range(2, 9) t(i))"
MOVES = f"(SELECT record_id, rank, CASE WHEN rank = 1 THEN top_move ELSE 'M' || CAST((record_id + rank) % 7 AS VARCHAR) END AS move, record_id * rank % 60 AS score FROM {sql('analyses')}, range(1, 6) t(rank))"
FOLDED = f"(SELECT generation, rack, CAST(sum(n) AS BIGINT) AS n, CAST(sum(equity_cents) AS BIGINT) AS equity_cents FROM {sql('deltas')} GROUP BY ALL)"
MERGED = f"(SELECT g AS generation, u.rack, coalesce(n, 0) AS n, coalesce(equity_cents, 0) AS equity_cents FROM {sql('universe')} u CROSS JOIN range(3) t(g) LEFT JOIN {FOLDED} f ON f.rack = u.rack AND f.generation = g)"
_sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in outcomes.SUMS)


# ---- outcomes


@query(
    f"""SELECT job_id, {_sums}, round(sum(games * p1_score_mean) / sum(games), 6) AS p1_mean, round(sum(games * p2_score_mean) / sum(games), 6) AS p2_mean,
    round(sum(games * (p1_score_mean - p2_score_mean)) / sum(games), 6) AS spread_mean FROM {sql("results")} GROUP BY job_id"""
)
def match_summary(spark, sf_dir):
    return rounded(outcomes.match_summary(Tables(spark, sf_dir).results), "p1_mean", "p2_mean", "spread_mean")


def _tested(tallies: str) -> str:
    """Rows with units, mean, lower, upper and status, from rows with tallies, job type and limits."""
    pairs = " + ".join(PENT)
    return f"""(SELECT *, CASE WHEN units < min_units THEN CASE WHEN units >= max_units THEN 'inconclusive' ELSE 'running' END WHEN lower > 0.5 THEN 'player1_better'
        WHEN upper < 0.5 THEN 'player2_better' WHEN units >= max_units THEN 'inconclusive' ELSE 'running' END AS status
    FROM (SELECT *, greatest(mean - width, 0.0) AS lower, least(mean + width, 1.0) AS upper
    FROM (SELECT * EXCLUDE (mean0), CASE WHEN units = 0 THEN 0.5 ELSE mean0 END AS mean, CASE WHEN units = 0 THEN CAST('inf' AS DOUBLE) ELSE sqrt(2 * x / (CAST(units AS DOUBLE) * units * rho2) * ln(sqrt(x) / alpha)) END AS width
    FROM (SELECT *, units * greatest(variance, 0) * rho2 + 1 AS x
    FROM (SELECT *, (-2 * ln(alpha) + ln(-2 * ln(alpha) + 1)) / (sqrt(greatest(min_units, 1) * CAST(greatest(max_units, 1) AS DOUBLE)) * CASE job_type WHEN 'game_pairs' THEN 0.0625 ELSE 0.25 END) AS rho2
    FROM (SELECT *, 1 - confidence_pct / 100 AS alpha, second - mean0 * mean0 AS variance
    FROM (SELECT *, CASE WHEN units = 0 THEN 0.0 WHEN job_type = 'game_pairs' THEN (pent_1 * 0.25 + pent_2 * 0.5 + pent_3 * 0.75 + pent_4) / units ELSE (wins + 0.5 * ties) / units END AS mean0,
        CASE WHEN units = 0 THEN 0.0 WHEN job_type = 'game_pairs' THEN (pent_1 * 0.0625 + pent_2 * 0.25 + pent_3 * 0.5625 + pent_4) / units ELSE (wins + 0.25 * ties) / units END AS second
    FROM (SELECT *, CASE WHEN job_type = 'game_pairs' THEN {pairs} ELSE wins + losses + ties END AS units FROM {tallies}))))))))"""


_MATCH_JOBS = f"(SELECT * FROM {sql('jobs')} WHERE job_type IN ('games', 'game_pairs'))"
_totals = ", ".join(f"CAST(coalesce(sum(r.{c}), 0) AS BIGINT) AS {c}" for c in ("wins", "losses", "ties", *PENT))
_TALLIES = f"(SELECT j.job_id, j.job_type, j.min_units, j.max_units, j.confidence_pct, {_totals} FROM {_MATCH_JOBS} j LEFT JOIN {sql('results')} r ON r.job_id = j.job_id GROUP BY ALL)"


@query(f"SELECT job_id, job_type, units, round(mean, 6) AS mean, round(lower, 6) AS lower, round(upper, 6) AS upper, status FROM {_tested(_TALLIES)}")
def match_test(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rounded(outcomes.match_test(t.results, t.jobs), "mean", "lower", "upper")


_running = ", ".join(f"CAST(sum(r.{c}) OVER w AS BIGINT) AS {c}" for c in ("wins", "losses", "ties", *PENT))
_SO_FAR = f"(SELECT r.result_id, r.submitted_at, j.job_id, j.job_type, j.min_units, j.max_units, j.confidence_pct, {_running} FROM {sql('results_skewed')} r JOIN {_MATCH_JOBS} j ON j.job_id = r.job_id WINDOW w AS (PARTITION BY r.job_id ORDER BY r.submitted_at, r.result_id ROWS UNBOUNDED PRECEDING))"


@query(f"SELECT job_id, result_id, units, status FROM {_tested(_SO_FAR)} WHERE status <> 'running' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY submitted_at, result_id) = 1")
def match_monitor(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return outcomes.monitor_matches(t.results_skewed, t.jobs)


_pairs = " + ".join(f"sum({c})" for c in PENT)


@query(f"SELECT job_id, CAST({_pairs} AS BIGINT) AS pairs, {', '.join(f'round(sum({c}) / ({_pairs}), 6) AS share_{i}' for i, c in enumerate(PENT))}, CAST({' + '.join(f'{i} * sum({c})' for i, c in enumerate(PENT))} AS BIGINT) AS half_points FROM {sql('results')} GROUP BY job_id")
def pair_outcomes(spark, sf_dir):
    return rounded(outcomes.pair_outcomes(Tables(spark, sf_dir).results), *(f"share_{i}" for i in range(5)))


# ---- ratings

_EVIDENCE = f"""(SELECT pools.pool, least(p1, p2) AS a, greatest(p1, p2) AS b, {', '.join(f'CAST(sum(CASE WHEN p1 > p2 THEN {PENT[4 - i]} ELSE {PENT[i]} END) AS BIGINT) AS {PENT[i]}' for i in range(5))},
    CAST(sum(games) AS BIGINT) AS games, sum(games * (p1_score_mean - p2_score_mean) * CASE WHEN p1 > p2 THEN -1 ELSE 1 END) AS spread_sum
    FROM {sql('results')} r JOIN {sql('jobs')} j ON j.job_id = r.job_id JOIN {POOLS} ON pools.variant = j.variant AND pools.letterdist = j.letterdist AND pools.layout = j.layout JOIN {MEMBERS} x ON x.pool = pools.pool AND x.config = p1 JOIN {MEMBERS} y ON y.pool = pools.pool AND y.config = p2
    WHERE j.job_type = 'game_pairs' AND p1 <> p2 GROUP BY ALL)"""


def evidence(t: Tables, results: DataFrame | None = None) -> DataFrame:
    return ratings.pool_evidence(t.results if results is None else results, t.jobs, t.pools, t.members)


@query(f"SELECT CAST(pool AS BIGINT) AS pool, * EXCLUDE (pool) FROM {_EVIDENCE}")
def pool_evidence(spark, sf_dir):
    return evidence(Tables(spark, sf_dir))


_SIDES = f"(SELECT pool, a, b, {', '.join(PENT)}, games, spread_sum FROM {_EVIDENCE} UNION ALL SELECT pool, b, a, {', '.join(reversed(PENT))}, games, -spread_sum FROM {_EVIDENCE})"
_CELLS = f"""(SELECT *, sqrt(greatest((pent_1 / 16 + pent_2 / 4 + pent_3 * 9 / 16 + pent_4) / pairs - actual * actual, 0) / pairs) AS stderr, spread_sum / games AS spread
    FROM (SELECT *, (pent_1 * 0.25 + pent_2 * 0.5 + pent_3 * 0.75 + pent_4) / pairs AS actual, 1 / (1 + exp(-(37.0 * (a - b)) / 250)) AS predicted FROM (SELECT *, {' + '.join(PENT)} AS pairs FROM {_SIDES})))"""


@query(f"SELECT CAST(pool AS BIGINT) AS pool, a, b, pairs, round(actual, 6) AS actual, round(predicted, 6) AS predicted, round(stderr, 6) AS stderr, round(spread, 6) AS spread FROM {_CELLS}")
def cross_table(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rounded(ratings.cross_table(evidence(t), t.ratings), "actual", "predicted", "stderr", "spread")


@query(
    f"""SELECT CAST(pool AS BIGINT) AS pool, a, b, round(residual, 6) AS residual, round(z, 6) AS z, abs(residual) >= 0.05 AS notable, abs(z) >= 3 AS significant, count(*) FILTER (abs(z) >= 3) OVER (PARTITION BY pool) >= 3 AS non_transitive
    FROM (SELECT *, actual - predicted AS residual, (actual - predicted) / sqrt(least(greatest(predicted, 0.01), 0.99) * (1 - least(greatest(predicted, 0.01), 0.99)) / pairs) AS z FROM {_CELLS} WHERE a < b)"""
)
def residual_report(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rounded(ratings.residual_report(ratings.cross_table(evidence(t), t.ratings)), "residual", "z")


#: The same maximum by steps along the slope, a member at a time scaled by a bound of its curvature; errors by Jacobi steps.
_FIT = f"""(WITH RECURSIVE side AS (SELECT pool, a, b, {' + '.join(PENT)} AS g, pent_1 * 0.25 + pent_2 * 0.5 + pent_3 * 0.75 + pent_4 AS s FROM {_SIDES.replace(sql('results'), sql('results_skewed'))}),
    node AS (
        SELECT m.pool, m.config, count(*) OVER (PARTITION BY m.pool) AS n, coalesce(p.g, 0) AS pairs, greatest(2 / (1 + coalesce(p.g, 0) / 200), 0.2) AS v, m.config = pools.anchor AS pinned, anchor_rating
        FROM {MEMBERS} m JOIN {POOLS} ON pools.pool = m.pool LEFT JOIN (SELECT pool, a, sum(g) AS g FROM side GROUP BY ALL) p ON p.pool = m.pool AND p.a = m.config
    ),
    fit AS (
        SELECT 0 AS step, pool, config, CAST(0 AS DOUBLE) AS t FROM node UNION ALL
        SELECT step + 1, pool, config, CASE WHEN pinned THEN 0 ELSE t + (slope + pull - avg(pull) OVER (PARTITION BY pool)) / (pairs / 2 + 0.25) END FROM (
            SELECT f.step, f.pool, f.config, f.t, pinned, pairs, slope, v * (0.5 - 1 / (1 + exp((avg(f.t) OVER (PARTITION BY f.pool) - f.t) / 2))) / 2 AS pull
            FROM fit f JOIN node ON node.pool = f.pool AND node.config = f.config
            LEFT JOIN (SELECT x.pool, x.config, sum(s - g / (1 + exp(y.t - x.t))) AS slope FROM fit x JOIN side ON side.pool = x.pool AND side.a = x.config JOIN fit y ON y.pool = side.pool AND y.config = side.b GROUP BY ALL
                UNION ALL SELECT pool, config, 0 FROM node WHERE pairs = 0) z ON z.pool = f.pool AND z.config = f.config
            WHERE f.step < 1200
        )
    ),
    best AS (SELECT pool, config, t FROM fit WHERE step = 1200),
    near AS (SELECT pool, anchor AS config FROM {POOLS} UNION SELECT near.pool, side.b FROM near JOIN side ON side.pool = near.pool AND side.a = near.config),
    known AS (SELECT node.pool, node.config FROM node JOIN near ON near.pool = node.pool AND near.config = node.config WHERE NOT pinned AND pairs > 0),
    weighed AS (SELECT side.pool, side.a, side.b, g / (1 + exp(y.t - x.t)) / (1 + exp(x.t - y.t)) AS w FROM side JOIN best x ON x.pool = side.pool AND x.config = side.a JOIN best y ON y.pool = side.pool AND y.config = side.b),
    degree AS (SELECT pool, a AS config, sum(w) AS d FROM weighed GROUP BY ALL),
    inverse AS (
        SELECT 0 AS step, i.pool, i.config AS i, c.config AS c, CAST(0 AS DOUBLE) AS x FROM known i JOIN known c ON c.pool = i.pool UNION ALL
        SELECT any_value(v.step) + 1, v.pool, v.i, v.c, (CAST(v.i = v.c AS INT) + coalesce(sum(w * u.x), 0)) / any_value(d) FROM inverse v JOIN degree ON degree.pool = v.pool AND degree.config = v.i
        JOIN weighed ON weighed.pool = v.pool AND weighed.a = v.i LEFT JOIN inverse u ON u.pool = v.pool AND u.i = weighed.b AND u.c = v.c WHERE v.step < 1200 GROUP BY v.pool, v.i, v.c
    ),
    pulls AS (SELECT pool, config, pull - avg(pull) OVER (PARTITION BY pool) AS prior FROM (SELECT node.pool, node.config, v * (0.5 - 1 / (1 + exp((avg(t) OVER (PARTITION BY node.pool) - t) / 2))) / 2 AS pull FROM node JOIN best ON best.pool = node.pool AND best.config = node.config)),
    errors AS (SELECT e.pool, e.i AS config, 250 * sqrt(sum(x) FILTER (i = c) + (1.5 * sum(x * prior)) ** 2) AS error FROM inverse e JOIN pulls ON pulls.pool = e.pool AND pulls.config = e.c WHERE step = 1200 GROUP BY ALL)
    SELECT CAST(node.pool AS BIGINT) AS pool, node.config, anchor_rating + 250 * t AS rating, CASE WHEN pinned THEN 0 ELSE coalesce(error, CAST('inf' AS DOUBLE)) END AS stderr, CAST(pairs AS DOUBLE) AS pairs, near.config IS NOT NULL AND pairs > 0 AS connected
    FROM node JOIN best ON best.pool = node.pool AND best.config = node.config LEFT JOIN near ON near.pool = node.pool AND near.config = node.config LEFT JOIN errors ON errors.pool = node.pool AND errors.config = node.config)"""


@query(f"SELECT pool, config, round(rating, 4) AS rating, round(stderr, 4) AS stderr, pairs, connected FROM {_FIT}")
def rate_pools(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ratings.rate_pools(evidence(t, t.results_skewed), t.members, t.pools).withColumns({n: F.round(n, 4) for n in ("rating", "stderr")})


@query(f"SELECT pool, config, round(rating, 4) AS rating, connected, row_number() OVER (PARTITION BY pool ORDER BY connected DESC, rating DESC, config) AS place FROM {_FIT}")
def pool_standings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ratings.standings(ratings.rate_pools(evidence(t, t.results_skewed), t.members, t.pools)).select("pool", "config", F.round("rating", 4).alias("rating"), "connected", "place")


@query(f"SELECT CAST(pool AS BIGINT) AS pool, a, b, round(abs(actual - predicted), 6) AS off FROM {_CELLS} WHERE a < b ORDER BY abs(actual - predicted) DESC, pool, a, b LIMIT 20")
def worst_residuals(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rounded(ratings.worst_residuals(ratings.cross_table(evidence(t), t.ratings), 20).select("pool", "a", "b", "off"), "off")


@query(
    f"""WITH RECURSIVE e AS (SELECT pool, a, b FROM {_EVIDENCE} UNION ALL SELECT pool, b, a FROM {_EVIDENCE}),
    r AS (SELECT pool, config, config AS other FROM {MEMBERS} UNION SELECT r.pool, r.config, e.b FROM r JOIN e ON e.pool = r.pool AND e.a = r.other)
    SELECT CAST(pool AS BIGINT) AS pool, config, min(other) AS component FROM r GROUP BY ALL"""
)
def pool_components(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ratings.pool_components(evidence(t), t.members)


@query(
    f"""SELECT pool, run_id, n, total, epoch_us(computed_at) AS computed_us FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY computed_at, run_id) AS n, count(*) OVER (PARTITION BY pool) AS total FROM {sql("runs")})
    WHERE total <= 50 OR (n - 1) % CAST(ceil(total / 50) AS BIGINT) = 0 OR n = total"""
)
def rating_history(spark, sf_dir):
    rows = ratings.rating_history(Tables(spark, sf_dir).runs, 50)
    return rows.select("pool", "run_id", F.col("n").cast("long").alias("n"), "total", F.unix_micros("computed_at").alias("computed_us"))


@query(
    f"""SELECT pool, run_id FROM (SELECT *, row_number() OVER (PARTITION BY pool, CAST(computed_at AS DATE) ORDER BY computed_at DESC, run_id DESC) AS newest, row_number() OVER (PARTITION BY pool ORDER BY computed_at, run_id) AS oldest FROM {sql("runs")})
    WHERE computed_at < {AS_OF_SQL} - INTERVAL 30 DAY AND newest > 1 AND oldest > 1"""
)
def thin_runs(spark, sf_dir):
    return ratings.thin_runs(Tables(spark, sf_dir).runs, as_of()).select("pool", "run_id")


@query(f"SELECT pool, arg_max(run_id, (computed_at, run_id)) AS run_id, arg_max(rating, (computed_at, run_id)) AS rating FROM {sql('runs')} GROUP BY pool")
def latest_runs(spark, sf_dir):
    return ratings.latest_runs(Tables(spark, sf_dir).runs)


#: A rating of each of nine configs in each run; a third of a pool's configs are no members, and a fifth of a run's aren't connected.
_RATED = f"(SELECT pool, run_id, computed_at, config, CAST(1500 + (run_id * 7 + config * 131) % 700 AS DOUBLE) AS rating, CAST(5 + (run_id + config) % 40 AS DOUBLE) AS stderr, (run_id + config) % 5 <> 0 AS connected FROM {sql('runs')}, range(9) t(config))"


@query(
    f"""WITH r AS {_RATED}, k AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY computed_at, run_id) AS n, count(*) OVER (PARTITION BY pool) AS total FROM {sql('runs')}),
    b AS (SELECT r.pool, r.config FROM r JOIN k ON k.run_id = r.run_id AND n = total WHERE connected AND (r.config + r.pool) % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY r.pool ORDER BY r.rating DESC, r.config) <= 4)
    SELECT r.pool, r.run_id, epoch_us(r.computed_at) AS computed_us, r.config, r.rating, r.stderr FROM r JOIN b ON b.pool = r.pool AND b.config = r.config JOIN k ON k.run_id = r.run_id WHERE connected AND (total <= 50 OR (n - 1) % CAST(ceil(total / 50) AS BIGINT) = 0 OR n = total)"""
)
def top_history(spark, sf_dir):
    """Ratings over time of the four best members of each pool."""
    runs = Tables(spark, sf_dir).runs
    rated = runs.select("pool", "run_id", F.explode(F.lit(list(range(9))).cast("array<bigint>")).alias("config"))
    rated = rated.selectExpr("pool", "run_id", "config", "CAST(1500 + (run_id * 7 + config * 131) % 700 AS DOUBLE) AS rating", "CAST(5 + (run_id + config) % 40 AS DOUBLE) AS stderr", "(run_id + config) % 5 <> 0 AS connected")
    members = runs.select("pool").distinct().select("pool", F.explode(F.lit(list(range(9))).cast("array<bigint>")).alias("config")).filter("(config + pool) % 3 <> 0")
    rows = ratings.top_history(runs, rated, members, 50, 4)
    return rows.select("pool", "run_id", F.unix_micros("computed_at").alias("computed_us"), "config", "rating", "stderr")


_PLAYED = f"(SELECT DISTINCT pool, a AS config FROM {_SIDES})"


@query(
    f"""SELECT CAST(g.pool AS BIGINT) AS pool, c.config, CASE WHEN m.config IS NOT NULL AND r.config IS NOT NULL THEN 'rated' WHEN m.config IS NOT NULL THEN 'unrated' ELSE 'other' END AS standing
    FROM (SELECT DISTINCT p1 AS config FROM {sql("results")}) c CROSS JOIN (SELECT 0 AS pool UNION ALL SELECT 1) g LEFT JOIN {MEMBERS} m ON m.pool = g.pool AND m.config = c.config LEFT JOIN {_PLAYED} r ON r.pool = g.pool AND r.config = c.config"""
)
def pool_membership(spark, sf_dir):
    t = Tables(spark, sf_dir)
    played = ratings.both_sides(evidence(t)).select("pool", F.col("a").alias("config")).distinct()
    return ratings.pool_membership(t.members, t.results.select(F.col("p1").alias("config")).distinct().select("config", F.explode(F.lit([0, 1]).cast("array<bigint>")).alias("pool")), played)


@query(
    f"""SELECT CAST(x.pool AS BIGINT) AS pool, x.config AS p1, y.config AS p2 FROM {MEMBERS} x JOIN {MEMBERS} y ON x.pool = y.pool AND x.seat < y.seat
    WHERE NOT EXISTS (SELECT 1 FROM {_EVIDENCE} e WHERE e.pool = x.pool AND e.a = least(x.config, y.config) AND e.b = greatest(x.config, y.config))"""
)
def unplayed_pairings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ratings.unplayed(ratings.pairings(t.members), evidence(t))


@query(f"SELECT CAST(x.pool AS BIGINT) AS pool, x.config AS p1, y.config AS p2, e.games FROM {MEMBERS} x JOIN {MEMBERS} y ON x.pool = y.pool AND x.seat < y.seat LEFT JOIN {_EVIDENCE} e ON e.pool = x.pool AND e.a = least(x.config, y.config) AND e.b = greatest(x.config, y.config)")
def pairings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = evidence(t).select("pool", F.col("a").alias("x"), F.col("b").alias("y"), "games")
    rows = ratings.pairings(t.members).withColumns({"x": F.least("p1", "p2"), "y": F.greatest("p1", "p2")})
    return rows.join(found, ["pool", "x", "y"], "left").select("pool", "p1", "p2", "games")


# ---- consensus

_VOTES = f"""(SELECT job_id, rack, CAST(sum(n) AS BIGINT) AS results, max(CASE WHEN place = 1 THEN top_move END) AS top_move, max(CASE WHEN place = 1 THEN n END) AS top_count, coalesce(max(CASE WHEN place = 2 THEN n END), 0) AS runner_up_count
    FROM (SELECT *, row_number() OVER (PARTITION BY job_id, rack ORDER BY n DESC, top_move) AS place FROM (SELECT job_id, rack, top_move, count(*) AS n FROM {{records}} GROUP BY ALL)) GROUP BY ALL)"""


def _standings(margin: int, most: int, records: str = sql("analyses")) -> str:
    agreed = f"(top_count - runner_up_count >= {margin} OR ({most} <= 1 AND runner_up_count = 0))"
    return f"(SELECT *, {agreed} AS agreed, {agreed} OR results >= {most} AS settled, ({agreed} OR results >= {most}) AND NOT {agreed} AS without FROM {_VOTES.format(records=records)})"


@query(f"SELECT * FROM {_standings(MARGIN, MOST)}")
def key_consensus(spark, sf_dir):
    return Tables(spark, sf_dir).standings


@query(
    f"""SELECT a.job_id, a.rack, a.settled, a.without, b.settled AS new_settled, b.without AS new_without FROM {_standings(MARGIN, MOST)} a JOIN {_standings(3, 6)} b ON a.job_id = b.job_id AND a.rack = b.rack
    WHERE (a.settled, a.without) <> (b.settled, b.without)"""
)
def restate_consensus(spark, sf_dir):
    return consensus.restate_consensus(Tables(spark, sf_dir).standings, 3, 6)


_FIRST_HALF = f"(SELECT * FROM {sql('analyses')} WHERE record_id % 2 = 0)"


@query(
    f"""SELECT job_id, CAST(sum(s) AS BIGINT) AS analysed, CAST(sum(s * CAST(settled AS INT)) AS BIGINT) AS settled, CAST(sum(s * CAST(without AS INT)) AS BIGINT) AS without
    FROM (SELECT *, 1 AS s FROM {_standings(MARGIN, MOST)} UNION ALL SELECT *, -1 FROM {_standings(MARGIN, MOST, _FIRST_HALF)}) GROUP BY job_id"""
)
def consensus_tally(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return consensus.consensus_tally(consensus.key_consensus(t.analyses.filter("record_id % 2 = 0"), MARGIN, MOST), t.standings)


@query(
    f"""SELECT rack, results, seen FROM (SELECT w.rack, w.results, CAST(w.rack % 3 = 0 AS INT) AS seen FROM
    (SELECT rack, results FROM {_standings(MARGIN, MOST)} WHERE NOT settled AND rack NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase') ORDER BY results, rack LIMIT 80) w) ORDER BY seen, results, rack LIMIT 20"""
)
def next_reanalysis(spark, sf_dir):
    t = Tables(spark, sf_dir)
    busy = t.claims.filter("state = 'claimed'").select(F.col("worker").alias("rack"))
    return consensus.next_reanalysis(t.standings, busy, t.analyses.filter("rack % 3 = 0"), 20)


@query(f"SELECT f.job_id, f.rack, string_agg(m.move, ',' ORDER BY m.rank) AS leaders FROM (SELECT job_id, rack, min(record_id) AS record_id FROM {sql('analyses')} GROUP BY ALL) f JOIN {MOVES} m ON m.record_id = f.record_id AND m.rank <= 3 GROUP BY ALL")
def first_pass_leaders(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return consensus.first_pass_leaders(t.analyses, t.moves, 3).withColumn("leaders", F.array_join("leaders", ","))


# ---- coverage


@query(f"SELECT * FROM {MERGED}")
def merge_deltas(spark, sf_dir):
    """From submissions as they are staged: parallel arrays."""
    t = Tables(spark, sf_dir)
    return coverage.merge_deltas(coverage.stage(t.deltas), t.progress)


@query(f"SELECT generation, count(*) AS keys, CAST(sum(n) AS BIGINT) AS n FROM {FOLDED} WHERE rack NOT IN (SELECT rack FROM {sql('universe')}) GROUP BY ALL")
def unmatched_deltas(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return coverage.unmatched(coverage.stage(t.deltas), t.progress)


_target = "[60, 80, 100][greatest(1, least(generation, 3))]"


@query(f"SELECT generation, count(*) AS keys, count(*) FILTER (n >= {_target}) AS at_target, CAST(sum(n) AS BIGINT) AS total, min(n) AS least, arg_min(rack, (n, rack)) AS least_rack FROM {MERGED} GROUP BY generation")
def generation_summary(spark, sf_dir):
    return coverage.generation_summary(Tables(spark, sf_dir).merged, TARGETS)


@query(f"SELECT rack, n, row_number() OVER (ORDER BY rack) AS place, (SELECT count(*) FROM {MERGED} WHERE generation = 1 AND n < 200 AND rack > 25) > 40 AS more FROM {MERGED} WHERE generation = 1 AND n < 200 AND rack > 25 ORDER BY rack LIMIT 40")
def select_sweep(spark, sf_dir):
    return coverage.select_sweep(Tables(spark, sf_dir).merged, 1, 200, 25, 40).withColumn("place", F.col("place").cast("long"))


@query(f"SELECT rack, n FROM {MERGED} WHERE generation = 2 AND n < 500 AND rack NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase') ORDER BY n, rack LIMIT 40")
def select_tail(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return coverage.select_tail(t.merged, 2, 500, t.claims.filter("state = 'claimed'").select(F.col("worker").alias("rack")), 40)


@query(f"SELECT rack, n, CAST(equity_cents // 100 AS VARCHAR) || '.' || lpad(CAST(equity_cents % 100 AS VARCHAR), 2, '0') || '00000000' AS equity_sum, round(equity_cents / 100 / nullif(n, 0), 6) AS mean FROM {MERGED} WHERE generation = 1")
def generation_table(spark, sf_dir):
    return rounded(coverage.generation_table(Tables(spark, sf_dir).merged, 1), "mean")


# The bag grows with the tables: tiles are the first letters of parts, as many as a hundredth of them, five at most.
_BAG = "(SELECT upper(substring(p_name, 1, 1)) AS letter, CAST(least(5, 1 + count(*) // 100) AS INT) AS n FROM part GROUP BY 1)"


@query(
    f"""WITH RECURSIVE bag AS (SELECT letter, n, row_number() OVER (ORDER BY letter) AS place FROM {_BAG}),
    f AS (SELECT '' AS rack, 0 AS size, CAST(0 AS BIGINT) AS place UNION ALL SELECT f.rack || repeat(b.letter, CAST(t AS INT)), CAST(f.size + t AS INT), b.place FROM f JOIN bag b ON b.place = f.place + 1, range(0, 6) r(t) WHERE t <= b.n AND f.size + t <= 5)
    SELECT rack FROM f WHERE size = 5 AND place = (SELECT max(place) FROM bag)"""
)
def multiset_universe(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    bag = part.groupBy(F.upper(F.substring("p_name", 1, 1)).alias("letter")).agg(F.least(F.lit(5), 1 + F.floor(F.count("*") / 100)).cast("int").alias("n")).withColumn("place", F.col("letter"))
    return coverage.multiset_universe(spark, bag, 5)


@query(
    f"""WITH RECURSIVE bag AS (SELECT letter, n, row_number() OVER (ORDER BY letter) AS place FROM {_BAG}),
    f AS (SELECT '' AS rack, 0 AS size, CAST(0 AS BIGINT) AS place UNION ALL SELECT f.rack || repeat(b.letter, CAST(t AS INT)), CAST(f.size + t AS INT), b.place FROM f JOIN bag b ON b.place = f.place + 1, range(0, 5) r(t) WHERE t <= b.n AND f.size + t <= 4)
    SELECT CAST(8 AS BIGINT) AS job_id, CAST(1 AS BIGINT) AS generation, count(*) AS racks_total FROM f WHERE size BETWEEN 1 AND 4 AND place = (SELECT max(place) FROM bag)"""
)
def leave_universe(spark, sf_dir):
    """All leaves of one to four tiles, written for a job's generation and counted where they were written."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    bag = part.groupBy(F.upper(F.substring("p_name", 1, 1)).alias("letter")).agg(F.least(F.lit(5), 1 + F.floor(F.count("*") / 100)).cast("int").alias("n")).withColumn("place", F.col("letter"))
    return coverage.write_universe(coverage.multiset_universe(spark, bag, 4, 1), 8, 1, scratch(spark, "universe"))


# ---- people

_PSEUDO = "substring(sha256(CAST(worker AS VARCHAR)), 1, 16)"
_TOTALS = f"(SELECT worker, is_anon, count(*) AS tasks, CAST(sum(held_ms) AS BIGINT) AS compute_ms, CAST(sum(movegens) AS BIGINT) AS movegens FROM {DONE} GROUP BY ALL)"


@query(f"SELECT CASE WHEN is_anon THEN {_PSEUDO} ELSE 'user' || CAST(worker AS VARCHAR) END AS name, tasks, compute_ms, movegens, (SELECT count(*) FROM {_TOTALS}) AS contributors FROM {_TOTALS} ORDER BY tasks DESC, worker LIMIT 50")
def contributors(spark, sf_dir):
    return people.contributors(Tables(spark, sf_dir).claims)


@query(f"SELECT * FROM {_TOTALS} ORDER BY compute_ms DESC, is_anon, worker LIMIT 25 OFFSET 10")
def leaderboard(spark, sf_dir):
    return people.leaderboard(Tables(spark, sf_dir).claims, "compute_ms", 25, 10)


@query(
    f"""SELECT t.job_type, coalesce(count(c.claim_id), 0) AS tasks, CAST(coalesce(sum(c.held_ms), 0) AS BIGINT) AS compute_ms, count(DISTINCT (c.worker, c.is_anon)) FILTER (c.claim_id IS NOT NULL) AS contributors
    FROM (VALUES ('games'), ('game_pairs'), ('opening_rack'), ('leave_gen'), ('retired')) t(job_type) LEFT JOIN {sql("jobs")} j ON j.job_type = t.job_type LEFT JOIN {DONE} c ON c.job_id = j.job_id GROUP BY ALL"""
)
def contributions_by_type(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return people.contributions_by_type(t.claims, t.jobs, [*TYPES, "retired"])


@query(f"SELECT claim_id, job_id, epoch_us(completed_at) AS completed_us FROM {DONE} WHERE worker = 7 AND completed_at <= TIMESTAMP '2024-01-20' ORDER BY completed_at DESC, claim_id DESC LIMIT 30")
def contributor_feed(spark, sf_dir):
    rows = people.contributor_feed(Tables(spark, sf_dir).claims, 7, (F.expr("TIMESTAMP '2024-01-20 00:00:00'"), -1), 30)
    return rows.select("claim_id", "job_id", F.unix_micros("completed_at").alias("completed_us"))


@query(f"SELECT c.worker, c.claims, b.target IS NOT NULL AS banned FROM (SELECT worker, count(*) AS claims FROM {CLAIMS} GROUP BY ALL) c LEFT JOIN (SELECT DISTINCT target FROM {sql('audit')} WHERE action = 'user.ban') b ON b.target = c.worker")
def ban_status(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return people.ban_status(t.claims, t.audit.filter("action = 'user.ban'"))


@query(
    f"""SELECT job_id, max(n) AS longest, count(*) FILTER (n >= 3) AS trips FROM (SELECT job_id, island, count(*) AS n FROM (SELECT *, count(*) FILTER (state = 'completed') OVER (PARTITION BY job_id ORDER BY claimed_at, claim_id ROWS UNBOUNDED PRECEDING) AS island FROM {CLAIMS})
    WHERE state = 'abandoned' GROUP BY ALL) GROUP BY job_id"""
)
def overrun_streak(spark, sf_dir):
    return people.overrun_streak(Tables(spark, sf_dir).claims)


@query(f"SELECT claim_id, job_id, late AS overran FROM (SELECT *, epoch_us({AS_OF_SQL}) - epoch_us(claimed_at) AS age, epoch_us({AS_OF_SQL}) - epoch_us(claimed_at) > held_ms * 1000 + 600000000 AS late FROM {CLAIMS} WHERE state = 'claimed') WHERE age > 7200000000 OR late")
def lapsed_claims(spark, sf_dir):
    return people.lapsed_claims(Tables(spark, sf_dir).claims, as_of(), 7200, 600)
