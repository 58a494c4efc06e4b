"""Pairwise evidence and ratings of many pools at once, residuals, history and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import PENT, expected, num, pair_sample
from ..scratch import shared_folder
from .fits import DENSE, RATED, fit_pool, fit_tables


#: What a job must share with a pool to count in it.
SCOPE = ["variant", "letterdist", "layout"]


def pool_evidence(results: DataFrame, jobs: DataFrame, pools: DataFrame, members: DataFrame) -> DataFrame:
    """One row per pool and head-to-head (a < b), both seatings from a's side; pair jobs in the pool's scope only."""
    scope = jobs.filter("job_type = 'game_pairs'").join(pools.select("pool", *SCOPE), SCOPE).select("job_id", "pool")
    flipped = F.col("p1") > F.col("p2")
    sided = [F.sum(F.when(flipped, F.col(PENT[4 - i])).otherwise(F.col(PENT[i]))).alias(PENT[i]) for i in range(5)]
    spread = F.col("games") * (F.col("p1_score_mean") - F.col("p2_score_mean"))
    # sums per job and seating first: the facts meet the pools already small
    seated = results.filter("p1 <> p2").groupBy("job_id", "p1", "p2").agg(*(F.sum(c).alias(c) for c in PENT), F.sum("games").alias("games"), F.sum(spread).alias("spread"))
    rows = seated.join(scope, "job_id")
    for seat in ("p1", "p2"):
        rows = rows.join(members.select("pool", F.col("config").alias(seat)), ["pool", seat], "left_semi")
    return rows.groupBy("pool", F.least("p1", "p2").alias("a"), F.greatest("p1", "p2").alias("b")).agg(
        *sided, F.sum("games").alias("games"), F.sum(F.when(flipped, -F.col("spread")).otherwise(F.col("spread"))).alias("spread_sum")
    )


def both_sides(evidence: DataFrame) -> DataFrame:
    """The evidence from either side."""
    other = evidence.select("pool", F.col("b").alias("a"), F.col("a").alias("b"), *(F.col(PENT[4 - i]).alias(PENT[i]) for i in range(5)), "games", (-F.col("spread_sum")).alias("spread_sum"))
    return evidence.unionByName(other)


def cross_table(evidence: DataFrame, ratings: DataFrame) -> DataFrame:
    """Per pool and ordered pair: pairs, actual and predicted score, standard error, mean spread."""
    n, mean, variance = pair_sample([F.col(c) for c in PENT])
    rated = ratings.select("pool", "config", "rating")
    cells = both_sides(evidence)
    for side in ("a", "b"):
        cells = cells.join(rated.withColumnsRenamed({"config": side, "rating": f"r{side}"}), ["pool", side])
    error = F.when(n > 0, F.sqrt(F.greatest(variance, F.lit(0.0)) / num(n))).otherwise(F.lit(float("inf")))
    return cells.select("pool", "a", "b", n.alias("pairs"), mean.alias("actual"), expected(F.col("ra") - F.col("rb")).alias("predicted"), error.alias("stderr"), F.try_divide(F.col("spread_sum"), num(F.col("games"))).alias("spread"))


def residual_report(cells: DataFrame) -> DataFrame:
    """Per head-to-head: residual, whether it is notable and significant; per pool: non-transitive at three significant ones."""
    once = cells.filter("a < b").withColumn("residual", F.col("actual") - F.col("predicted"))
    p = F.greatest(F.least("predicted", F.lit(0.99)), F.lit(0.01))
    z = F.try_divide(F.col("residual"), F.sqrt(p * (1 - p) / num(F.col("pairs"))))
    rows = once.withColumn("z", z).withColumns({"notable": F.abs("residual") >= 0.05, "significant": F.coalesce(F.abs("z") >= 3, F.lit(False))})
    loud = F.count_if("significant").over(W.partitionBy("pool")) >= 3
    return rows.select("pool", "a", "b", "residual", "z", "notable", "significant", loud.alias("non_transitive"))


def pool_components(evidence: DataFrame, members: DataFrame) -> DataFrame:
    """(pool, config, component): the smallest member that a chain of played games reaches.

    Labels spread along edges and jump to their label's label until nothing changes; rounds grow with the logarithm of
    a component's width. Each round is checkpointed, so that lineage stays short.
    """
    shared_folder(evidence.sparkSession)
    edges = both_sides(evidence.filter("games > 0")).select("pool", F.col("a").alias("config"), F.col("b").alias("other")).checkpoint()
    label = members.select("pool", "config", F.col("config").alias("component"))
    while True:
        near = edges.join(label.select("pool", F.col("config").alias("other"), F.col("component").alias("c")), ["pool", "other"]).groupBy("pool", "config").agg(F.min("c").alias("c"))
        step = label.join(near, ["pool", "config"], "left").select("pool", "config", "component", F.least("component", "c").alias("next"))
        jump = step.select("pool", F.col("config").alias("next"), F.col("next").alias("after"))
        new = step.join(jump, ["pool", "next"], "left").select("pool", "config", "component", F.least("next", "after").alias("to")).checkpoint()
        label = new.select("pool", "config", F.col("to").alias("component"))
        if new.filter("component <> to").isEmpty():
            return label


def rate_pools(evidence: DataFrame, members: DataFrame, pools: DataFrame, dense: int = DENSE) -> DataFrame:
    """(pool, config, rating, stderr, pairs, connected) of every member; small pools side by side, larger ones as tables (see fits)."""
    cells = evidence.select("pool", "a", "b", sum(map(F.col, PENT[1:]), F.col(PENT[0])).cast("double").alias("g"), sum((F.col(c) * (i / 4) for i, c in enumerate(PENT)), F.lit(0.0)).alias("s"))
    sizes = members.groupBy("pool").agg(F.count("*").alias("n"))
    small, large = (sizes.filter(c).select("pool") for c in (F.col("n") <= dense, F.col("n") > dense))
    rows = cells.unionByName(members.select("pool", F.col("config").alias("a"), F.col("config").alias("b"), F.lit(0.0).alias("g"), F.lit(0.0).alias("s")))
    rows = rows.join(pools.select("pool", "anchor", "anchor_rating"), "pool").join(small, "pool", "left_semi")
    out = rows.groupBy("pool").applyInPandas(fit_pool, RATED)
    if large.isEmpty():
        return out
    cells, members, evidence = (x.join(large, "pool", "left_semi") for x in (cells, members, evidence))
    component = pool_components(evidence, members)
    anchors = component.join(pools.select("pool", F.col("anchor").alias("config")), ["pool", "config"]).select("pool", "component")
    return out.unionByName(fit_tables(cells, members, pools, component.join(anchors, ["pool", "component"], "left_semi")))


def numbered_runs(runs: DataFrame) -> DataFrame:
    """Runs with their number in their pool's order of time: numbers of a day on top of the days before, so no task sees a pool."""
    rows = runs.withColumn("day", F.to_date("computed_at"))
    days = rows.groupBy("pool", "day").agg(F.count("*").alias("of_day"))
    earlier = W.partitionBy("pool").orderBy("day").rowsBetween(W.unboundedPreceding, -1)  # a row for each day
    days = days.withColumns({"before": F.coalesce(F.sum("of_day").over(earlier), F.lit(0)), "total": F.sum("of_day").over(W.partitionBy("pool"))}).drop("of_day")
    inside = W.partitionBy("pool", "day").orderBy("computed_at", "run_id")
    return rows.join(days, ["pool", "day"]).withColumn("n", F.col("before") + F.row_number().over(inside)).drop("before")


def rating_history(runs: DataFrame, most: int = 500) -> DataFrame:
    """At most about `most` runs of each pool, evenly thinned; the first and the last stay."""
    kept = (F.col("total") <= most) | ((F.col("n") - 1) % F.ceil(F.col("total") / most) == 0) | (F.col("n") == F.col("total"))
    return numbered_runs(runs).filter(kept).drop("day")


def top_history(runs: DataFrame, rated: DataFrame, members: DataFrame, most: int = 500, k: int = 6) -> DataFrame:
    """(pool, run_id, computed_at, config, rating, stderr): the thinned runs of those who are best now.

    rated: a row for each run and config (pool, run_id, config, rating, stderr, connected). Best are the k members of the
    pool that the newest run connects and rates highest.
    """
    newest = runs.groupBy("pool").agg(F.max_by("run_id", F.struct("computed_at", "run_id")).alias("run_id"))
    now = rated.filter("connected").join(newest, ["pool", "run_id"], "left_semi").join(members.select("pool", "config"), ["pool", "config"], "left_semi")
    best = top_members(now, k).select("pool", "config")
    shown = rating_history(runs, most).select("pool", "run_id", "computed_at")
    return rated.filter("connected").join(best, ["pool", "config"], "left_semi").join(shown, ["pool", "run_id"]).select("pool", "run_id", "computed_at", "config", "rating", "stderr")


def thin_runs(runs: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Runs that retention drops: older than `days`, neither the last of their UTC day nor the first of their pool."""
    newest = F.row_number().over(W.partitionBy("pool", F.to_date("computed_at")).orderBy(F.desc("computed_at"), F.desc("run_id")))
    first = runs.groupBy("pool").agg(F.min_by("run_id", F.struct("computed_at", "run_id")).alias("run_id"))
    rows = runs.withColumn("newest", newest).filter((F.col("computed_at") < as_of - F.expr(f"INTERVAL {days} DAYS")) & (F.col("newest") > 1)).drop("newest")
    return rows.join(first, ["pool", "run_id"], "left_anti").select(*runs.columns)


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each pool."""
    return runs.groupBy("pool").agg(F.max_by(F.struct("run_id", "rating"), F.struct("computed_at", "run_id")).alias("last")).select("pool", "last.*")


def pool_membership(members: DataFrame, configs: DataFrame, ratings: DataFrame) -> DataFrame:
    """Every (pool, config) asked for: rated, unrated (a member without a rating) or other (no member)."""
    rows = configs.join(members.select("pool", "config", F.lit(True).alias("m")), ["pool", "config"], "left").join(ratings.select("pool", "config", F.lit(True).alias("r")), ["pool", "config"], "left")
    return rows.select("pool", "config", F.when(F.col("r") & F.col("m"), "rated").when(F.col("m"), "unrated").otherwise("other").alias("standing"))


def pairings(members: DataFrame) -> DataFrame:
    """All unordered pairs of each pool's members, seat order kept; a single member plays itself."""
    a, b = members.select("pool", F.col("config").alias("p1"), F.col("seat").alias("s1")), members.select("pool", F.col("config").alias("p2"), F.col("seat").alias("s2"))
    alone = members.groupBy("pool").agg(F.count("*").alias("n"), F.min("config").alias("p1")).filter("n = 1").select("pool", "p1", F.col("p1").alias("p2"))
    return a.join(b, "pool").filter("s1 < s2").select("pool", "p1", "p2").unionByName(alone)


def unplayed(pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Pairings without evidence in either seating."""
    played = evidence.select("pool", F.col("a").alias("x"), F.col("b").alias("y"))
    return pairs.withColumns({"x": F.least("p1", "p2"), "y": F.greatest("p1", "p2")}).join(played, ["pool", "x", "y"], "left_anti").drop("x", "y")


def standings(rated: DataFrame) -> DataFrame:
    """Members with their place in the order of a cross table: connected ones first, then by rating."""
    place = F.row_number().over(W.partitionBy("pool").orderBy(F.desc("connected"), F.desc("rating"), "config"))
    return rated.withColumn("place", place.cast("long"))


def worst_residuals(cells: DataFrame, k: int) -> DataFrame:
    """The k head-to-heads of all pools that are furthest from what their ratings predict, worst first."""
    off = F.abs(F.col("actual") - F.col("predicted"))
    return cells.filter("a < b").withColumn("off", off).orderBy(F.desc("off"), "pool", "a", "b").limit(k)


def rating_bounds(rated: DataFrame, times: float = 1.96, most: float = 400.0) -> DataFrame:
    """Visible errors of at most so many points, and each pool's range of them with a margin of 8 % or 10 points."""
    error = F.least(F.col("stderr") * times, F.lit(most))
    rows = rated.withColumns({"low": F.col("rating") - error, "high": F.col("rating") + error})
    ends = rows.groupBy("pool").agg(F.min("low").alias("least"), F.max("high").alias("most"))
    margin = F.greatest(F.lit(10.0), 0.08 * (F.col("most") - F.col("least")))
    return rows.join(ends, "pool").select("pool", "config", "low", "high", (F.col("least") - margin).alias("axis_low"), (F.col("most") + margin).alias("axis_high"))


def top_members(rated: DataFrame, k: int = 6) -> DataFrame:
    """The k best connected members of each pool."""
    place = F.row_number().over(W.partitionBy("pool").orderBy(F.desc("rating"), "config"))
    return rated.filter("connected").withColumn("place", place).filter(F.col("place") <= k)
