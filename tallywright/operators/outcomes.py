"""Match outcomes: tallies per job, the anytime-valid test, and when it first decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import PENT, game_sample, half_width, num, pair_sample, verdict
from ..scratch import running, scratch, sliced

SUMS = ("games", "wins", "losses", "ties", *PENT, "divergent_games", "divergent_wins", "divergent_losses", "divergent_ties")


def weighted_mean(value: str, weight: str) -> Column:
    """Mean of a value that each row holds for so many units; null without units."""
    return F.try_divide(F.sum(F.col(weight) * F.col(value)), num(F.sum(weight)))


def match_summary(results: DataFrame) -> DataFrame:
    """Per job: sums of all tallies, and score means weighted by games."""
    return results.groupBy("job_id").agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS),
        weighted_mean("p1_score_mean", "games").alias("p1_mean"),
        weighted_mean("p2_score_mean", "games").alias("p2_mean"),
        F.try_divide(F.sum(F.col("games") * (F.col("p1_score_mean") - F.col("p2_score_mean"))), num(F.sum("games"))).alias("spread_mean"),
    )


def with_test(tallies: DataFrame) -> DataFrame:
    """Add units, mean, lower, upper and status to rows with tallies and their job's type and limits."""
    paired = F.col("job_type") == "game_pairs"
    gn, gm, gv = game_sample(*(F.col(c) for c in ("wins", "losses", "ties")))
    pn, pm, pv = pair_sample([F.col(c) for c in PENT])
    n, mean, variance = (F.when(paired, p).otherwise(g) for p, g in ((pn, gn), (pm, gm), (pv, gv)))
    limits = F.col("min_units"), F.col("max_units")
    width = half_width(n, variance, F.col("confidence_pct"), *limits, F.when(paired, 0.0625).otherwise(0.25))
    names = ("mean", "lower", "upper", "status")
    return tallies.withColumns({"units": n, **dict(zip(names, verdict(n, mean, width, *limits)))})


def match_test(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """The test on each match job's totals; jobs without results are at a half, and running."""
    matches = jobs.filter(F.col("job_type").isin("games", "game_pairs"))
    rows = matches.join(match_summary(results), "job_id", "left").fillna(0, list(SUMS))
    return with_test(rows).select("job_id", "job_type", "units", "mean", "lower", "upper", "status")


def monitor_matches(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """The first verdict of each match job in submission order; later results don't move it.

    Running sums are taken inside slices of all results, on top of the sums of a job's slices before, so that no task has to
    hold a job or one of its days.
    """
    matches = jobs.filter(F.col("job_type").isin("games", "game_pairs"))
    counts = ["wins", "losses", "ties", *PENT]
    rows = results.select("job_id", "result_id", "submitted_at", *counts).join(matches.select("job_id"), "job_id", "left_semi")
    rows = running(sliced(rows, f"{scratch(results.sparkSession, 'monitor')}/rows", "job_id", "submitted_at", "result_id"), "job_id", counts)
    decided = with_test(rows.join(matches, "job_id")).filter("status <> 'running'")
    first = F.min_by(F.struct("result_id", "units", "status"), F.struct("submitted_at", "result_id")).alias("first")
    return decided.groupBy("job_id").agg(first).select("job_id", "first.*")


def signed(x: Column, places: int) -> Column:
    """A number with its sign and so many places; what rounds to zero has none."""
    rounded = F.round(x, places)
    text = F.format_string(f"%.{places}f", F.abs(rounded))
    return F.when(rounded > 0, F.concat(F.lit("+"), text)).when(rounded < 0, F.concat(F.lit("-"), text)).otherwise(text)


def score_lines(summary: DataFrame) -> DataFrame:
    """How a match stands as it is printed, from its summary: shares, averages, leader, the spread's points and who is ahead by it.

    Figures are rounded first, so that what rounds to zero is 0.00, ahead of nobody; without games, shares and spread are null.
    """
    played = F.col("wins") + F.col("losses") + F.col("ties")
    share = F.try_divide(num(F.col("wins")) + 0.5 * num(F.col("ties")), num(played))
    percent = lambda x: F.when(x.isNotNull(), F.format_string("%.2f%%", F.round(100 * x, 2)))
    leader = F.when(F.col("wins") > F.col("losses"), 1).when(F.col("losses") > F.col("wins"), 2).otherwise(0)
    spread = F.round("spread_mean", 2)
    pairs = sum((F.col(c) for c in PENT[1:]), F.col(PENT[0]))
    shares = [F.format_string("%.1f", F.round(F.coalesce(F.try_divide(100 * num(F.col(c)), num(pairs)), F.lit(0.0)), 1)) for c in PENT]
    return summary.select(
        "job_id", played.alias("played"), percent(share).alias("share1"), percent(1 - share).alias("share2"), leader.alias("leader"),
        *(F.when(F.col(c).isNotNull(), F.format_string("%.2f", F.round(c, 2))).alias(c) for c in ("p1_mean", "p2_mean")),
        F.when(spread.isNotNull(), F.format_string("%.2f", F.abs(spread))).alias("points"), F.when(spread > 0, 1).when(spread < 0, 2).otherwise(0).alias("ahead"),
        signed(F.col("spread_mean"), 1).alias("spread"), F.concat_ws("/", *shares).alias("pair_shares"),
    )


def pair_outcomes(results: DataFrame) -> DataFrame:
    """Per job: pairs, the share of each of the five outcomes, and player 1's half-points."""
    sums = results.groupBy("job_id").agg(*(F.sum(c).alias(c) for c in PENT)).withColumn("pairs", sum(map(F.col, PENT[1:]), F.col(PENT[0])))
    return sums.select("job_id", "pairs", *(F.try_divide(num(F.col(c)), num(F.col("pairs"))).alias(f"share_{i}") for i, c in enumerate(PENT)), sum((F.col(c) * i for i, c in enumerate(PENT)), F.lit(0)).cast("long").alias("half_points"))
