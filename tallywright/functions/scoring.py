"""Column formulas of samples, the anytime-valid match test and ratings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points for each unit of log-strength.
POINTS = 250.0
PENT = tuple(f"pent_{i}" for i in range(5))


def num(x) -> Column:
    return F.lit(float(x)) if isinstance(x, int | float) else x.cast("double")


def game_sample(wins: Column, losses: Column, ties: Column) -> tuple[Column, Column, Column]:
    """Number, mean and population variance of games scored 1, 0 and a half; zeros without games."""
    n = wins + losses + ties
    mean = F.coalesce(F.try_divide(num(wins) + 0.5 * num(ties), num(n)), F.lit(0.0))
    return n, mean, F.coalesce(F.try_divide(num(wins) + 0.25 * num(ties), num(n)) - mean * mean, F.lit(0.0))


def pair_sample(counts: list[Column]) -> tuple[Column, Column, Column]:
    """The same of pairs scored a quarter of their half-points."""
    n = sum(counts[1:], counts[0])
    first = sum((num(c) * (i / 4) for i, c in enumerate(counts)), F.lit(0.0))
    second = sum((num(c) * (i / 4) ** 2 for i, c in enumerate(counts)), F.lit(0.0))
    mean = F.coalesce(F.try_divide(first, num(n)), F.lit(0.0))
    return n, mean, F.coalesce(F.try_divide(second, num(n)) - mean * mean, F.lit(0.0))


def half_width(n: Column, variance: Column, confidence: Column, least: Column, most: Column, planned: Column) -> Column:
    """Half-width of the confidence sequence, tightest at the geometric mean of the first and the last checked number."""
    alpha = 1 - confidence / 100
    tuned = F.sqrt(num(F.greatest(least, F.lit(1))) * num(F.greatest(most, F.lit(1))))
    rho2 = (-2 * F.log(alpha) + F.log(-2 * F.log(alpha) + 1)) / (tuned * planned)
    x = num(n) * F.greatest(variance, F.lit(0.0)) * rho2 + 1
    width = F.sqrt(F.try_divide(2 * x, num(n) * num(n) * rho2) * F.log(F.sqrt(x) / alpha))
    return F.coalesce(width, F.lit(float("inf")))


def verdict(n: Column, mean: Column, width: Column, least: Column, most: Column) -> tuple[Column, Column, Column, Column]:
    """Mean, clipped bounds and status."""
    mean = F.when(n == 0, F.lit(0.5)).otherwise(mean)
    low, high = F.greatest(mean - width, F.lit(0.0)), F.least(mean + width, F.lit(1.0))
    capped = F.when(n >= most, "inconclusive").otherwise("running")
    status = F.when(n < least, capped).when(low > 0.5, "player1_better").when(high < 0.5, "player2_better").otherwise(capped)
    return mean, low, high, status


def expected(gap: Column) -> Column:
    """Expected score at a rating gap."""
    return 1 / (1 + F.exp(-gap / POINTS))


def claim_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two instants, rounded, at least 0."""
    return F.greatest(F.round((F.unix_micros(end) - F.unix_micros(start)) / 1000), F.lit(0.0)).cast("long")
