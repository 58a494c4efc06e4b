"""Fit ratings of pools to their head-to-heads: the maximum of a concave likelihood, with errors.

A member's strength is a number theta, zero for the pool's anchor. A head-to-head of g pairs with score s adds
s d - g ln(1 + e^d) for the difference d of two strengths; every member also draws a few virtual pairs against the pool's
mean, d being its distance from the mean by PRIOR_SCALE. Both are logistic terms, so a Newton step solves one system of
weighted differences; a step that changes some difference by r is shortened by ln(1 + r) / r, which always climbs, as the
curvature of a logistic term changes by a factor of e^r at most on the way.

Pools of up to DENSE members are small dense systems, side by side, a pool in a task. Larger pools are tables: edges and
members are rows, every product with a vector is one join and one aggregation, and systems are solved by conjugate
gradients; no task or group holds a pool. Which way a pool takes changes nothing but the time (and errors, see below).

The error of a member that a chain of games joins to the anchor: the inverse of the games' information, plus what the
virtual pairs shift (PULL_IN_ERROR times that shift, squared). Large pools get the inverse's diagonal by PROBES random
projections of the edges, whose variance is relative: about sqrt(2 / PROBES) of the squared error; with as many probes or
more as a pool has edges every edge is a probe of its own, and the diagonal is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import POINTS
from ..scratch import scratch, written

#: Fixed values of the prior and the error: virtual pairs, where they are halved, their floor, scale of their logistic,
#: times the prior's shift enters an error.
PRIOR_GAMES, FADE_GAMES, FLOOR_GAMES, PRIOR_SCALE = 2.0, 200.0, 0.2, 2.0
PULL_IN_ERROR = 1.5
#: Members of a pool that is fitted densely at most; the longest step of a finished fit; steps of a fit and of a system.
DENSE, DONE, STEPS, ROUNDS = 200, 1e-7, 60, 400
#: How far a Newton step's system is solved, and an error's; random projections of a large pool's edges; rounds
#: between two looks at how far systems are.
INNER, SOLVED, PROBES, CHECK = 1e-2, 1e-5, 256, 3
RATED = "pool long, config long, rating double, stderr double, pairs double, connected boolean"


def virtual(played):
    """Virtual pairs of a member with so many real ones; for arrays."""
    return np.maximum(PRIOR_GAMES / (1 + played / FADE_GAMES), FLOOR_GAMES)


def fit_pool(cells: pd.DataFrame) -> pd.DataFrame:
    """A small pool: columns pool, a, b, g, s, anchor, anchor_rating; a member is a row with a = b."""
    config = np.unique(cells.loc[cells.a == cells.b, "a"])
    met = cells[(cells.a != cells.b) & (cells.g > 0)].sort_values(["a", "b"])
    n, anchor = len(config), np.searchsorted(config, cells.anchor.iloc[0])
    games = np.eye(n)[np.searchsorted(config, met.a)] - np.eye(n)[np.searchsorted(config, met.b)]
    mean = (np.eye(n) - 1 / n) / PRIOR_SCALE
    played = np.abs(games).T @ met.g.to_numpy()
    # both kinds of terms in a row: differences, pairs, scores
    terms, pairs = np.vstack([games, mean]), np.concatenate([met.g, virtual(played)])
    score = np.concatenate([met.s, virtual(played) / 2])
    free, theta = np.arange(n) != anchor, np.zeros(n)
    for _ in range(STEPS if n > 1 else 0):
        p = 1 / (1 + np.exp(-terms @ theta))
        part = terms[:, free]
        step = np.linalg.solve(part.T @ (part * (pairs * p * (1 - p))[:, None]), part.T @ (score - pairs * p))
        reach = np.abs(part @ step).max()
        theta[free] += step * (np.log1p(reach) / reach if reach else 0)
        if np.abs(step).max() < DONE:
            break
    near, joined = np.abs(games).T @ np.abs(games) > 0, np.arange(n) == anchor
    while (more := near @ joined | joined).sum() > joined.sum():
        joined = more
    known, p = joined & (played > 0) & free, 1 / (1 + np.exp(-terms @ theta))
    error = np.where(np.arange(n) == anchor, 0.0, np.inf)
    if known.any():
        seen, m = games[:, known], len(met)
        inverse = np.linalg.pinv(seen.T @ (seen * (pairs * p * (1 - p))[:m, None]), hermitian=True)
        shift = mean[:, known].T @ (score - pairs * p)[m:]
        variance = np.diag(inverse) + (PULL_IN_ERROR * inverse @ shift) ** 2
        error[known] = POINTS * np.sqrt(np.where(variance > 0, variance, np.inf))
    return pd.DataFrame({"pool": cells.pool.iloc[0], "config": config, "rating": cells.anchor_rating.iloc[0] + POINTS * theta, "stderr": error, "pairs": played, "connected": joined & (played > 0)})


def solve(edges: DataFrame, rows: DataFrame, keys: list[str], folder: str, close: float) -> DataFrame:
    """(keys, config, x): many systems at once by conjugate gradients.

    edges: pool, a, b, weight, from either side; rows: keys (the first is pool), config, free, degree (sum of a member's
    weights), soft (curvature of its virtual pairs), n (members), rhs (0 where not free). A system's matrix is the weighted
    differences of the edges, and of soft against the pool's mean, on the free members.
    """
    scale = F.col("degree") + F.col("soft") + F.lit(1e-300)
    start = F.when(F.col("free"), F.col("rhs") / scale).otherwise(0.0)
    state = rows.select(*keys, "config", "free", "degree", "soft", "n", F.lit(0.0).alias("x"), F.col("rhs").alias("r"), start.alias("p"), F.lit(0).alias("round"))
    state, first = written(state, f"{folder}/0"), None
    for k in range(1, ROUNDS + 1):
        norm = state.groupBy(*keys).agg(F.sum(F.col("r") * F.col("r") / scale).alias("rz"), (F.sum("p") / F.first("n")).alias("mean"), F.sum("soft").alias("softs"), F.sum(F.col("soft") * F.col("p")).alias("soft_p"))
        if first is None:
            first = written(norm.select(*keys, F.col("rz").alias("rz0")), f"{folder}/first")
        pulled = edges.join(state.select(*keys, F.col("config").alias("b"), F.col("p").alias("pb")), ["pool", "b"]).groupBy(*keys, F.col("a").alias("config")).agg(F.sum(F.col("weight") * F.col("pb")).alias("pulled"))
        prior = F.col("soft") * (F.col("p") - F.col("mean")) - (F.col("soft_p") - F.col("mean") * F.col("softs")) / F.col("n")
        q = F.when(F.col("free"), F.col("degree") * F.col("p") - F.coalesce("pulled", F.lit(0.0)) + prior).otherwise(0.0)
        rows = state.join(pulled, [*keys, "config"], "left").join(norm.select(*keys, "rz", "mean", "softs", "soft_p"), keys).withColumn("q", q)
        sums = rows.groupBy(*keys).agg(F.first("rz").alias("z"), F.sum(F.col("p") * F.col("q")).alias("pq"), F.sum(F.col("q") * F.col("r") / scale).alias("qr"), F.sum(F.col("q") * F.col("q") / scale).alias("qq"))
        length = F.coalesce(F.try_divide("z", "pq"), F.lit(0.0))
        left = F.greatest(F.col("z") - 2 * F.col("length") * F.col("qr") + F.col("length") * F.col("length") * F.col("qq"), F.lit(0.0))
        sums = sums.withColumn("length", F.when(F.col("pq") > 0, length).otherwise(0.0)).withColumn("turn", F.coalesce(F.try_divide(left, F.col("z")), F.lit(0.0)))
        r = F.col("r") - F.col("length") * F.col("q")
        new = rows.join(sums.select(*keys, "length", "turn"), keys).select(*keys, "config", "free", "degree", "soft", "n", (F.col("x") + F.col("length") * F.col("p")).alias("x"), r.alias("r"), F.when(F.col("free"), r / scale + F.col("turn") * F.col("p")).otherwise(0.0).alias("p"))
        state = written(new, f"{folder}/{k}")
        if k % CHECK:
            continue
        now = state.groupBy(*keys).agg(F.sum(F.col("r") * F.col("r") / scale).alias("rz")).join(first, keys)
        if now.filter(F.col("rz") > close * close * F.col("rz0")).isEmpty():
            break
    return state.select(*keys, "config", "x")


def sides(cells: DataFrame) -> DataFrame:
    """Head-to-heads from either side: pool, a, b, g, s."""
    met = cells.filter("a <> b AND g > 0").select("pool", "a", "b", "g", "s")
    return met.unionByName(met.select("pool", F.col("b").alias("a"), F.col("a").alias("b"), "g", (F.col("g") - F.col("s")).alias("s")))


def sloped(edges: DataFrame, nodes: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Edges with their weights, and members with both slopes, degree and soft, at the members' theta."""
    ends = [nodes.select("pool", F.col("config").alias(x), F.col("theta").alias(f"theta_{x}")) for x in "ab"]
    p = 1 / (1 + F.exp(F.col("theta_b") - F.col("theta_a")))
    rows = edges.join(ends[0], ["pool", "a"]).join(ends[1], ["pool", "b"]).withColumn("p", p)
    rows = written(rows.select("pool", "a", "b", (F.col("g") * F.col("p") * (1 - F.col("p"))).alias("weight"), (F.col("s") - F.col("g") * F.col("p")).alias("over")), f"{folder}/edges")
    own = rows.groupBy("pool", F.col("a").alias("config")).agg(F.sum("weight").alias("degree"), F.sum("over").alias("slope"))
    mean = nodes.groupBy("pool").agg(F.avg("theta").alias("mean"))
    q = 1 / (1 + F.exp(-(F.col("theta") - F.col("mean")) / PRIOR_SCALE))
    out = nodes.join(own, ["pool", "config"], "left").na.fill(0.0, ["degree", "slope"]).join(mean, "pool").withColumn("q", q)
    out = out.withColumns({"soft": F.col("virtual") * F.col("q") * (1 - F.col("q")) / PRIOR_SCALE**2, "pull": F.col("virtual") * (0.5 - F.col("q")) / PRIOR_SCALE})
    pulls = out.groupBy("pool").agg(F.avg("pull").alias("pulls"))
    return rows, written(out.join(pulls, "pool").withColumn("prior", F.col("pull") - F.col("pulls")).drop("q", "pull", "pulls", "mean"), f"{folder}/nodes")


def probed(edges: DataFrame, nodes: DataFrame, probes: int) -> DataFrame:
    """(pool, probe, config, rhs): what each probe asks of each member; probe -1 asks for the prior's shift."""
    inside = nodes.filter("known").select("pool", "config")
    once = edges.filter("a < b").join(nodes.select("pool", F.col("config").alias("a"), F.col("joined").alias("j")), ["pool", "a"]).filter("j")
    number = F.row_number().over(W.partitionBy("pool").orderBy("a", "b"))
    many = once.groupBy("pool").agg(F.count("*").alias("m"))
    once = once.join(many, "pool")
    exact = once.filter(F.col("m") <= probes).withColumn("probe", number - 1).withColumn("sign", F.lit(1.0))
    sign = F.when(F.pmod(F.xxhash64("pool", "a", "b", "probe"), F.lit(2)) == 0, 1.0).otherwise(-1.0) / float(np.sqrt(probes))
    drawn = once.filter(F.col("m") > probes).withColumn("probe", F.explode(F.sequence(F.lit(0), F.lit(probes - 1)))).withColumn("sign", sign)
    rows = exact.unionByName(drawn).withColumn("v", F.col("sign") * F.sqrt("weight"))
    rows = rows.select("pool", "probe", F.explode(F.array(F.struct(F.col("a").alias("config"), F.col("v")), F.struct(F.col("b").alias("config"), (-F.col("v")).alias("v")))).alias("x")).groupBy("pool", "probe", "x.config").agg(F.sum("x.v").alias("rhs"))
    return rows.join(inside, ["pool", "config"]).unionByName(nodes.filter("known").select("pool", F.lit(-1).alias("probe"), "config", F.col("prior").alias("rhs")))


def fit_tables(cells: DataFrame, members: DataFrame, pools: DataFrame, reached: DataFrame, probes: int = PROBES) -> DataFrame:
    """Large pools. cells: pool, a, b, g, s; reached: pool, config of the members in a component with the anchor."""
    folder = scratch(cells.sparkSession, "fit")
    edges = written(sides(cells), f"{folder}/sides")
    played = edges.groupBy("pool", F.col("a").alias("config")).agg(F.sum("g").alias("pairs"))
    count = members.groupBy("pool").agg(F.count("*").alias("n"))
    nodes = members.select("pool", "config").join(pools.select("pool", "anchor"), "pool").join(count, "pool").join(played, ["pool", "config"], "left").na.fill(0.0, ["pairs"])
    nodes = nodes.join(reached.select("pool", "config", F.lit(True).alias("joined")), ["pool", "config"], "left").withColumn("joined", F.coalesce("joined", F.lit(False)))
    games = F.greatest(F.lit(PRIOR_GAMES) / (1 + F.col("pairs") / FADE_GAMES), F.lit(FLOOR_GAMES))
    nodes = written(nodes.withColumns({"virtual": games, "free": F.col("config") != F.col("anchor"), "theta": F.lit(0.0)}), f"{folder}/members")
    columns = nodes.columns
    for k in range(STEPS):
        weighed, at = sloped(edges, nodes, f"{folder}/step{k}")
        slope = F.when(F.col("free"), F.col("slope") + F.col("prior")).otherwise(0.0)
        step = solve(weighed, at.select("pool", "config", "free", "degree", "soft", "n", slope.alias("rhs")), ["pool"], f"{folder}/step{k}/system", INNER)
        # no difference changes by more than twice the longest step
        reach = step.groupBy("pool").agg((2 * F.max(F.abs("x"))).alias("reach"))
        moved = F.col("theta") + F.col("x") * F.when(F.col("reach") > 0, F.log1p("reach") / F.col("reach")).otherwise(0.0)
        nodes = written(at.join(step, ["pool", "config"]).join(reach, "pool").withColumn("theta", moved).select(*columns), f"{folder}/moved{k}")
        if reach.filter(F.col("reach") > 2 * DONE).isEmpty():
            break
    weighed, at = sloped(edges, nodes, f"{folder}/end")
    known = at.withColumn("known", F.col("joined") & F.col("free") & (F.col("pairs") > 0))
    asked = written(probed(weighed, known, probes), f"{folder}/asked")
    # every member takes part in every probe of its pool
    systems = asked.select("pool", "probe").distinct().join(known.filter("known").select("pool", "config", "degree", "n"), "pool")
    systems = systems.join(asked, ["pool", "probe", "config"], "left").na.fill(0.0, ["rhs"]).withColumns({"free": F.lit(True), "soft": F.lit(0.0)})
    x = solve(weighed, systems, ["pool", "probe"], f"{folder}/errors", SOLVED)
    squares = F.sum(F.when(F.col("probe") >= 0, F.col("x") * F.col("x")).otherwise((PULL_IN_ERROR * F.col("x")) ** 2))
    found = x.groupBy("pool", "config").agg(squares.alias("variance"))
    error: Column = F.when(~F.col("free"), 0.0).when(F.col("variance") > 0, POINTS * F.sqrt("variance")).otherwise(float("inf"))
    out = nodes.join(found, ["pool", "config"], "left").join(pools.select("pool", "anchor_rating"), "pool")
    return out.select("pool", "config", (F.col("anchor_rating") + POINTS * F.col("theta")).alias("rating"), error.alias("stderr"), "pairs", (F.col("joined") & (F.col("pairs") > 0)).alias("connected"))
