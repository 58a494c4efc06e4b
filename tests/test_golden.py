"""Values that were computed outside this code, and properties of the formulas."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywright.functions.scoring import PENT, claim_ms, expected, half_width, pair_sample
from tallywright.operators import boards, coverage, feeds, ops, outcomes, quality, ratings
from tallywright.operators.people import pseudonym, resolve_pseudonym


def job(spark, kind="game_pairs", least=100, most=2000, confidence=95.0):
    return spark.createDataFrame([(1, kind, least, most, confidence)], "job_id long, job_type string, min_units long, max_units long, confidence_pct double")


def judged(spark, kind, tallies, **limits):
    values = {"wins": 0, "losses": 0, "ties": 0} | dict.fromkeys(PENT, 0) | tallies
    row = job(spark, kind, **limits).select("*", *(F.lit(v).cast("long").alias(k) for k, v in values.items()))
    return outcomes.with_test(row).head()


def test_interval_of_games(spark):
    r = judged(spark, "games", {"wins": 21, "losses": 7, "ties": 2}, least=100, most=10000)
    assert r.status == "running" and 0 <= r.lower < r.mean < r.upper <= 1 and r.mean == pytest.approx(22 / 30)


def test_fixed_intervals(spark):
    """Fixed values, computed to many digits elsewhere."""
    r = judged(spark, "games", {"wins": 21, "losses": 7, "ties": 2}, least=10, most=1000)
    assert (r.lower, r.upper) == pytest.approx((0.4762148648434058, 0.9904518018232608), abs=1e-12) and r.status == "running"
    r = judged(spark, "game_pairs", dict(zip(PENT, (1, 3, 7, 3, 2))), least=16, most=16, confidence=90.0)
    assert r.upper - r.mean == pytest.approx(0.1819521654365503, abs=1e-12) and r.status == "inconclusive"
    width = spark.range(1).select(half_width(F.lit(1000), F.lit(0.0625), F.lit(95.0), F.lit(1000), F.lit(1000), F.lit(0.25))).head()[0]
    assert width == pytest.approx(0.025806505014905885, abs=1e-12)
    status = {w: judged(spark, "games", {"wins": w, "losses": 1000 - w}, least=100, most=10_000).status for w in (547, 548, 452, 453)}
    assert status == {548: "player1_better", 547: "running", 452: "player2_better", 453: "running"}


def test_moments_of_pairs(spark):
    n, mean, variance = spark.range(1).select(*pair_sample([F.lit(x) for x in (1, 3, 7, 3, 2)])).head()
    assert n == 16 and mean == pytest.approx(17 / 32) and variance == pytest.approx(71 / 1024)


def test_half_width_shrinks_and_is_infinite_without_units(spark):
    width = lambda n: spark.range(1).select(half_width(F.lit(n), F.lit(0.25), F.lit(95.0), F.lit(100), F.lit(10000), F.lit(0.25))).head()[0]
    assert width(0) == math.inf and width(100) > width(1000) > width(10000) > 0


def test_cap_below_the_floor_is_inconclusive(spark):
    assert judged(spark, "games", {"wins": 30, "losses": 20}, least=100, most=50).status == "inconclusive"
    assert judged(spark, "games", {}, least=100, most=2000).mean == 0.5
    assert judged(spark, "games", {"wins": 1500, "losses": 100}).status == "player1_better"
    assert judged(spark, "games", {"wins": 100, "losses": 1500}).status == "player2_better"


def test_two_seatings_are_one_head_to_head(spark):
    rows = [(1, 0, 1, 1, 3, 7, 3, 2, 32, 10.0, 0.0), (1, 1, 0, 2, 1, 1, 0, 0, 8, 6.0, 0.0), (1, 0, 0, 1, 1, 1, 1, 1, 10, 5.0, 0.0), (1, 0, 7, 1, 1, 1, 1, 1, 10, 5.0, 0.0)]
    results = spark.createDataFrame(rows, "job_id long, p1 long, p2 long, pent_0 long, pent_1 long, pent_2 long, pent_3 long, pent_4 long, games long, p1_score_mean double, p2_score_mean double")
    jobs = spark.createDataFrame([(1, "game_pairs", 0, 4, 1)], "job_id long, job_type string, variant long, letterdist long, layout long")
    pools = spark.createDataFrame([(5, 0, 4, 1), (6, 0, 4, 2), (7, 0, 5, 1)], "pool long, variant long, letterdist long, layout long")
    members = spark.createDataFrame([(p, c) for p in (5, 6, 7) for c in (0, 1)], "pool long, config long")
    r = ratings.pool_evidence(results, jobs, pools, members).collect()
    assert len(r) == 1 and [r[0][c] for c in PENT] == [1, 3, 8, 4, 4] and r[0].spread_sum == 320 - 48
    cell = ratings.cross_table(spark.createDataFrame(r), members.withColumn("rating", F.lit(2000.0))).filter("a = 0").head()
    assert cell.actual == pytest.approx(47 / 80) and cell.stderr == pytest.approx(math.sqrt(491 / 128000)) and cell.spread == pytest.approx(6.8)


def cells(rows, n, anchor=0):
    frame = [(1, a, b, g, s, anchor, 2000.0) for a, b, g, s in rows] + [(1, i, i, 0.0, 0.0, anchor, 2000.0) for i in range(n)]
    return pd.DataFrame(frame, columns=["pool", "a", "b", "g", "s", "anchor", "anchor_rating"])


def test_three_quarters_is_250_ln_3():
    fit = ratings.fit_pool(cells([(0, 1, 1e7, 0.25e7)], 2))
    assert fit.rating[1] - fit.rating[0] == pytest.approx(250 * math.log(3), abs=0.01)


def test_undefeated_is_finite_and_order_does_not_matter():
    rows = [(0, 1, 40.0, 0.0), (1, 2, 30.0, 10.0), (0, 2, 20.0, 3.0)]
    a, b = ratings.fit_pool(cells(rows, 4)), ratings.fit_pool(cells(rows[::-1], 4))
    assert (a.rating - b.rating).abs().max() < 1e-3 and a.rating[1] < 10_000
    assert not a.connected[3] and a.stderr[3] == math.inf and a.stderr[0] == 0 and 0 < a.stderr[1] < math.inf


def test_triangle_rates_flat_with_loud_residuals(spark):
    evidence = spark.createDataFrame([(1, 0, 1, 0, 0, 0, 0, 400, 800, 0.0), (1, 1, 2, 0, 0, 0, 0, 400, 800, 0.0), (1, 0, 2, 400, 0, 0, 0, 0, 800, 0.0)], f"pool long, a long, b long, {', '.join(f'{c} long' for c in PENT)}, games long, spread_sum double")
    members = spark.createDataFrame([(1, i) for i in range(3)], "pool long, config long")
    pools = spark.createDataFrame([(1, 0, 2000.0)], "pool long, anchor long, anchor_rating double")
    rated = ratings.rate_pools(evidence, members, pools)
    assert all(abs(r.rating - 2000) < 1 for r in rated.collect())
    report = ratings.residual_report(ratings.cross_table(evidence, rated)).collect()
    assert len(report) == 3 and all(r.significant and r.notable and r.non_transitive for r in report)


def many_pools():
    """Two large pools with members apart, undefeated and unplayed, and a small one."""
    r, rows, members = np.random.default_rng(5), [], [(9, 0), (9, 1)]
    for pool, n in ((1, 14), (2, 9)):
        members += [(pool, c) for c in range(n)]
        strength = r.normal(0, 1, n)
        for a in range(n - 3):
            for b in r.choice(n - 3, 4, replace=False):
                if a < b:
                    for k in range(int(r.integers(1, 60))):
                        p = 1 / (1 + np.exp(strength[b] - strength[a]))
                        rows.append((pool, a, int(b), int(r.binomial(4, p))))
        rows += [(pool, n - 3, n - 2, 4)] * 7
    rows += [(9, 0, 1, k % 5) for k in range(30)]
    return rows, members, [(1, 3, 1500.0), (2, 0, 2000.0), (9, 0, 2000.0)]


def test_large_pools_as_tables_equal_the_dense_fit(spark):
    rows, members, pools = many_pools()
    pents = [F.count_if(F.col("k") == i).alias(c) for i, c in enumerate(PENT)]
    evidence = spark.createDataFrame(rows, "pool long, a long, b long, k int").groupBy("pool", "a", "b").agg(*pents).withColumns({"games": F.lit(0), "spread_sum": F.lit(0.0)})
    evidence = evidence.withColumn("games", 2 * sum(map(F.col, PENT[1:]), F.col(PENT[0])))
    members, pools = spark.createDataFrame(members, "pool long, config long"), spark.createDataFrame(pools, "pool long, anchor long, anchor_rating double")
    dense = {(x.pool, x.config): x for x in ratings.rate_pools(evidence, members, pools).collect()}
    wide = {(x.pool, x.config): x for x in ratings.rate_pools(evidence, members, pools, dense=5).collect()}
    assert set(dense) == set(wide) and len(dense) == 25
    for k, x in dense.items():
        y = wide[k]
        assert y.rating == pytest.approx(x.rating, abs=1e-5) and y.connected == x.connected and y.pairs == x.pairs
        assert y.stderr == x.stderr or y.stderr == pytest.approx(x.stderr, rel=1e-4)  # no more edges than probes: exact
    assert {x.stderr for x in dense.values() if not x.connected} == {math.inf}


def test_expectation_and_rounding(spark):
    r = spark.range(1).select(expected(F.lit(250 * math.log(3))).alias("p"), claim_ms(F.expr("timestamp_micros(0)"), F.expr("timestamp_micros(1500)")).alias("up"), claim_ms(F.expr("timestamp_micros(9000)"), F.expr("timestamp_micros(0)")).alias("none")).head()
    assert r.p == pytest.approx(0.75) and r.up == 2 and r.none == 0


def test_universe_total_unranking_and_scatter(spark):
    letters, bag = ["?", "A", "B", "C", "D", "E"], [1, 3, 2, 2, 2, 3]
    total = coverage.universe_counts(bag, 7)[0][7]
    rows = spark.createDataFrame([(x, n, i) for i, (x, n) in enumerate(zip(letters, bag))], "letter string, n int, place int")
    racks = {r.rack for r in coverage.multiset_universe(spark, rows, 7).collect()}
    assert len(racks) == total and all(len(x) == 7 for x in racks)
    assert {r.rack for r in coverage.unrank(spark.range(total).withColumnRenamed("id", "index"), letters, bag, 7).collect()} == racks
    assert spark.range(total).withColumnRenamed("id", "index").select(coverage.scattered(total).alias("x")).distinct().count() == total


def test_leaves_and_tiles(spark):
    r = spark.createDataFrame([("CATS?", "Ta", "A[L·L]B", "A[B")], "rack string, used string, tiles string, bad string")
    r = r.select(boards.leave_of(F.col("rack"), F.col("used")).alias("leave"), boards.leave_of(F.col("rack"), F.lit("ZZ")).alias("none"), quality.tile_count(F.col("tiles")).alias("n"), quality.tile_count(F.col("bad")).alias("bad"), boards.canonical_rack(F.lit("b?[LL]a"), ["A", "B", "LL"]).alias("canonical")).head()
    assert r.leave == "ACS" and r.none is None and r.n == 3 and r.bad is None and r.canonical == "AB[LL]?"


def test_pseudonyms(spark):
    people = spark.createDataFrame([(7,), (8,)], "worker long")
    name = people.filter("worker = 7").select(pseudonym(F.col("worker"))).head()[0]
    assert [r.worker for r in resolve_pseudonym(people, name).collect()] == [7] and resolve_pseudonym(people, "x' OR 1").collect() == []


def test_export_writes_lines_and_a_manifest(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("record_id"), F.array(F.struct(F.lit(1).alias("rank"))).alias("moves"))
    manifest = feeds.export_ndjson(rows.repartition(3), str(tmp_path / "out")).collect()
    assert sum(r["rows"] for r in manifest) == 100 and all(len(r.sha256) == 64 and r.bytes > 0 for r in manifest)


def test_manifest_of_odd_json_is_zero(spark):
    rows = spark.createDataFrame([('{"a": 2, "b": 3}',), ("[]",), (None,)], "row_counts string")
    assert [r.total for r in ops.manifest_total(rows).collect()] == [5, 0, 0]


def test_quality_of_nested_rows(spark):
    leaves = "array<struct<leave:string,draws:bigint>>"
    rows = spark.createDataFrame([(1, [("AB", 5), ("C", 3)], 9), (2, [("AB", 3), ("C", 5)], 9), (3, [("ABCDEFG", 3)], 2)], f"record_id long, leaves {leaves}, total_draws long")
    assert {(r.record_id, r.rule) for r in quality.validate_inference(rows).collect()} == {(2, "not_sorted"), (3, "above_total"), (3, "tiles")}
    plies = spark.createDataFrame([(1, [(0, 10.0, 30.0), (1, 20.0, 31.0)]), (2, [(1, 10.0, 30.0), (1, 120.0, 31.0)])], "move_id long, plies array<struct<ply:int,bingo_percentage:double,average_score:double>>")
    assert {(r.move_id, r.rule) for r in quality.validate_plies(plies).collect()} == {(2, "ply_order"), (2, "bingo_range")}
    occurrences = spark.createDataFrame([("b", "AAAAAAA", 5, 1.0), ("b", "AAAAAAA", 5, 1.0), ("b", "AB", 0, 9e9)], "batch string, rack string, count long, mean double")
    assert {r.rule for r in quality.validate_occurrences(occurrences, 2).collect()} == {"repeated", "tiles", "count", "mean"}
    configs = spark.createDataFrame([(1, "CSW24", "CSW24", "english"), (2, "CSW24", "RD29", "english"), (3, "odd", "odd", "odd"), (4, "x/OSPD6", "ospd6", "english_super"), (5, "DSW15", "DSW15", "dutch"), (6, "CEL23", "CEL23", "German"), (7, "english", "english", "english")], "config long, lexicon string, leaves string, distribution string")
    assert {r.config for r in quality.validate_configs(configs).collect()} == {2, 3, 6, 7}


def test_distribution_files(spark, tmp_path):
    from tallywright.operators.inputs import read_distributions

    (tmp_path / "test.csv").write_bytes(b"?,?,1,0,0\r\nA,a,3,1,1\r\n\r\nB,b,300,3,0\n")
    rows = read_distributions(spark, str(tmp_path))
    assert {(r.letter, r["count"], r.is_vowel) for r in rows.collect()} == {("?", 1, 0), ("A", 3, 1), ("B", 300, 0)}
    assert [(r.id, r.rule) for r in quality.validate_distribution(rows).collect()] == [("test.csv:B", "count")]


def test_moves_are_read_square_by_square(spark):
    from tallywright.operators import boards

    moves = ["8G FOX", "E9 (E)R.[NY]m", " pass ", "(exch A[QU]?)", "0A HAT", "8H (HAT", "8H )", "8H ()", "8H [A", "(exch [)", "", None, "99999999999A HAT"]
    rows = boards.parse_moves(spark.createDataFrame(list(enumerate(moves)), "id int, move string")).orderBy("id").collect()
    assert [r.kind for r in rows] == ["play", "play", "pass", "exchange", *[None] * 9]
    assert [tuple(q) for q in rows[0].squares] == [(7, 6, "F", False), (7, 7, "O", False), (7, 8, "X", False)]
    assert [tuple(q) for q in rows[1].squares] == [(8, 4, "E", True), (9, 4, "R", False), (10, 4, None, True), (11, 4, "NY", False), (12, 4, "m", False)]
    assert rows[3].tiles == ["A", "QU", "?"] and rows[1].direction == "down" and rows[4].squares is None
    assert boards.placed_squares(boards.parse_moves(spark.createDataFrame([], "id int, move string"))).count() == 0


def test_fields_of_positions(spark):
    from tallywright.operators import boards

    good = ["A1/[NY]b AB?/ -3/20 1 lex X;", "2/2 / 0/0 0"]
    bad = ["A1/2 AB/ 0/0", "A1/3 / 0/0 0", "A0/2 / 0/0 0", "2/2 A / 0/0 0", "2/2 A/[] 0/0 0", "2/2 / 0/1.5 0", "2/2/2 / 0/0 0", "99999999999/2 / 0/0 0", "", None]
    rows = boards.position_fields(spark.createDataFrame(list(enumerate(good + bad)), "record_id int, position string")).orderBy("record_id").collect()
    assert [r.readable for r in rows] == [True, True] + [False] * len(bad)
    assert (rows[0].rack1, rows[0].rack2, rows[0].score1, rows[0].score2, rows[0].zeros) == (["A", "B", "?"], [], -3, 20, 1)
    assert all(r.rack1 is None and r.zeros is None for r in rows[2:])
    squares = boards.board_squares(spark.createDataFrame([(1, good[0])], "record_id int, position string"))
    assert sorted(map(tuple, squares.collect())) == [(1, 0, 0, "A"), (1, 1, 0, "NY"), (1, 1, 1, "b")]
