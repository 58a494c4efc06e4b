"""Next work, draws, exports, purges and details, on small tables made for the purpose."""

import bisect
import json
import random
import time
from collections import Counter

from pyspark.sql import functions as F

from tallywright.operators import coverage, feeds, jobs, ops, outcomes, quality

PROGRESS = "generation long, rack long, n long"


def test_modes_of_selection(spark):
    rows = [(1, r, 5 if r < 8 else 50) for r in range(20)] + [(2, r, r % 7) for r in range(30)] + [(3, r, 9 - r) for r in range(4)] + [(4, 1, 99)]
    cursors = spark.createDataFrame([(1, 4), (2, 29)], "generation long, cursor long")
    busy = spark.createDataFrame([(3, 3), (3, None), (2, 0)], "generation long, rack long")
    found = coverage.select_coverage(spark.createDataFrame(rows, PROGRESS), [10, 10, 10, 10], cursors, busy, 3, switch=5).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.generation, r.place)):
        by.setdefault((r.generation, r.mode), []).append(r.rack)
    # the lap of 1 goes on; that of 2 is over, and a new one begins as there is much left; of 3 the lowest come, without what is busy
    assert by == {(1, "sweep"): [5, 6, 7], (2, "lap"): [0, 1, 2], (3, "tail"): [2, 1, 0]}
    late = coverage.select_coverage(spark.createDataFrame(rows, PROGRESS), [10], cursors.filter("generation = 2"), busy, 3, switch=100).filter("generation = 2").orderBy("place").collect()
    assert [(r.mode, r.rack) for r in late] == [("tail", 7), ("tail", 14), ("tail", 21)]


def test_draws_reach_every_record_alike(spark):
    rows = [(t, 100 * t + i) for t in range(1, 9) for i in range(t)]
    records = spark.createDataFrame(rows, "task long, record_id long")
    found = feeds.random_records(records, 3600, 5).collect()
    assert len(found) == 3600 and all(r.record_id == 100 * r.task + r.offset for r in found)
    counts = Counter(r.record_id for r in found)
    assert set(counts) == {i for _, i in rows} and 50 < min(counts.values()) and max(counts.values()) < 160
    again = feeds.random_records(records.repartition(5), 3600, 5)
    assert {(r.draw, r.record_id) for r in again.collect()} == {(r.draw, r.record_id) for r in found}
    assert feeds.random_records(records.limit(0), 3, 5).collect() == []


def test_next_keys_in_many_slices(spark):
    rng = random.Random(5)
    keys = sorted({rng.choice([rng.randrange(-50, 50), rng.randrange(5000), rng.randrange(2**40)]) for _ in range(400)})
    probes = [rng.choice([rng.randrange(-99, 99), rng.randrange(6000), rng.randrange(2**41), rng.choice(keys), keys[-1] + 1]) for _ in range(2000)]
    expected = Counter((p, keys[bisect.bisect_left(keys, p) % len(keys)]) for p in probes) + Counter({(None, keys[0]): 1})
    held = spark.createDataFrame([(k,) for k in [*keys, *keys, None]], "rack long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = feeds.next_key(held, spark.createDataFrame([(p,) for p in [*probes, None]], "probe long")).collect()
        none = feeds.next_key(held.limit(0), spark.createDataFrame([(1,), (2,)], "probe long")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert Counter((r.probe, r.rack) for r in found) == expected
    assert {(r.probe, r.rack) for r in none} == {(1, None), (2, None)}


def test_probes_behind_the_last_key_dont_take_the_square_of_their_number(spark):
    began = time.time()
    found = feeds.next_key(spark.range(5, 9).toDF("rack"), spark.range(9, 500_000).toDF("probe"))
    assert [tuple(r) for r in found.groupBy("rack").count().collect()] == [(5, 499_991)]
    assert time.time() - began < 60


def test_lines_come_one_by_one(spark):
    lines = list(feeds.line_stream(spark.createDataFrame([(1, None), (2, "x")], "a long, b string").coalesce(1)))
    assert [json.loads(x) for x in lines] == [{"a": 1, "b": None}, {"a": 2, "b": "x"}] and all(x.endswith("\n") for x in lines)


def test_purges_are_safe_to_repeat(spark, tmp_path):
    folder, names = str(tmp_path), ["a", "b"]
    tables = {n: spark.createDataFrame([(i, j) for i, j in enumerate([1, 2, 17, None, 3, 1, 18] * 5)], "id long, job_id long") for n in names}
    ops.stored_tables(tables, folder)
    state = lambda: {n: sorted((r.id, str(r.job_id)) for r in df.collect()) for n, df in ops.current_tables(spark, folder, names).items()}
    whole = state()
    # a purge that broke off after its first table changes nothing
    tables["a"].limit(0).withColumn("bucket", F.lit(1)).write.parquet(f"{folder}/a/version=1/bucket=1")
    assert state() == whole
    ops.purge_tables(spark, folder, names, [1, 2], 1)
    once = state()
    assert once == {n: [x for x in rows if x[1] not in ("1", "2")] for n, rows in whole.items()}
    ops.purge_tables(spark, folder, names, [1, 2], 1)
    assert state() == once
    ops.purge_tables(spark, folder, names, [17], 2)
    assert state() == {n: [x for x in rows if x[1] != "17"] for n, rows in once.items()}


def test_details_of_a_job_without_anything(spark):
    rows = spark.createDataFrame([(1, "leave_gen", "completed", 5), (2, "games", "active", 5)], "job_id long, job_type string, status string, first_pass long")
    tasks = spark.createDataFrame([(1, 4, "completed"), (1, 5, "completed"), (1, 6, "pending")], "job_id long, seed long, state string")
    progress = spark.createDataFrame([(1, 1, 1, 10), (1, 2, 1, 10)], "job_id long, generation long, rack long, n long")
    log = spark.createDataFrame([(1, 1, "job.completed", None)], "audit_id long, job_id long, action string, actor long").withColumn("created_at", F.timestamp_micros(F.lit(7)))
    one, two = jobs.job_details(rows, tasks, progress, log, [10]).orderBy("job_id").collect()
    assert (one.tasks, one.completed, one.first_passes, one.reissues, one.generation, one.completed_us, one.forced) == (3, 2, 1, 1, 3, 7, False)
    assert (two.tasks, two.generation, two.completed_us, two.forced) == (0, None, None, None)


def test_scores_that_round_to_nothing(spark):
    pent = {f"pent_{i}": 0 for i in range(5)}
    rows = [{"job_id": 1, "wins": 0, "losses": 0, "ties": 0, "p1_mean": None, "p2_mean": None, "spread_mean": None, **pent}, {"job_id": 2, "wins": 1, "losses": 2, "ties": 1, "p1_mean": 1.005, "p2_mean": 0.0, "spread_mean": -0.004, **pent, "pent_1": 1, "pent_2": 2}]
    df = spark.createDataFrame(rows, "job_id long, wins long, losses long, ties long, p1_mean double, p2_mean double, spread_mean double, pent_0 long, pent_1 long, pent_2 long, pent_3 long, pent_4 long")
    none, some = outcomes.score_lines(df).orderBy("job_id").collect()
    assert (none.share1, none.leader, none.points, none.pair_shares) == (None, 0, None, "0.0/0.0/0.0/0.0/0.0")
    assert (some.share1, some.share2, some.leader, some.points, some.ahead, some.spread, some.pair_shares) == ("37.50%", "62.50%", 2, "0.00", 0, "0.0", "0.0/33.3/66.7/0.0/0.0")


def test_a_registry_splits_a_table(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    found = {"x": spark.createDataFrame([(1, "b"), (1, "a"), (3, "a")], "id long, rule string"), "y": spark.createDataFrame([("2", "c")], "k string, rule string")}
    registry = quality.registered(found)
    assert {tuple(r) for r in registry.collect()} == {("x", "1", "a"), ("x", "1", "b"), ("x", "3", "a"), ("y", "2", "c")}
    split = {r.id: r.rules for r in quality.split(rows, F.col("id"), "x", registry).collect()}
    assert split == {1: ["a", "b"], 2: [], 3: ["a"]}
