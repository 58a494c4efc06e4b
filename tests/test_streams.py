"""Streams that have no batch twin, and rules that stand-ins don't break."""

import datetime
import random

from pyspark.sql import functions as F

from tallywright.functions.scoring import PENT
from tallywright.operators import outcomes, quality
from tallywright.plans import QUERIES
from tallywright.plans.catalogue import Tables
from tallywright.sources import messages
from tallywright.streaming import streams, timers

def at(minute):
    return datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=minute)


MESSAGE = "key long, kind int, ms long, deadline long"


def told(spark, folder, batches, make):
    """What a stream of message batches tells, in any order."""
    for rows in batches:
        spark.createDataFrame(rows, MESSAGE).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    with timers.native_state(spark):
        streams.drained(make(stream), folder)
    return sorted(tuple(r) for r in spark.read.parquet(f"{folder}/out").collect())


def test_messages_move_deadlines_and_lapses_are_final(spark, tmp_path):
    batches = [
        [(1, 0, 1, 500), (2, 0, 2, 500), (3, 0, 10, 100), (4, 0, 20, None), (5, 1, 30, None)],  # 5 was never opened
        [(1, 1, 90, None), (2, 2, 99, None), (3, 1, 95, None), (4, 1, 119, None)],
        [(1, 1, 189, None), (3, 1, 150, None), (2, 1, 195, None), (4, 1, 260, None)],  # 3 is past its deadline; 4 was silent for more than 100
        [(1, 1, 280, None), (6, 0, 281, 290), (6, 1, 289, None), (6, 2, 400, None)],
        [(9, 1, 10_000, None)],
        [(9, 1, 10_001, None)],
    ]
    found = told(spark, str(tmp_path), batches, lambda s: timers.lapses(s, 100, 50))
    assert found == [(1, 380, False), (3, 150, True), (4, 219, False), (6, 340, True)]


def by_rule(rows, silent, grace):
    """(key, lapsed_ms, overran) of the keys that lapse, a message after the other."""
    found = []
    for key in {r[0] for r in rows}:
        last = deadline = None
        for _, kind, ms, new in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            due = None if last is None else last + silent if deadline is None else min(last + silent, deadline + grace)
            if due is not None and (ms > due or kind == timers.CLOSED):
                if ms > due:
                    found.append((key, due, deadline is not None and last + silent >= deadline + grace))
                break
            if last is not None or kind == timers.OPENED:
                last, deadline = ms, new if kind == timers.OPENED else deadline
        else:
            if last is not None:
                due = last + silent if deadline is None else min(last + silent, deadline + grace)
                found.append((key, due, deadline is not None and last + silent >= deadline + grace))
    return sorted(found)


def test_many_keys_lapse_by_few_states(spark, tmp_path):
    rng = random.Random(7)
    rows = [(key, rng.choice([0, 0, 1, 1, 1, 2]), ms := rng.randrange(6000), rng.choice([None, ms + rng.randrange(300)])) for key in range(2000) for _ in range(rng.randrange(1, 9))]
    rows += [(2**53 + i, 0, 50 + i, 2**53 + 1) for i in range(4)] + [(i, k, 6000 + 40 * k, None) for i in range(0, 2000, 7) for k in (0, 1, 1, 2)]
    rows = [(*r[:3], r[3] if r[1] == timers.OPENED else None) for r in rows]
    edges = [0, 40, 700, 701, 2500, 4100, 5990, 7000]
    batches = [[r for r in rows if a <= r[2] < b] for a, b in zip(edges, edges[1:], strict=False)] + [[(-1, 1, 9000, None)], [(-1, 1, 9001, None)]]
    for part in batches:
        spark.createDataFrame(part, MESSAGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = timers.lapses(spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), 400, 50)
    with timers.native_state(spark):
        query = stream.writeStream.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{tmp_path}/out").start()
        query.awaitTermination()
    found = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert found == by_rule(rows, 400, 50) and len(found) > 1000
    # a call of the store for each key would take most of the time
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 64


def test_slices_and_batches_grow_with_messages(spark, tmp_path, monkeypatch):
    from tallywright.plans import streams as plans

    monkeypatch.setattr(plans, "FILE_ROWS", 50)
    monkeypatch.setattr(plans, "BATCHES", 5)
    messages = spark.range(1000).select(F.col("id").alias("key"), F.lit(0).alias("kind"), (F.col("id") * 7 % 1000).alias("ms"), F.lit(None).cast("long").alias("deadline"))
    stream, slices = plans.timed(spark, messages, f"{tmp_path}/in")
    assert slices >= 20
    seen = []
    streams.drained(stream, str(tmp_path), lambda rows, batch: seen.append(sorted(r.ms for r in rows.collect())))
    assert [x for part in seen for x in part] == [*range(1000), *(999 + d * plans.DAY for d in (10, 11))] and len(seen) >= 5


def test_updates_are_put_together(spark, tmp_path):
    batches = [[(1, 1, t, None) for t in (5, 7, 12)] + [(2, 1, 3, None)], [(1, 1, t, None) for t in (18, 31)], [(9, 1, 900, None)], [(9, 1, 901, None)]]
    found = told(spark, str(tmp_path), batches, lambda s: timers.coalesced(s, 10))
    assert [x for x in found if x[0] != 9] == [(1, 0, 2), (1, 10, 4), (1, 30, 5), (2, 0, 1)]


def test_the_store_of_states_is_put_back(spark):
    held = spark.conf.get(timers.PROVIDER)
    with timers.native_state(spark):
        assert spark.conf.get(timers.PROVIDER) == timers.ROCKSDB
    assert spark.conf.get(timers.PROVIDER) == held


def test_states_lie_in_no_more_partitions_than_slices_need(spark):
    held = spark.conf.get(timers.SHUFFLE)
    with timers.native_state(spark, 2):
        assert spark.conf.get(timers.SHUFFLE) == "2"
    with timers.native_state(spark, 1000):
        assert spark.conf.get(timers.SHUFFLE) == held
    assert spark.conf.get(timers.SHUFFLE) == held


def test_merge_is_the_same_when_a_batch_runs_again(spark, tmp_path):
    first = spark.createDataFrame([(1, 10, 0, 0)], "generation long, rack long, n long, equity_cents long")
    staged = spark.createDataFrame([(1, 5, [10, 11], [2, 9], [200, 900])], "generation long, submission long, rack array<long>, n array<long>, equity_cents array<long>")
    write = streams.fold_staged(str(tmp_path), first)
    write(staged, 0)
    write(staged, 0)
    write(staged, 1)
    assert [(r.rack, r.n, r.equity_cents) for r in streams.latest_progress(spark, str(tmp_path)).collect()] == [(10, 4, 400)]


def test_latched_verdicts_are_final_and_right(spark, small):
    t = Tables(spark, small)
    jobs = t.jobs.filter("job_type in ('games', 'game_pairs')")
    rows = QUERIES["stream_verdicts"](spark, small).collect()
    decided = {r.job_id for r in outcomes.monitor_matches(t.results_skewed, t.jobs).collect()}
    assert {r.job_id for r in rows} == {r.job_id for r in jobs.collect()}
    assert {r.job_id for r in rows if r.verdict} <= decided
    final = {r.job_id: r.status for r in outcomes.match_test(t.results_skewed, t.jobs).collect()}
    assert all(r.verdict for r in rows if final[r.job_id] != "running")


def test_generations_complete_and_pools_go_stale(spark):
    progress = spark.createDataFrame([(1, 1, 60), (1, 2, 70), (2, 1, 80), (2, 2, 79)], "generation long, rack long, n long")
    none = spark.createDataFrame([], "generation long")
    assert [r.generation for r in streams.complete_generations(progress, [60, 80], none, none).collect()] == [1]
    assert streams.complete_generations(progress, [60, 80], spark.createDataFrame([(1,)], "generation long"), none).collect() == []
    evidence = spark.createDataFrame([(1, 0, 1, 5), (2, 0, 1, 5)], "pool long, a long, b long, games long")
    members = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "pool long, config long")
    fitted = streams.stale_pools(streams.fingerprints(evidence, members), spark.createDataFrame([], "pool long, content decimal(38,0)"))
    assert {r.pool for r in fitted.collect()} == {1, 2}
    changed = evidence.withColumn("games", F.when(F.col("pool") == 2, 6).otherwise(F.col("games")))
    assert {r.pool for r in streams.stale_pools(streams.fingerprints(changed, members), fitted).collect()} == {2}
    assert {r.pool for r in streams.stale_pools(streams.fingerprints(evidence, members.filter("config = 0")), fitted).collect()} == {1}


def test_kinds_and_settings(spark):
    rows = spark.createDataFrame([(1, 1, "static", None, None, None, False, 0), (2, 1, "static", 50.0, None, None, False, 0), (3, 2, "sim", 50.0, 0.5, 100, True, 9), (4, 9, "odd", None, None, None, False, 0)], "record_id long, config long, analysis string, win_percentage double, blended_utility double, iterations long, has_inference boolean, plies int")
    assert {(r.record_id, r.rule) for r in quality.validate_kinds(rows).collect()} == {(2, "win_percentage_carried"), (4, "unknown_kind")}
    configs = spark.createDataFrame([(1, False, False, False, 2), (2, False, True, False, 5)], "config long, can_simulate boolean, can_solve boolean, can_infer boolean, max_plies int")
    assert {(r.record_id, r.rule) for r in quality.validate_settings(rows, configs).collect()} == {(3, "cannot_simulate"), (3, "cannot_infer"), (3, "too_deep"), (4, "unknown_player")}


def test_messages_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"claim_token": "t", "movegens": 5, "result": {"racks": [{"rack": "AAAAAAA", "count": 65, "mean": 15.44}, {"rack": "BBBBBBB", "count": 105, "mean": 7.095238}]}}\nnot json\n')
    rows = messages.read_messages(spark, str(tmp_path), "leave_gen").cache()
    assert rows.filter("_corrupt is not null").count() == 1
    deltas = messages.leave_deltas(rows.filter("_corrupt is null"), F.lit(1)).head()
    assert (deltas.rack, deltas.n, deltas.equity_cents) == (["AAAAAAA", "BBBBBBB"], [65, 105], [100360, 74500])


def test_a_quarantine_keeps_every_row_once(spark, small):
    rows = Tables(spark, small).results_faulty
    clean, bad = quality.quarantined(rows, quality.validate_results(rows), "result_id")
    assert clean.count() + bad.count() == rows.count() and bad.count() > 0 and clean.select(*PENT).count() > 0


def test_streaks_come_from_many_files(spark, small, monkeypatch):
    from tallywright.plans import streams as plans

    monkeypatch.setattr(plans, "FILE_ROWS", 100, raising=False)
    read, replayed = [], streams.replayed
    monkeypatch.setattr(streams, "replayed", lambda df, folder, *rest, **more: read.append(folder) or replayed(df, folder, *rest, **more))
    found = {r.job_id: r.longest for r in QUERIES["stream_streaks"](spark, small).collect()}
    claims = Tables(spark, small).claims.select("job_id", "state", "claimed_at", "claim_id").collect()
    runs, longest = {}, {}
    for r in sorted(claims, key=lambda r: (r.claimed_at, r.claim_id)):
        runs[r.job_id] = runs.get(r.job_id, 0) + 1 if r.state == "abandoned" else 0 if r.state == "completed" else runs.get(r.job_id, 0)
        longest[r.job_id] = max(longest.get(r.job_id, 0), runs[r.job_id])
    assert found == longest
    sizes = [r.n for r in spark.read.parquet(read[0]).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= len(claims) // 100 and max(sizes) < 200


def test_streaks_join_slices_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(job, i, at(i // 2), "abandoned" if rng.random() < 0.75 else rng.choice(["completed", "declined"]), i // 6) for i in range(120) for job in (1, 2, 3)]
    rows += [(4, i, at(i), "abandoned", i // 6) for i in range(60)] + [(5, 0, at(0), "completed", 0), (5, 7, at(7), "completed", 1), (5, 8, None, "abandoned", 2)]
    write = streams.fold_streaks(str(tmp_path))
    for batch, slices in enumerate(([7, 3, 11], [0, 19, 4, 8], [i for i in range(20) if i not in (7, 3, 11, 0, 19, 4, 8)])):
        part = spark.createDataFrame([r for r in rows if r[4] in slices], "job_id long, claim_id long, claimed_at timestamp, state string, slice int")
        write(part, batch)
        write(part, batch)
    expected = {}
    for job in range(1, 6):
        run = longest = 0
        for r in sorted((r for r in rows if r[0] == job), key=lambda r: r[1]):
            run = run + 1 if r[3] == "abandoned" else 0 if r[3] == "completed" else run
            longest = max(longest, run)
        expected[job] = (run, longest, longest >= 3)
    assert {r.job_id: (r.run, r.longest, r.tripped) for r in streams.streaks(spark, str(tmp_path)).collect()} == expected
