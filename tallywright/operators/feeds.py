"""Feeds, lookups and samples, partners of positions, and nested exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import scratch, sliced, written


def keyset_page(rows: DataFrame, at: str, key: str, before: tuple | None, limit: int) -> DataFrame:
    """The newest rows behind the key (at, key), newest first."""
    if before is not None:
        t, k = before
        rows = rows.filter((F.col(at) < t) | ((F.col(at) == t) & (F.col(key) < k)))
    return rows.orderBy(F.desc(at), F.desc(key)).limit(limit)


def results_feed(results: DataFrame, jobs: DataFrame, before: tuple | None, limit: int) -> DataFrame:
    """Newest results with their job's type and name; the page is cut before the join."""
    return keyset_page(results, "submitted_at", "result_id", before, limit).join(jobs.select("job_id", "job_type", "p1_name", "p2_name"), "job_id")


def progress_feed(progress: DataFrame, after: tuple | None, limit: int) -> DataFrame:
    """Progress by generation downwards and key upwards, behind a key; pages cross generations."""
    if after is not None:
        g, k = after
        progress = progress.filter((F.col("generation") < g) | ((F.col("generation") == g) & (F.col("rack") > k)))
    return progress.orderBy(F.desc("generation"), "rack").limit(limit)


def rack_lookup(records: DataFrame, moves: DataFrame, rack, budget: int = 32767) -> DataFrame:
    """Analyses of a rack, numbered in record order per job, with their moves within the budget shared by all of them."""
    found = records.filter(F.col("rack") == rack).withColumn("analysis", F.dense_rank().over(W.partitionBy("job_id", "rack").orderBy("record_id")))
    share = found.withColumn("each", F.floor(budget / F.count("*").over(W.partitionBy("rack"))))
    return share.join(moves, "record_id").filter(F.col("rank") <= F.col("each")).select("job_id", "record_id", "analysis", "rank", "move", "score")


def rack_samples(records: DataFrame, k: int, seed: int) -> DataFrame:
    """k keys drawn by a seeded hash: the same for the same rows, however they lie."""
    keys = records.select("rack").distinct().withColumn("draw", drawn(seed, F.col("rack")))
    return keys.orderBy("draw", "rack").limit(k).select("rack")


def next_key(keys: DataFrame, probes: DataFrame) -> DataFrame:
    """Forward as-of join: the first key at or after each probe, else the first key of all.

    Probes and keys are cut into slices, ranges of both in order. The least key so far, from a slice's end backwards, is what
    a probe meets; one with no key behind it in its slice takes the least key of the slices that follow.
    """
    held = keys.filter("rack is not null").select(F.col("rack").alias("place"), F.col("rack").alias("key")).distinct()
    asked = probes.select(F.col("probe").alias("place"), F.lit(None).cast("long").alias("key"))
    rows = sliced(held.unionByName(asked), scratch(keys.sparkSession, "next-key"), F.col("place").asc_nulls_first(), F.col("key").asc_nulls_first())
    backwards = W.partitionBy("slice").orderBy(F.desc("at")).rowsBetween(W.unboundedPreceding, W.currentRow)
    after = W.orderBy(F.desc("slice")).rowsBetween(W.unboundedPreceding, -1)
    least = rows.groupBy("slice").agg(F.min("key").alias("least"))  # a row a slice
    later = least.select("slice", F.coalesce(F.min("least").over(after), F.min("least").over(W.partitionBy())).alias("later"))
    found = rows.withColumn("met", F.min("key").over(backwards)).filter("key is null")
    return found.join(F.broadcast(later), "slice").select(F.col("place").alias("probe"), F.coalesce("met", "later").alias("rack"))


def by_keys(positions: DataFrame, keys: DataFrame) -> DataFrame:
    """Positions by given keys (task, game_index, turn), for as many keys as there are; a key that is given twice counts once."""
    return positions.join(keys.select("task", "game_index", "turn").distinct(), ["task", "game_index", "turn"], "left_semi")


def line_stream(rows: DataFrame):
    """Lines of an export one after another, for a reader: a partition at a time reaches the driver, never the whole."""
    for row in rows.select(json_line(rows).alias("line")).toLocalIterator(prefetchPartitions=False):
        yield row["line"] + "\n"


def partners(positions: DataFrame) -> DataFrame:
    """Positions with the position of the pair's other game at the same task and turn, as a struct (null without one)."""
    other = positions.select("task", "turn", F.col("game_index").bitwiseXOR(F.lit(1).cast("long")).alias("game_index"), F.struct("record_id", "rack").alias("partner"))
    return positions.join(other, ["task", "turn", "game_index"], "left")


def without_repeats(positions: DataFrame, paired: bool = True) -> DataFrame:
    """Drop an odd game's position if the game before it has the same turn and rack in the same task."""
    if not paired:
        return positions
    before = positions.select("task", "turn", "rack", (F.col("game_index") + 1).alias("game_index"))
    return positions.filter("game_index % 2 = 0").unionByName(positions.filter("game_index % 2 = 1").join(before, ["task", "turn", "rack", "game_index"], "left_anti"))


def nested_records(records: DataFrame, moves: DataFrame, consensus: DataFrame) -> DataFrame:
    """Records with their moves in rank order and the consensus of their rack, one row each."""
    each = moves.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("rank", "move", "score"))).alias("moves"))
    agreed = consensus.select("job_id", "rack", F.struct("top_move", "settled").alias("consensus"))
    empty = F.array().cast("array<struct<rank:bigint,move:string,score:bigint>>")
    return records.join(each, "record_id", "left").join(agreed, ["job_id", "rack"], "left").withColumn("moves", F.coalesce("moves", empty))


def nested_moves(moves: DataFrame, plies: DataFrame, at_most: int, below: int) -> DataFrame:
    """(record_id, moves): the first moves of each record in rank order, each with its plies below a bound in order; both are cut before they are gathered."""
    few = moves.filter(F.col("rank") <= at_most)
    held = plies.filter((F.col("ply") < below) & (F.col("rank") <= at_most)).groupBy("record_id", "rank").agg(F.array_sort(F.collect_list(F.struct("ply", "play", "score"))).alias("plies"))
    rows = few.join(held, ["record_id", "rank"], "left").withColumn("plies", F.coalesce("plies", F.array().cast("array<struct<ply:bigint,play:string,score:bigint>>")))
    return rows.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("rank", "move", "plies"))).alias("moves"))


def cursor_text(at: Column) -> Column:
    """A time as the text of a page's cursor: microseconds since the epoch."""
    return F.unix_micros(at).cast("string")


def cursor_time(text: Column) -> Column:
    """The time of a cursor's text; null for a negative one and for what isn't a number."""
    micros = text.try_cast("long")
    return F.when(micros >= 0, F.timestamp_micros(micros))


def json_line(rows: DataFrame) -> Column:
    """A row as one JSON object, with its nulls."""
    return F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})


def export_ndjson(rows: DataFrame, path: str) -> DataFrame:
    """Write one JSON object a line, compressed; returns the manifest: file, bytes, SHA-256 and rows."""
    rows.select(json_line(rows).alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)
    return export_manifest(rows.sparkSession, path)


def export_manifest(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    lines = spark.read.text(path, pathGlobFilter="*.gz").groupBy(F.input_file_name().alias("path")).agg(F.count("*").alias("rows"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("file", name).join(lines.withColumn("file", name).select("file", "rows"), "file", "left").select("file", "bytes", "sha256", F.coalesce("rows", F.lit(0)).alias("rows"))


def export_finality(jobs: DataFrame, claims: DataFrame, staged: DataFrame) -> DataFrame:
    """A job's export is final if the job is completed, no claim is open and nothing is staged."""
    busy = claims.filter("state = 'claimed'").select("job_id").unionByName(staged.select("job_id")).distinct()
    return jobs.join(busy.select("job_id", F.lit(True).alias("busy")), "job_id", "left").select("job_id", ((F.col("status") == "completed") & F.col("busy").isNull()).alias("final"))


def drawn(seed: int, *what) -> Column:
    """A number below 2^60 from a seed and columns, by MD5: the same wherever that is at hand."""
    text = F.concat_ws(":", F.lit(str(seed)), *(x.cast("string") for x in what))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def random_records(records: DataFrame, draws: int, seed: int) -> DataFrame:
    """(draw, task, offset, record_id) of `draws` records, each as likely as any other, in two stages: a task by its weight, then a place in it.

    Tasks lie one behind the other, each as long as it has records; a draw falls on a place, its task is found by the sums
    before it, and what is left over is the record's offset in the order of record_id. Tasks are summed in slices, so no
    task sees all sums; draws are few.
    """
    spark = records.sparkSession
    tasks = records.groupBy("task").agg(F.count("*").alias("n"))
    tasks = written(tasks.repartitionByRange("task").withColumn("slice", F.spark_partition_id()), f"{scratch(spark, 'draws')}/tasks")
    order = W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)  # a row for each slice
    slices = tasks.groupBy("slice").agg(F.sum("n").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(order), F.lit(0)))
    total = slices.agg(F.sum("held").alias("total"))
    asked = spark.range(draws).select(F.col("id").alias("draw"), drawn(seed, F.col("id")).alias("u")).crossJoin(total).select("draw", (F.col("u") % F.col("total")).alias("at"))
    # draws find their slice among the slices, then their task inside it
    asked = asked.join(slices, (F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("held"))).select("draw", "at", "slice")
    inside = W.partitionBy("slice").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    starts = tasks.join(slices.select("slice", "before"), "slice").select("slice", "task", "n", (F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("start"))
    picked = asked.join(starts, "slice").filter((F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + F.col("n"))).select("draw", "task", (F.col("at") - F.col("start")).alias("offset"))
    place = F.row_number().over(W.partitionBy("task").orderBy("record_id")) - 1
    found = records.join(picked.select("task").distinct(), "task", "left_semi").select("task", "record_id", place.cast("long").alias("offset"))
    return picked.join(found, ["task", "offset"]).select("draw", "task", "offset", "record_id")


EMPTY_MOVES = "array<struct<rank:bigint,move:string,score:bigint,plies:array<struct<ply:bigint,play:string,score:bigint>>>>"


def nested_export(records: DataFrame, moves: DataFrame, plies: DataFrame, inference: DataFrame, consensus: DataFrame, at_most: int, below: int) -> DataFrame:
    """Records with moves that hold plies, with their inference and its leaves, and with the consensus of their rack: (record_id, job_id, rack, moves, inference, consensus).

    Moves and plies are cut to the recorded caps before they are gathered: the first `at_most` moves, plies below `below`.
    inference: record_id, total_draws, leave, draws, equity; most draws first, then by leave. What a record hasn't got is an
    empty list of moves, and null else. Each level is one aggregation with its parent's key, the last one with the record's.
    """
    held = plies.filter((F.col("ply") < below) & (F.col("rank") <= at_most)).groupBy("record_id", "rank").agg(F.array_sort(F.collect_list(F.struct("ply", "play", "score"))).alias("plies"))
    each = moves.filter(F.col("rank") <= at_most).join(held, ["record_id", "rank"], "left")
    none = F.array().cast("array<struct<ply:bigint,play:string,score:bigint>>")
    each = each.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("rank", "move", "score", F.coalesce("plies", none).alias("plies")))).alias("moves"))
    leaves = F.array_sort(F.collect_list(F.struct((-F.col("draws")).alias("order"), "leave", "draws", "equity")))
    guessed = inference.groupBy("record_id").agg(F.count("*").alias("num_leaves"), F.max("total_draws").alias("total_draws"), leaves.alias("leaves"))
    bare = F.transform("leaves", lambda x: F.struct(x["leave"].alias("leave"), x["draws"].alias("draws"), x["equity"].alias("equity")))
    guessed = guessed.select("record_id", F.struct("num_leaves", "total_draws", bare.alias("leaves")).alias("inference"))
    agreed = consensus.select("job_id", "rack", F.struct("results", "top_move", "top_count", "settled").alias("consensus"))
    rows = records.join(each, "record_id", "left").join(guessed, "record_id", "left").join(agreed, ["job_id", "rack"], "left")
    return rows.select("record_id", "job_id", "rack", F.coalesce("moves", F.array().cast(EMPTY_MOVES)).alias("moves"), "inference", "consensus")
