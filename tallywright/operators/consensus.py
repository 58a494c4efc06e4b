"""Consensus of several analyses per key, and what to analyse again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def standing(results: Column, top: Column, runner_up: Column, margin: Column, most: Column) -> tuple[Column, Column]:
    """Whether the analyses agree, and whether the key is settled."""
    agreed = (top - runner_up >= margin) | ((most <= 1) & (runner_up == 0))
    return agreed, agreed | (results >= most)


def votes(records: DataFrame) -> DataFrame:
    """(job_id, rack, results, top_move, top_count, runner_up_count); equal counts go to the first move by name."""
    counts = records.groupBy("job_id", "rack", "top_move").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("job_id", "rack").orderBy(F.desc("n"), "top_move"))
    return (
        counts.withColumn("place", place)
        .groupBy("job_id", "rack")
        .agg(
            F.sum("n").alias("results"),
            F.max(F.when(F.col("place") == 1, F.col("top_move"))).alias("top_move"),
            F.max(F.when(F.col("place") == 1, F.col("n"))).alias("top_count"),
            F.coalesce(F.max(F.when(F.col("place") == 2, F.col("n"))), F.lit(0)).alias("runner_up_count"),
        )
    )


def key_consensus(records: DataFrame, margin: int, most: int) -> DataFrame:
    """The vote of each key with agreed, settled and without (settled, not agreed)."""
    rows = votes(records)
    agreed, settled = standing(F.col("results"), F.col("top_count"), F.col("runner_up_count"), F.lit(margin), F.lit(most))
    return rows.withColumns({"agreed": agreed, "settled": settled, "without": settled & ~agreed})


def restate_consensus(standings: DataFrame, margin: int, most: int) -> DataFrame:
    """Keys whose stored flags change under new settings."""
    agreed, settled = standing(F.col("results"), F.col("top_count"), F.col("runner_up_count"), F.lit(margin), F.lit(most))
    rows = standings.withColumns({"new_settled": settled, "new_without": settled & ~agreed})
    return rows.filter(~F.struct("new_settled", "new_without").eqNullSafe(F.struct("settled", "without"))).select("job_id", "rack", "settled", "without", "new_settled", "new_without")


def consensus_tally(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per job: change in analysed, settled and without between two standings; may be negative."""
    flags = lambda df, sign: df.select("job_id", F.lit(sign).alias("analysed"), (F.col("settled").cast("int") * sign).alias("settled"), (F.col("without").cast("int") * sign).alias("without"))
    return flags(before, -1).unionByName(flags(after, 1)).groupBy("job_id").agg(*(F.sum(c).alias(c) for c in ("analysed", "settled", "without")))


def next_reanalysis(standings: DataFrame, in_flight: DataFrame, seen: DataFrame, batch: int) -> DataFrame:
    """The next keys: unsettled, not in flight, fewest results first in a window of four batches, unseen ones preferred."""
    open_keys = standings.filter("not settled").join(in_flight.filter("rack is not null").select("rack").distinct(), "rack", "left_anti")
    window = open_keys.select("rack", "results").orderBy("results", "rack").limit(4 * batch)
    marked = window.join(seen.select("rack", F.lit(1).alias("seen")).distinct(), "rack", "left").fillna(0, ["seen"])
    return marked.orderBy("seen", "results", "rack").limit(batch)


def first_analyses(records: DataFrame) -> DataFrame:
    """The first record of each rack of a job."""
    return records.groupBy("job_id", "rack").agg(F.min("record_id").alias("record_id"))


def first_pass_leaders(records: DataFrame, moves: DataFrame, top: int) -> DataFrame:
    """The `top` best moves of each rack's first analysis, as an array in rank order."""
    rows = first_analyses(records).join(moves.filter(F.col("rank") <= top), "record_id")
    return rows.groupBy("job_id", "rack").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "move"))), lambda m: m["move"]).alias("leaders"))
