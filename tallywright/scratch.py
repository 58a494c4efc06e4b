"""Scratch folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the session's checkpoint folder; a local session without either gets a temporary one, any other an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not base and held.isDefined():
        base = held.get()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    if held.isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sliced(rows: DataFrame, path: str, *order) -> DataFrame:
    """Rows in an order, written in slices (`slice`), ranges that follow each other; `at` grows in the order within a slice.

    Sums of slices first, then sums inside each, give running sums without one task that sees all rows of a key.
    """
    out = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(out.withColumns({"slice": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), path)


def running(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """A sliced table with the sums of values over the rows of its key so far; a key's slices are few rows."""
    earlier = W.partitionBy(key).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(key, "slice").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = rows.groupBy(key, "slice").agg(*(F.sum(v).alias(v) for v in values))
    before = sums.select(key, "slice", *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"{v}_before") for v in values))
    return rows.join(before, [key, "slice"]).withColumns({v: F.sum(v).over(inside) + F.col(f"{v}_before") for v in values}).drop(*(f"{v}_before" for v in values))
