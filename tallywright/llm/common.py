"""What the operators share: reading, scratch space that every executor sees, Arrow batches in bounded pieces."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task looks at together, and of an Arrow batch on its way to Python (one row at least).
PIECE_CHARS, BATCH_BYTES = 1 << 20, 4 << 20
#: Stands for a null id inside operators: the smallest.
NO_ID = -(1 << 63)
#: Words are runs without the six ASCII blanks. Rows of a slice, where rows are counted over tasks.
WORD, SLICE = r"[^\x20\x09-\x0D]+", 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session has a bound of its own below this one."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key, None)
    if not held or not held.isdigit() or int(held) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of docs: the id as a long, NO_ID for null; batches to Python are bounded."""
    bounded(docs.sparkSession)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which a cluster shares; a local session without that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}")
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    bounded(spark)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sliced(rows: DataFrame, path: str, *order: Column, within: tuple[Column, ...] = (), slices: int = 0, drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows in an order, written in slices: ranges that follow each other, each sorted by one task.

    slice: the slice's number; at: grows in the order within a slice. Sums of slices first, then sums inside each, give
    running numbers over any order without one task that sees all rows. within: what orders rows whose `order` is the same,
    for columns that are too long for the bounds of the ranges.
    """
    slices = max(slices, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = rows.repartitionByRange(slices, *order).sortWithinPartitions(*order, *within)
    out = out.withColumns({"slice": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    return written(out.drop(*drop), path)


def pieces(batch: pa.RecordBatch, text_field: int = 1, chars: int = PIECE_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of a batch with about so many bytes of text each, and the texts of each slice ('' for null)."""
    column = batch.column(text_field)
    sizes = pa.compute.binary_length(column).fill_null(0).to_pylist()
    at = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= chars or i == len(sizes) - 1:
            part = batch.slice(at, i + 1 - at)
            yield part, [x or "" for x in part.column(text_field).to_pylist()]
            at, total = i + 1, 0


def compressed(batches):
    """(doc_id, text, ...) as (doc_id, packed, ...): texts as compressed bytes, for shuffles."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
    for batch in batches:
        for part, chunk in pieces(batch):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([pack(t.encode()) for t in chunk], pa.binary()), *part.columns[2:]], names=["doc_id", "packed", *part.schema.names[2:]])


def unpacked(batch: pa.RecordBatch):
    """Slices of a batch with compressed texts in its second column, and the texts' bytes."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for part, chunk in pieces(batch, chars=PIECE_CHARS // 3):
        yield part, [unpack(x) for x in chunk]


#: Names of a store in Spark and in Arrow where they differ.
STORES = {"s3a": "s3", "s3n": "s3"}


def arrow_folder(spark: SparkSession, folder: str) -> str:
    """The URI by which Arrow's file systems reach a folder that Spark names, on the driver and on every executor.

    Spark's own file systems say which store a folder without a scheme lies in. A store that Arrow can't open is an error
    here, before any work is done.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    scheme, rest = uri.split(":", 1)
    uri = f"file://{rest.removeprefix('//')}" if scheme == "file" else f"{STORES.get(scheme, scheme)}:{rest}"
    try:
        fs.FileSystem.from_uri(uri)
    except Exception as e:
        raise ValueError(f"{folder} is in a store that tasks can't open ({uri}: {e}); set spark.checkpoint.dir to another one") from e
    return uri


def removed(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
