"""Exact duplicates by distributed radix partitioning, most significant bytes first.

Texts are compared after lower-casing A-Z only. Groups start as (length, first digit) and are split by successive
digits, strings of bytes that grow from level to level, until a group has one member or its texts have ended. Equal
means that every byte was compared; no digest decides anything.

Groups and rows go by numbers that the engine gives them, never by a document's id or digest, so rows that repeat an id
with other texts stay apart.

Edge cases: a null text counts as empty; repeated rows with one id count as rows, and the last of them in the engine's
order stays; a null id sorts below all others and stays only in a group of its own; a very long text has up to sixteen
digits, the longest a row of its own; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NO_ID, pieces, removed, scratch, texts_of, written

#: Bytes of the first digit, and how much longer each next one is.
FIRST, GROWTH, LEVELS = 48, 4, 16
#: Where digit 1, 2, ... starts, and behind the last one. The sixteenth level ends beyond any text that Spark can hold.
STARTS = [FIRST]
for _i in range(LEVELS):
    STARTS.append(STARTS[-1] + FIRST * GROWTH ** (_i + 1))
NORMAL = "doc_id long, n_bytes long, text_sha256 string, norm binary"


def normalised(batches):
    for batch in batches:
        for part, texts in pieces(batch):
            norm = [t.encode().lower() for t in texts]  # of bytes, lower() knows A-Z only
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(map(len, norm), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in norm]), pa.array(norm, pa.binary())],
                names=["doc_id", "n_bytes", "text_sha256", "norm"],
            )


def shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of two rows or more, with their largest row number and id and how many rows; all are gathered before the shuffle."""
    return rows.groupBy(*keys).agg(F.max("row").alias("next"), F.max("doc_id").alias("keep"), F.count("*").alias("count")).filter("count > 1")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "radix")
    texts = texts_of(docs, id_col, text_col).mapInArrow(normalised, NORMAL)
    texts = texts.withColumn("digit", F.expr(f"substring(norm, 1, {FIRST})"))
    rows = written(texts.drop("norm"), f"{folder}/rows")
    several = rows.groupBy("n_bytes", "digit").agg(F.count("*").alias("count")).filter("count > 1").drop("count")
    several = written(several, f"{folder}/several")
    alone = rows.join(several, ["n_bytes", "digit"], "left_anti").select("doc_id", "doc_id", F.lit(1).cast("long"), F.lit(True), "text_sha256")

    # texts that share length and first digit with another: one row for each digit; a level reads its own digits
    # (the first of them begins anew, so that it needs no name for what was shared before); what is shared grows with the
    # rows, so it is never broadcast, and the plan is the same at every size
    rest = texts.join(several.hint("merge"), ["n_bytes", "digit"], "left_semi")
    levels = F.expr(f"1 + {' + '.join(f'int(n_bytes > {x})' for x in STARTS[1:-1])}")
    low, high = F.lit([0, *STARTS[1:-1]]), F.lit(STARTS[1:])
    digits = F.transform(F.sequence(F.lit(1), levels), lambda k: F.struct(k.alias("level"), F.substring("norm", F.element_at(low, k) + 1, F.element_at(high, k) - F.element_at(low, k)).alias("digit")))
    rest = rest.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_bytes", "text_sha256", digits.alias("digits"))
    rest = rest.select("row", "doc_id", "n_bytes", "text_sha256", F.explode("digits").alias("d"))
    rest.select("row", "doc_id", "n_bytes", "text_sha256", "d.level", "d.digit").write.partitionBy("level").parquet(f"{folder}/digits")
    table = spark.read.schema("row long, doc_id long, n_bytes long, text_sha256 string, digit binary, level int").parquet(f"{folder}/digits")

    ended, state = [], None
    for level in range(1, LEVELS + 1):
        now, keys = table.filter(F.col("level") == level).select("row", "doc_id", "n_bytes", "digit"), ["n_bytes", "digit"]
        if state is not None:
            now, keys = now.join(state.filter(F.col("n_bytes") > STARTS[level - 1]).select("row", "group"), "row"), ["group", *keys]
        found = now.join(shared(now, keys), keys).select("row", "doc_id", "n_bytes", F.col("next").alias("group"), "keep", "count")
        state = written(found, f"{folder}/level{level}")
        ended.append(state.filter(F.col("n_bytes") <= STARTS[level]))
        if state.filter(F.col("n_bytes") > STARTS[level]).isEmpty():
            break
    members = written(table.filter("level = 1").select("row", "doc_id", "text_sha256"), f"{folder}/members")
    removed(spark, f"{folder}/digits")
    groups = ended[0]
    for x in ended[1:]:
        groups = groups.unionByName(x)
    # of rows that repeat the id that stays, one stays
    last = F.row_number().over(W.partitionBy("group", "doc_id").orderBy(F.col("row").desc())) == 1
    groups = groups.select("row", "keep", "count", ((F.col("doc_id") == F.col("keep")) & last).alias("stays"))
    grouped = members.join(groups, "row", "left").select("doc_id", F.coalesce("keep", "doc_id"), F.coalesce("count", F.lit(1).cast("long")), F.coalesce("stays", F.lit(True)), "text_sha256")
    out = alone.toDF("doc_id", "keep_id", "group_size", "kept", "text_sha256").union(grouped)
    return out.withColumns({c: F.nullif(F.col(c), F.lit(NO_ID)) for c in ("doc_id", "keep_id")})


def exact_distinct(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that stay: one of each text, that with the largest id."""
    names = docs.columns
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    kept = exact_groups(docs).filter("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_kept_id_"), F.col("text_sha256").alias("_kept_sha256_"))
    rows = docs.withColumns({"_kept_id_": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_kept_sha256_": F.sha2(lower, 256)})
    return rows.join(kept, ["_kept_id_", "_kept_sha256_"], "left_semi").dropDuplicates(["_kept_id_", "_kept_sha256_"]).select(*names)
