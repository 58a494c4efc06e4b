"""Files that jobs need, over more documents than the smallest tables have."""

import glob
import os

from pyspark.sql import functions as F

from tallywright.operators import inputs, jobs
from tallywright.plans import QUERIES


def test_expected_data_looks_at_all_documents(spark, small, tmp_path):
    for path in glob.glob(f"{small}/*.parquet"):
        if os.path.basename(path) != "documents.parquet":
            os.symlink(path, tmp_path / os.path.basename(path))
    texts = spark.range(0, 12000, 5).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    texts.write.parquet(str(tmp_path / "documents.parquet"))
    found = {(r.job_id, r.path) for r in QUERIES["expected_data"](spark, str(tmp_path)).collect()}
    jobs = {r[0] for r in spark.read.parquet(f"{small}/orders.parquet").selectExpr("o_custkey % 40").distinct().collect()}
    owners = {j: {f"P{j % 9}", f"P{(j * 5 + 3) % 9}", f"board{int(j % 11 == 5)}"} for j in jobs}
    owner = {d: f"P{d % 12}" if d % 12 < 9 else f"board{d % 12 - 9}" for d in range(0, 12000, 5)}
    assert found == {(j, f"s/{d // 2}") for j in jobs for d in owner if owner[d] in owners[j]}


def test_inputs_are_listed_by_role(spark, tmp_path):
    for name, text in (("data/lexica/CSW24.txt", "a"), ("data/letterdistributions/english.csv", "b"), ("data/other/x", "c"), ("data/strategy/CSW24.klv", "a")):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    found = {(r.role, r.name, r.bytes) for r in inputs.list_inputs(spark, str(tmp_path)).collect()}
    assert found == {("lexicon", "CSW24.txt", 1), ("distribution", "english.csv", 1), ("leaves", "CSW24.klv", 1)}


def test_version_parts_of_any_length(spark):
    rows = spark.createDataFrame([("0.1.3",), ("12345678.0.1",), ("1.x.2",), ("-1.2.3",), ("",), (None,)], "v string")
    found = [tuple(r.k) for r in rows.select(jobs.version_key(F.col("v")).alias("k")).collect()]
    assert found == [(0, 1, 3), (12345678, 0, 1), (1, 0, 2), (0, 2, 3), (0, 0, 0), (0, 0, 0)]
