"""Secret scans with a ledger of blobs.

Every version of a text is a blob named by its SHA-256. The ledger is a Parquet table of (blob, rule, version, spans)
with a row for each pair that has been scanned, findings or not. A scan looks only at the pairs that the ledger lacks,
adds them, and joins the findings back to every path (row) that holds the blob.

Edge cases: a null text is the empty blob; a null id stays null; repeated rows and historical versions of one id each give
a row; spans that start together stand in the order of the rules; a very long text is one blob, looked at whole in one
task, once for all rows that hold it; other columns are left out; an empty table gives an empty result and an empty ledger.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces


@dataclass(frozen=True)
class Rule:
    """A raised version makes every blob unseen for this rule. group: the part that counts for at_least (0: all)."""

    kind: str
    version: int
    pattern: str
    at_least: int = 0
    group: int = 0
    flags: int = 0


#: The base kinds in the order of results, then what the method adds.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, re.I | re.A),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 16),
    Rule("pem", 1, r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
BASE = ("assign", "access", "hex")
LEDGER = "blob binary, rule string, version int, spans array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def find(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.at_least]


def update_ledger(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Scan the (blob, rule, version) triples of docs that the ledger at this path lacks; returns the whole ledger."""
    spark = docs.sparkSession
    names = {f"{r.kind}@{r.version}": r for r in rules}

    def scan(batches):
        compiled = {k: re.compile(r.pattern, r.flags) for k, r in names.items()}
        for batch in batches:
            for part, texts in pieces(batch):
                rows = [
                    (blob, names[k].kind, names[k].version, [{"start": s, "end": e} for s, e in find(names[k], compiled[k], text)])
                    for blob, text, wanted in zip(part.column(0).to_pylist(), texts, part.column(2).to_pylist())
                    for k in wanted
                ]
                kinds = (pa.binary(), pa.string(), pa.int32(), _SPANS)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["blob", "rule", "version", "spans"])

    try:
        seen = spark.read.schema(LEDGER).parquet(ledger)
        seen.head(1)
    except Exception as e:  # no ledger yet; anything else is raised
        if "PATH_NOT_FOUND" not in str(e):
            raise
        seen = spark.createDataFrame([], LEDGER)
    text = F.coalesce(F.col(text_col), F.lit(""))
    blobs = docs.select(F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    done = seen.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("done"))
    wanted = F.array_except(F.array(*map(F.lit, names)), F.coalesce("done", F.array().cast("array<string>")))
    unseen = blobs.join(done, "blob", "left").select("blob", "text", wanted.alias("wanted")).filter(F.size("wanted") > 0)
    unseen.mapInArrow(scan, LEDGER).write.mode("append").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger)


def scan_secrets(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: counts of the base kinds, digest of their spans, and all spans."""
    order = F.array_position(F.array(*(F.lit(r.kind) for r in rules)), F.col("rule"))
    version = F.element_at(F.create_map(*(F.lit(x) for r in rules for x in (r.kind, r.version))), F.col("rule"))
    held = update_ledger(docs, ledger, rules, text_col).filter(F.col("version") == version)
    spans = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), order.alias("place"), F.col("rule").alias("rule"), x["end"].alias("end")))
    of_blob = held.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(spans))).alias("all"))

    def joined(xs):
        return F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["rule"], x["start"], x["end"])), ",")

    def of(kind):
        return lambda x: x["rule"] == kind

    of_blob = of_blob.withColumn("base", F.filter("all", lambda x: x["rule"].isin(*BASE)))
    of_blob = of_blob.select(
        "blob",
        *(F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("all").alias("spans"),
    )
    paths = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("blob"))
    return paths.join(of_blob, "blob", "left").select("doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans")
