"""From raw documents to packed token sequences: five stages, each over all that the one before kept.

language ID           documents go that have no letter, or more than half of whose mixture is in no learned language
exact dedup           one row of each text stays, that with the largest id
n-gram Jaccard join   one document of each component stays, the smallest id (five-word shingles, similarity 0.8)
decontamination       documents with a passage of an item of `benchmark` go
best-fit packing      the pieces of what is left, each with its place in a sequence of 2048 tokens

Each stage takes (spark, docs, sf_dir); all but the last return the columns of docs, whatever they are.

Edge cases: null texts and texts without a letter go in the first stage; a null id counts as the smallest one; rows that
repeat an id with other texts are judged each by its own text, and rows that repeat both are one after exact dedup; very
long texts are treated whole; empty documents give no rows, an empty benchmark drops nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallywright.llm.common import scratch, table, written
from tallywright.llm.decontam import decontaminated
from tallywright.llm.exact_dedup import exact_distinct
from tallywright.llm.jaccard import one_of_each
from tallywright.llm.langid import identified
from tallywright.llm.packing import pack
from tallywright.llm.queries import word_tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_distinct(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, word_tokenizer())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The tokenizer and the language model can't be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared scratch folder and read again."""
    folder, docs = scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
