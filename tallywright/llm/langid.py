"""Language of whole texts as a mixture: expectation-maximisation over n-gram likelihoods.

Learning counts hashed three-byte grams per language over a bounded sample of labelled rows (SAMPLE_ROWS a language, by
hash of the id, whole texts). For a text, EM estimates the share of each language; languages are dropped one by one as
long as the likelihood, less half the logarithm of the number of grams for each language kept (as in BIC), does not
fall. The largest share names the language and is the score.

`identified` adds a component to the mixture that knows no language: every gram is as likely as any other. A text most
of which comes from there (foreign script, random letters, code tables) is in no learned language.

Edge cases: a null text or one without a letter is `und` with score 0, as is every text when there is no labelled row;
among equal shares the first language by name wins; rows that repeat an id or text give a row each; a null id is not held
out, and is not learned from; a very long text is counted block by block; other columns are left out; an empty table
gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded, pieces, scratch, written

#: Labelled rows that are learned from at most, for each language, and languages; hashed grams; steps of one fit.
SAMPLE_ROWS, LANGUAGES, BUCKETS, STEPS = 500, 512, 1 << 14, 25
#: Added to every count of a gram.
SMOOTHING = 0.5
#: Where a text must be in the learned languages, the most that may come from none of them.
MOST_UNKNOWN = 0.5
#: Parts of a language in which its sample is looked for side by side.
PARTS = 64
FOLDS, HELD_OUT = 3, 1
#: Bytes of a text that are looked at together.
BLOCK = 1 << 18
LETTER = re.compile(r"[^\W\d_]")
#: Lower-case ASCII letters and all bytes of other characters stay; everything else is a blank.
_kept = np.full(256, 32, np.uint8)
_kept[97:123] = np.arange(97, 123)
_kept[65:91] = np.arange(97, 123)
_kept[128:] = np.arange(128, 256)


def counted(text: str) -> np.ndarray:
    """How often each bucket's grams stand in a text; grams across the edges of blocks count once."""
    out, raw = np.zeros(BUCKETS, np.int64), b" " + text.encode() + b" "
    for at in range(0, len(raw) - 2, BLOCK):
        data = _kept[np.frombuffer(raw, np.uint8, min(BLOCK + 2, len(raw) - at), at)].astype(np.uint32)
        codes = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
        held = (data[1:-1] != 32) | (data[:-2] != 32) & (data[2:] != 32)
        out += np.bincount(((codes[held] * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64), minlength=BUCKETS)
    return out


def em(likelihood: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares of the columns and the log-likelihood; likelihood: gram x language."""
    n, share = counts.sum(), np.full(likelihood.shape[1], 1 / likelihood.shape[1])
    for _ in range(STEPS if len(share) > 1 else 0):
        new = share * (likelihood.T @ (counts / (likelihood @ share))) / n
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    return share, float(counts @ np.log(likelihood @ share))


def mixture(likelihood: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Shares of all languages, 0 for those that the penalised likelihood leaves out."""
    kept = np.arange(likelihood.shape[1])
    penalty = 0.5 * np.log(max(2, counts.sum()))
    share, value = em(likelihood, counts)
    while len(kept) > 1:
        without = np.delete(kept, share.argmin())
        new, other = em(likelihood[:, without], counts)
        if other + penalty < value:
            break
        kept, share, value = without, new, other
    out = np.zeros(likelihood.shape[1])
    out[kept] = share
    return out


def fold(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, languages_most: int = LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages by name and gram x language probabilities, from rows with a language outside the held-out fold.

    At most sample_rows rows of each language, the first by a hash of id and text, of at most languages_most languages, those
    with most rows in that sample, then by name.
    """
    bounded(docs.sparkSession)
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != HELD_OUT))
    # rows, not ids, are picked: an id may stand in many rows; rows that are alike count as one
    row = ["doc_id", "lang", "row"]
    labelled = labelled.select("doc_id", "lang", "text").withColumn("row", F.xxhash64("text"))
    ids = labelled.select(*row).distinct().withColumn("hash", F.xxhash64("doc_id", "row"))
    for keys in (["lang", F.pmod("hash", F.lit(PARTS))], ["lang"]):  # at most PARTS * sample_rows of a language meet
        turn = F.row_number().over(W.partitionBy(*keys).orderBy("hash", "doc_id", "row"))
        ids = ids.withColumn("turn", turn).filter(F.col("turn") <= sample_rows).drop("turn")
    ids = written(ids.select(*row), f"{scratch(docs.sparkSession, 'languages')}/rows")
    most = ids.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages_most)
    ids = ids.join(F.broadcast(most), "lang", "left_semi")  # languages_most x sample_rows rows at most
    sample = labelled.join(F.broadcast(ids), row, "left_semi").groupBy(*row).agg(F.first("text").alias("text")).select("lang", "text")

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, texts in pieces(batch):
                for lang, text in zip(part.column(0).to_pylist(), texts):
                    held[lang] = held.get(lang, 0) + counted(text)
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(counts[at])], names=["lang", "bucket", "n"])

    rows = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = rows.toPandas()  # BUCKETS rows for each language at most
    languages = sorted(table["lang"].unique())
    model = np.full((BUCKETS, len(languages)), SMOOTHING)
    model[table["bucket"], np.searchsorted(languages, table["lang"])] += table["n"]
    return languages, model / model.sum(0)


def shares(texts: list[str], languages: list[str], model: np.ndarray) -> list[np.ndarray | None]:
    """The mixture of each text; None where there is no letter or nothing was learned."""
    out = []
    for text in texts:
        share = None
        if languages and LETTER.search(text):
            counts = counted(text)
            at = np.flatnonzero(counts)
            share = mixture(model[at], counts[at].astype(float))
        out.append(share)
    return out


def predict(docs: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its text alone."""

    def infer(batches):
        for batch in batches:
            for part, texts in pieces(batch):
                found = shares(texts, languages, model)
                names = pa.array(["und" if x is None else languages[int(x.argmax())] for x in found], pa.string())
                scores = pa.array([0.0 if x is None else min(1.0, float(x.max())) for x in found], pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), names, scores], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(infer, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Learn from docs and predict all of docs: doc_id, held_out, lang_pred, score."""
    found = predict(docs, *learn(docs, sample_rows))
    return found.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, most_unknown: float = MOST_UNKNOWN, wanted: set[str] | None = None) -> DataFrame:
    """The rows of docs, all columns, with a letter and no more than this share from outside the learned languages; all rows when nothing was learned.

    wanted: languages of which one must have the largest share; all that are learned by default.
    """
    languages, model = learn(docs)
    known = np.hstack([model, np.full((BUCKETS, 1), 1 / BUCKETS)])  # the last column knows no language

    def keep(batches):
        for batch in batches:
            for part, texts in pieces(batch, batch.schema.get_field_index("text")):
                held = [x is not None and x[-1] <= most_unknown and (wanted is None or languages[int(x[:-1].argmax())] in wanted) for x in shares(texts, languages, known)]
                yield part.filter(pa.array(held, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema) if languages else docs
