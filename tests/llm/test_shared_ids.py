"""Ids that many rows share, stores that tasks can't open, numbers as they are printed."""

import hashlib
import random
from collections import defaultdict

import pytest

from tallywright.llm import langid, pii
from tallywright.llm.common import arrow_folder
from tallywright.llm.suffix_dedup import WINDOW, dedup_substrings


def test_rows_that_share_an_id_lose_by_their_own_texts(docs):
    r = random.Random(8)
    line = lambda k: "".join(r.choice("abc d") for _ in range(k))
    shared = [line(k) for k in (110, 150, 400)]
    rows = [(i % 5, line(r.randint(0, 90)) + r.choice(shared) + line(r.randint(0, 90)) + r.choice(shared)) for i in range(60)]
    rows += [(None, line(30) + r.choice(shared)) for _ in range(20)] + [(3, rows[3][1])] * 15
    first = {}
    for i, t in rows:  # the smallest id owns a string; in its own texts, the first start keeps it
        raw, i = t.encode(), -1 if i is None else i
        for s in range(len(raw) - WINDOW + 1):
            first[raw[s : s + WINDOW]] = min(first.get(raw[s : s + WINDOW], i), i)
    expected = defaultdict(int)
    for i, t in rows:
        raw, own, gone = t.encode(), -1 if i is None else i, bytearray(len(t.encode()))
        met = set()
        for s in range(len(raw) - WINDOW + 1):
            w = raw[s : s + WINDOW]
            if first[w] < own or w in met:
                gone[s : s + WINDOW] = b"\1" * WINDOW
            met.add(w)
        expected[i, len(raw), sum(gone), hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()] += 1
    found = defaultdict(int)
    for x in dedup_substrings(docs(rows)).collect():
        found[x.doc_id, x.n_bytes, x.n_removed, x.kept_sha256] += 1
    assert found == expected


def test_a_sample_of_rows_and_not_of_ids(spark):
    rows = [(7, f"alpha beta {chr(97 + i % 26)}{chr(97 + i // 26)}x", "aa") for i in range(300)] + [(7, f"gamma delta {i}", "bb") for i in range(300)] + [(i, "the same text", "cc") for i in [1, 4] * 200] + [(8, "rare words", "dd")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, model = langid.learn(df, 20)
    assert languages == ["aa", "bb", "cc", "dd"]
    everything = langid.learn(df, 10_000)[1]
    # of "aa", some pairs of letters at the end are in the sample only; of "cc", one row for each id that isn't held out
    floor = lambda m: (m[:, 0] > m[:, 0].min() * 1.01).sum()
    assert floor(model) < floor(everything)
    assert (model[:, 2] == everything[:, 2]).all() and langid.learn(df.filter("lang <> 'cc'").unionByName(df.filter("lang = 'cc'").distinct()), 20)[1].tolist() == model.tolist()
    few, _ = langid.learn(df, 20, languages_most=2)
    assert few == ["aa", "bb"]


def test_folders_of_stores_are_named_once(spark, tmp_path):
    assert arrow_folder(spark, str(tmp_path)) == f"file://{tmp_path}" == arrow_folder(spark, f"file:{tmp_path}") == arrow_folder(spark, f"file://{tmp_path}")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.odd.link./in", f"file://{tmp_path}")
    with pytest.raises(ValueError, match="can't open"):
        arrow_folder(spark, "viewfs://odd/in")


@pytest.mark.parametrize(
    "text,spans",
    [
        ("IBAN DE89 3704 0044 0532 0130 00 AND MORE WORDS", ["iban:5:32"]),
        ("pay DE89370400440532013000.", ["iban:4:26"]),
        ("DE89 3704 0044 0532 0130 01", []),
        ("GB82 WEST 1234 5698 7654 32 GB82WEST12345698765432", ["iban:0:27", "iban:28:50"]),
        ("XDE89370400440532013000 DE89370400440532013000x", []),
    ],
)
def test_ibans_as_stored_and_as_printed(text, spans):
    assert [f"{k}:{s}:{e}" for k, s, e in pii.find(text) if k == "iban"] == spans
