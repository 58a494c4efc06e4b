import hashlib
import random

import numpy as np
import pyarrow as pa

from tallywright.llm.suffix_dedup import WINDOW, dedup_substrings


def brute(rows):
    out, first = {}, {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - WINDOW + 1):
            if first.setdefault(raw[s : s + WINDOW], (i, s)) != (i, s):
                gone[s : s + WINDOW] = b"\1" * WINDOW
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(gone)))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


def found(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_passages_repeats_and_edges(docs):
    r = random.Random(4)
    line = lambda n: "".join(r.choice("abc dé") for _ in range(n))
    shared = [line(n) for n in (99, 100, 101, 180, 500)]
    rows = [(i, line(r.randint(0, 200)) + r.choice(shared) + line(r.randint(0, 150)) + r.choice(shared)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "x" * 5000), (103, "x" * 99), (104, "ab" * 300), (105, "x" * 300), (106, rows[3][1]), (107, rows[3][1][50:] + "é"), (108, line(300_000))]
    rows += [(109, rows[-1][1][1000:250_000])]
    rows += [(200 + i, t) for i, t in hot_rows(40)]
    assert found(dedup_substrings(docs(rows))) == brute(rows)


def hot_rows(n, seed=9):
    """Many documents around the same two lines, so that many samples share a prefix."""
    r = random.Random(seed)
    line = lambda k: "".join(r.choice("abc d") for _ in range(k))
    shared = [line(k) for k in (120, 160)]
    return [(i, line(r.randint(0, 90)) + r.choice(shared) + line(r.randint(0, 90))) for i in range(n)]


def test_small_queues_and_segments(docs, monkeypatch, tmp_path):
    """A few kilobytes for the queues, blocks of a few tuples, texts in short segments."""
    from tallywright.llm import queues, suffix_dedup

    rows = hot_rows(60) + [(100, "x" * 900), (101, hot_rows(1)[0][1] * 8)]
    runs = suffix_dedup.runs_of([t.encode() for _, t in rows])
    raw = [t.encode() for _, t in rows]
    found = sorted((half, suffix, left, runs["text"][i], runs["run"][i], low) for i, half, low, left, suffix in suffix_dedup.samples(raw, runs, np.arange(len(runs["run"]))))
    columns = zip(*[(doc, run, half, low, left, suffix) for half, suffix, left, doc, run, low in found])
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    table = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in suffix_dedup.SAMPLE.split(", ")])

    def lost(limit, groups, width):
        blocks = iter([table.slice(i, width) for i in range(0, table.num_rows, width)])
        out = {}
        for members, bits in suffix_dedup.lost_windows(blocks, str(tmp_path / "queues"), limit, groups):
            for m, b in zip(members, bits.tolist()):
                key = (int(m["doc"]), int(m["run"]), int(m["half"]))
                out[key] = out.get(key, 0) | b
        return out

    plain = lost(1 << 24, 1 << 16, 10_000)
    monkeypatch.setattr(queues, "BLOCK", 16)
    small = lost(4096, 1, 7)
    assert plain and small == plain and not list((tmp_path / "queues").iterdir())
    for name, value in (("SEGMENT", 64), ("TOGETHER", 500)):
        monkeypatch.setattr(suffix_dedup, name, value)
    expected = brute(rows)
    for i, x in enumerate(raw):  # what one text repeats of itself, in segments
        _, starts, ends = suffix_dedup.removal([x], [None], [None])
        assert (len(x), int((ends - starts).sum()), len(starts)) == brute([(0, rows[i][1])])[0][:3]
    assert expected


def test_induced_order_and_common_prefixes(tmp_path, monkeypatch):
    """At every level the tuples stand in the order of their suffixes, with the length that neighbours share."""
    from tallywright.llm import induction, queues

    r = random.Random(2)
    width, levels = 12, 9
    texts = [bytes(r.choice(b"ab") for _ in range(levels + width)) for _ in range(400)]
    kind = induction.tuples(levels)
    rows = sorted(range(len(texts)), key=lambda i: texts[i][levels:])
    common = lambda x, y: next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
    start = np.zeros(len(rows), kind)
    for n, i in enumerate(rows):
        start[n]["doc"], start[n]["high"], start[n]["low"] = i, r.randint(0, levels), 0
        start[n]["left"] = np.frombuffer(texts[i][:levels][::-1], np.uint8)
        start[n]["lcp"] = common(texts[rows[n - 1]][levels:], texts[i][levels:]) if n else 0
    seen = {}
    for block, limit in ((1 << 14, 1 << 24), (8, 2048)):
        monkeypatch.setattr(queues, "BLOCK", block)
        seen = {}
        for _ in induction.induced(iter(start[k : k + block] for k in range(0, len(start), block)), levels + 1, limit, str(tmp_path / "q"), lambda d, b: seen.setdefault(d, []).append(b)):
            pass
        for d, blocks in seen.items():
            all_ = np.concatenate(blocks)
            names = [texts[x][levels - d :] for x in all_["doc"].tolist()]
            assert sorted(all_["doc"].tolist()) == [i for i in range(len(texts)) if start["high"][rows.index(i)] >= d] and names == sorted(names)
            assert all_["lcp"].tolist() == [0 if not n or names[n - 1][0] != x[0] and d else common(names[n - 1], x) if n else 0 for n, x in enumerate(names)]
        assert len(seen) == levels + 1


def test_real_documents(spark, small):
    from tallywright.llm.queries import op1_suffix_dedup

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert found(op1_suffix_dedup(spark, small)) == brute(rows)


def test_empty_table_null_id_and_rows_that_repeat_an_id(docs):
    assert dedup_substrings(docs([])).collect() == []
    r = random.Random(1)
    text = "".join(r.choice("abcdef ") for _ in range(250))
    out = dedup_substrings(docs([(None, text), (5, text), (5, text)])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in out) == [(-1, 0), (5, 250), (5, 250)]
