import random
import zlib

import numpy as np
import pytest

from tallywright.llm.common import scratch
from tallywright.llm.encode import Encoder
from tallywright.llm.packing import Counts, Places, pack, plan, reduce_dominated
from tallywright.llm.queries import op2_best_fit_packing, op3_token_shards, word_tokenizer
from tallywright.llm.sst_output import Reader, id_of, key_of, lookup, opened, read_shards, write_shards

ODD = [None, "", " ", "Thnt, ntre. don't I'LL", "<|endoftext|> a <|startoftext|>b", "é É ß µ İ Σς 日本 \U0001f600", "á x\xa0y\x85z", "x" * 3000, "word " * 5000, "1,000.5"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_tokenizer())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_tokenizer(tokenizer):
    r = random.Random(3)
    letters = "abcXYZ éÉßµªÀ÷×ÿ́İΣσς\n\t\xa0\x85.,'\"!?0123<|>/日\U0001f600-sdtl"
    texts = [t or "" for t in ODD] + ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(r.choice("aB é!.,'") for _ in range(r.randint(0, 12))) for _ in range(3000)] + ["<|ENDOFTEXT|> x!!", "A<|endoftext|>!! B,,"]
    e = Encoder(word_tokenizer())
    e.encode(texts[:50])
    parts = [e.encode(texts[i : i + 7]) for i in range(0, len(texts), 7)]
    flat, sizes = (np.concatenate(x) for x in zip(*parts))
    for text, end, n in zip(texts, np.cumsum(sizes).tolist(), sizes.tolist()):
        assert flat[end - n : end].tolist() == ids_of(tokenizer, text)


def test_a_file_of_another_form_goes_through_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    texts = [t or "" for t in ODD] + ["plain words only", " two  blanks", "a\nb"]
    flat, sizes = Encoder(path).encode(texts)
    for text, end, n in zip(texts, np.cumsum(sizes).tolist(), sizes.tolist()):
        assert flat[end - n : end].tolist() == ids_of(whole, text)


def test_words_longer_than_a_block_and_a_full_table(tokenizer, monkeypatch):
    from tallywright.llm import encode, words

    monkeypatch.setattr(words, "BLOCK", 64)
    monkeypatch.setattr(words, "LONG", 16)
    monkeypatch.setattr(encode, "MOST_IDS", 40)
    texts = ["a" * 300 + " b", "", "c " * 200, "x" * 64, "Y!! " * 50 + "é" * 90, "one two three four five six seven eight nine ten" * 3]
    e = Encoder(word_tokenizer())
    for _ in range(3):
        flat, sizes = e.encode(texts)
        for text, end, n in zip(texts, np.cumsum(sizes).tolist(), sizes.tolist()):
            assert flat[end - n : end].tolist() == ids_of(tokenizer, text)


def packed_rows(df, expected, capacity):
    """Check pieces against the ids of each document and the places against each other; returns the number of sequences."""
    rows = df.collect()
    seen, sequences = {}, {}
    for r in rows:
        seen.setdefault(r.doc_id, {})[r.piece] = (r.start, r.length, r.ids_crc32)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: {k: (s, len(ids[s : s + capacity]), crc(ids[s : s + capacity])) for k, s in enumerate(range(0, len(ids), capacity))} for i, ids in expected.items()}
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(sequences)


def test_packing(docs, tokenizer):
    rows = list(enumerate(ODD)) + [(100 + i, "thnt ntre " * (i % 37)) for i in range(200)]
    expected = {i: [*ids_of(tokenizer, t), 0] for i, t in rows}
    n = packed_rows(pack(docs(rows), word_tokenizer(), 256), expected, 256)
    assert n - sum(map(len, expected.values())) / 256 < 2
    assert pack(docs([]), word_tokenizer()).collect() == []
    assert [(r.length, r.sequence_id >= 0) for r in pack(docs([(1, None), (1, None)]), word_tokenizer()).collect()] == [(1, True)] * 2


def test_packing_real_documents(spark, small, tokenizer):
    expected = {r.doc_id: [*ids_of(tokenizer, r.text), 0] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    n = packed_rows(op2_best_fit_packing(spark, small), expected, 2048)
    assert n <= -(-sum(map(len, expected.values())) // 2048) + 1


def best_fit_decreasing(lengths, capacity):
    spaces = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, s in enumerate(spaces) if s >= n]
        if fits:
            spaces[min(fits, key=lambda i: spaces[i])] -= n
        else:
            spaces.append(capacity - n)
    return len(spaces)


def optimum(lengths, capacity):
    """Fewest sequences by search; small instances only."""
    best = best_fit_decreasing(lengths, capacity)
    order = sorted(lengths, reverse=True)

    def search(i, spaces):
        nonlocal best
        if len(spaces) >= best:
            return
        if i == len(order):
            best = len(spaces)
            return
        for s in sorted(set(spaces)):
            if s >= order[i]:
                rest = list(spaces)
                rest.remove(s)
                search(i + 1, [*rest, s - order[i]])
        search(i + 1, [*spaces, capacity - order[i]])

    search(0, [])
    return best


def test_plans_are_as_good_as_best_fit_and_reduction_keeps_the_optimum():
    r = random.Random(8)
    for _ in range(150):
        capacity = r.choice([10, 20, 50])
        lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 9))]
        counts = {n: lengths.count(n) for n in lengths}
        runs = plan(counts, capacity)
        if lengths:
            Places(runs)
        used = sum(x.count for x in runs if x.parts)
        assert used <= best_fit_decreasing(lengths, capacity)
        held = Counts(counts)
        fixed = sum(x.count for x in reduce_dominated(held, capacity))
        rest = [n for n, c in held.left.items() for _ in range(c)]
        assert fixed + optimum(rest, capacity) == optimum(lengths, capacity)


def test_shards(spark, docs, tokenizer):
    rows = list(enumerate(ODD)) + [(-5, "negative id"), (None, "no id"), (3, "again")]
    folder = scratch(spark, "shards")
    write_shards(docs(rows), folder, word_tokenizer())
    out = read_shards(spark, folder).collect()
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    starts, at = {}, 0
    for i, t in order:
        n = len(ids_of(tokenizer, t)) + 1
        starts.setdefault(i, set()).add(at)
        at += n
    assert len(out) == len(rows) and sum(r.n_tokens for r in out) == at
    for i, t in rows:
        ids = [*ids_of(tokenizer, t), 2]
        assert any(r.doc_id == i and r.n_tokens == len(ids) and r.ids_crc32 == crc(ids) and (i == 3 or r.start in starts[i]) for r in out)
    manifest = spark.read.parquet(f"{folder}/manifest").collect()
    base = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    found = []
    for m in manifest:
        reader = Reader(opened(f"{base}/shards/{m.shard}"))
        found += [x.tolist() for x in reader.find(7)]
        assert reader.find(10**12) == []
        assert len(list(reader)) == m.n_docs == reader.n_docs
    assert found == [[*ids_of(tokenizer, ODD[7]), 2]]
    wanted = spark.createDataFrame([(i,) for i in [0, 3, 3, 7, -5, 10**12, None]], "doc_id long")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32, tuple(r.ids)) for r in lookup(wanted, folder).collect())
    assert got == sorted((i is not None, i or 0, len(x), crc(x), tuple(x)) for i, t in rows if i in (0, 3, 7, -5, None) for x in [[*ids_of(tokenizer, t), 2]])
    empty = scratch(spark, "shards")
    write_shards(docs([]), empty, word_tokenizer())
    assert read_shards(spark, empty).collect() == []
    assert lookup(wanted, empty).collect() == []


def test_every_id_is_found_through_restarts_and_blocks(tmp_path, monkeypatch):
    from tallywright.llm import sst_output

    monkeypatch.setattr(sst_output, "BLOCK", 700)
    out = opened(f"file://{tmp_path}/x.sst", True)
    writer = sst_output.Writer(out, 2)
    ids = sorted([*range(0, 4000, 3), 300, 300, 300, *([999] * 90)])
    for n, i in enumerate(ids):
        writer.add(key_of(i), np.array([n % 60000] * (n % 5), "<u2").tobytes())
    writer.close()
    out.close()
    reader = Reader(opened(f"file://{tmp_path}/x.sst"))
    assert [id_of(k) for k, _ in reader] == ids
    for i in range(-2, 4003):
        assert [x.tolist() for x in reader.find(i)] == [[n % 60000] * (n % 5) for n, x in enumerate(ids) if x == i]


def test_shard_keys_sort_like_ids():
    ids = [-(1 << 63), -1, 0, 1, 255, 256, (1 << 63) - 1]
    assert sorted(map(key_of, [None, *ids])) == list(map(key_of, [None, *ids])) and [id_of(key_of(i)) for i in [None, *ids]] == [None, *ids]


def test_shards_of_real_documents(spark, small, tokenizer):
    at, expected = 0, set()
    for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect():
        ids = [*ids_of(tokenizer, r.text), 2]
        expected.add((r.doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in op3_token_shards(spark, small).collect()} == expected
