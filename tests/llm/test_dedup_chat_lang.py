import hashlib
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tallywright.llm import chat, exact_dedup, langid
from tallywright.llm.queries import op4_language_id, op5_chat_format, op10_exact_dedup


def lowered(text):
    return (text or "").encode().lower()


def brute_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    return sorted((i, max(g), len(g), i == max(g), hashlib.sha256(k).hexdigest()) for k, g in groups.items() for i in g)


def test_exact_groups(docs, spark, small):
    r = random.Random(2)
    base = ["", None, "É", "é", "A" * 47, "a" * 48, "a" * 49, "ab" * 200, "ab" * 200 + "c", "x" * 5000, "x" * 4999 + "y", "Word " * 30000]
    rows = [(i, r.choice(base)) for i in range(120)]
    found = lambda df: sorted((x.doc_id, x.keep_id, x.group_size, x.kept, x.text_sha256) for x in df.collect())
    assert found(exact_dedup.exact_groups(docs(rows))) == brute_groups(rows)
    real = [(x.doc_id, x.text) for x in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert found(op10_exact_dedup(spark, small)) == brute_groups(real)
    assert exact_dedup.exact_groups(docs([])).collect() == []


def test_texts_of_one_id_that_differ_in_one_digit_only(docs):
    tail = "z" * 1200
    rows = [(9, "a" + tail), (1, "a" + tail), (9, "b" + tail), (2, "b" + tail), (9, "a" + tail), (3, "b" + "z" * 1199 + "y")]
    out = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs(rows)).collect())
    assert out == [(1, 9, 3, False), (2, 9, 2, False), (3, 3, 1, True), (9, 9, 2, True), (9, 9, 3, False), (9, 9, 3, True)]


def test_exact_groups_with_repeated_and_null_ids(docs):
    out = exact_dedup.exact_groups(docs([(1, "a"), (1, "A"), (None, "b"), (2, "b"), (None, "c")])).collect()
    assert sorted((x.doc_id or 0, x.keep_id or 0, x.group_size, x.kept) for x in out) == [(0, 0, 1, True), (0, 2, 2, False), (1, 1, 2, False), (1, 1, 2, True), (2, 2, 2, True)]
    kept = exact_dedup.exact_distinct(docs([(1, "a"), (1, "b"), (2, "B"), (2, "B"), (None, "c")]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "rank", "key"]
    assert sorted((x.doc_id or 0, x.text) for x in kept.collect()) == [(0, "c"), (1, "a"), (2, "B")]


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, level string")


def test_chat_round_trip(spark):
    r = random.Random(4)
    parts = ["</s>", "[INST]", "[INST] ", "[/INST]", "\\", "\\s", "\\b", "\n", "a", "é", "\U0001f600", "0\n", "[", "/s>", "</", ""]
    rows = [(c, t, r.choice(["user", "assistant", "system", "odd</s>", "two\nlines", "\\n"]), "".join(r.choice(parts) for _ in range(r.randint(0, 8))), "x") for c in range(150) for t in range(r.randint(1, 4))]
    rows += [(900, 0, None, None, None), (901, 1, "assistant", "b", None), (901, 0, "user", "a", None), (901, 1, "assistant", "b", None)]
    out = chat.format_chats(chats(spark, rows)).collect()
    for x in out:
        source = [(role or "", text or "") for _, _, role, text in sorted((c, t, role or "", text or "") for c, t, role, text, _ in rows if c == x.conv_id)]
        assert [(t.role, t.text) for t in x.parsed] == source
        plain = all(s not in role + "\0" + text for role, text in source for s in ("</s>", "[INST]", "[/INST]")) and all("\n" not in role for role, _ in source)
        assert x.formatted.startswith("0\n") or not plain
    assert chat.format_chats(chats(spark, [])).collect() == []


def test_chat_digests(spark, small):
    out = {x.conv_id: x for x in op5_chat_format(spark, small).collect()}
    text = "</s>[INST] ok [/INST]"
    assert out[-1].n_turns == 2 and out[-1].loss_chars == len(text) and out[-1].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert out[-1].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    by = {}
    for x in sorted(spark.read.parquet(f"{small}/conversations.parquet").collect(), key=lambda x: (x.conv_id, x.turn)):
        by.setdefault(x.conv_id, []).append((x.role, x.text or ""))
    assert set(out) == {-1, *by}
    for c, turns in by.items():
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert out[c].loss_sha256 == hashlib.sha256("".join(b for a, b in turns if a == "assistant").encode()).hexdigest()


def test_language_of_held_out_documents(spark, small):
    docs = {x.doc_id: x for x in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = {x.doc_id: x for x in op4_language_id(spark, small).collect()}
    assert set(out) == set(docs)
    for i, x in out.items():
        assert x.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= x.score <= 1
    held = [i for i in docs if out[i].held_out and docs[i].lang]
    assert len(held) > 30 and np.mean([out[i].lang_pred == docs[i].lang for i in held]) > 0.97


def test_language_edges(docs, spark):
    rows = [(i, "the thing and other words of this", ) for i in range(40)] + [(100, None), (101, ""), (102, "123 .. !"), (103, "w"), (None, "the words")]
    out = {x.doc_id: (x.lang_pred, x.score, x.held_out) for x in langid.identify(docs(rows)).collect()}
    assert out[100] == out[101] == out[102] == ("und", 0.0, out[102][2]) or all(out[i][:2] == ("und", 0.0) for i in (100, 101, 102))
    assert out[103][0] == "en" and out[None][2] is False
    assert langid.identify(docs([])).collect() == []
    kept = langid.identified(docs(rows))
    assert {x.doc_id for x in kept.collect()} == {*range(40), 103, None} and "key" in kept.columns


def test_mixture_finds_both_languages():
    r = np.random.default_rng(1)
    model = r.random((langid.BUCKETS, 3)) ** 8 + 1e-6
    model /= model.sum(0)
    a, b = (r.choice(langid.BUCKETS, 2000, p=model[:, k]) for k in (0, 1))
    counts = np.bincount(np.concatenate([a, b[:1000]]), minlength=langid.BUCKETS).astype(float)
    at = np.flatnonzero(counts)
    share = langid.mixture(model[at], counts[at])
    assert share[2] == 0 and abs(share[0] - 2 / 3) < 0.05
    only = np.bincount(a, minlength=langid.BUCKETS).astype(float)
    at = np.flatnonzero(only)
    assert langid.mixture(model[at], only[at])[0] == 1


def plain_mixture(likelihood, counts):
    """The same estimate, gram by gram, without arrays."""

    def fit(kept):
        share = dict.fromkeys(kept, 1 / len(kept))
        n = sum(counts)
        for _ in range(langid.STEPS if len(kept) > 1 else 0):
            new = dict.fromkeys(kept, 0.0)
            for row, c in zip(likelihood, counts):
                all_ = sum(share[k] * row[k] for k in kept)
                for k in kept:
                    new[k] += c * share[k] * row[k] / all_ / n
            done = max(abs(new[k] - share[k]) for k in kept) < 1e-3
            share = new
            if done:
                break
        return share, sum(c * math.log(sum(share[k] * row[k] for k in kept)) for row, c in zip(likelihood, counts))

    kept = list(range(len(likelihood[0])))
    share, value = fit(kept)
    while len(kept) > 1:
        worst = min(kept, key=lambda k: share[k])
        new, other = fit([k for k in kept if k != worst])
        if other + 0.5 * math.log(max(2, sum(counts))) < value:
            break
        kept, share, value = [k for k in kept if k != worst], new, other
    return share


def test_predictions_equal_a_plain_estimate(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    languages, model = langid.learn(table, 20)
    texts = [r.text for r in table.limit(25).collect()] + ["la le und the", "é", "x" * 5, "the und les " * 30]
    found = langid.shares(texts, languages, model)
    for text, share in zip(texts, found):
        if share is None:
            assert not any(c.isalpha() for c in text or "")
            continue
        raw = "".join(chr(c).lower() if chr(c).isascii() and chr(c).isalpha() else chr(c) if c >= 128 else " " for c in f" {text} ".encode())
        counts = {}
        for i in range(len(raw) - 2):
            g = raw[i : i + 3]
            if g[1] != " " or g[0] != " " and g[2] != " ":
                code = ord(g[0]) << 16 | ord(g[1]) << 8 | ord(g[2])
                b = (code * 2654435761 & 0xFFFFFFFF) >> 18
                counts[b] = counts.get(b, 0) + 1
        plain = plain_mixture([model[b].tolist() for b in counts], list(counts.values()))
        assert all(abs(share[k] - plain.get(k, 0)) < 1e-6 for k in range(len(languages)))


def test_texts_of_no_learned_language_go(docs, spark, small):
    r = np.random.default_rng(3)
    code = "".join(r.choice(list("qxzjkvwy0123456789+/"), 400))
    foreign = ["Привет, как дела? Это просто русский текст для проверки.", "これは日本語の文章です。言語を判定します。", code]
    good = spark.read.parquet(f"{small}/documents.parquet")
    more = [(-1 - i, t) for i, t in enumerate([*foreign, None, "12 34"])]
    table = good.unionByName(docs(more).select(*good.columns[:2], F.lit(None).cast("string").alias("lang"), "source", "n_chars"))
    kept = {x.doc_id for x in langid.identified(table).select("doc_id").collect()}
    assert kept == {x.doc_id for x in good.collect() if any(c.isalpha() for c in x.text or "")}
    english = {x.doc_id for x in langid.identified(table, wanted={"en"}).select("doc_id").collect()}
    assert english < kept and english
