import corpus_pipeline
from tallywright.llm.common import scratch, table, written

from .test_decontam import brute as leaks
from .test_jaccard import shingle_set


def test_stages_against_brute_force(spark, small):
    docs, kept = table(spark, small, "documents"), []
    folder, columns = scratch(spark, "stages"), docs.columns
    for name, stage in corpus_pipeline.STAGES:
        kept.append({x.doc_id: x.text for x in docs.collect()} if name != "packing" else kept[-1])
        docs = written(stage(spark, docs, small), f"{folder}/{name}")
        assert name == "packing" or docs.columns == columns
        if name == "decontamination":
            kept.append({x.doc_id: x.text for x in docs.collect()})
    raw, known, exact, joined, clean = kept[0], kept[1], kept[2], kept[3], kept[-1]
    assert known == {i: t for i, t in raw.items() if any(c.isalpha() for c in t or "")}
    last = {}
    for i, t in known.items():
        k = t.encode().lower()
        last[k] = max(i, last.get(k, i))
    assert set(exact) == set(last.values())
    sets = {i: shingle_set(t, 5) for i, t in exact.items()}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                a1, b1 = root(a), root(b)
                label[max(a1, b1)] = min(a1, b1)
    assert set(joined) == {i for i in ids if root(i) == i}
    bench = [(x.item_id, x.text) for x in table(spark, small, "benchmark").collect()]
    assert set(clean) == set(joined) - {d for d, _ in leaks(list(joined.items()), bench)}
    assert {x.doc_id for x in docs.collect()} == set(clean)


def test_run_returns_the_last_stage(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_stages_on_odd_rows(spark, docs, small):
    long = "and the thing of it was " * 4000
    text = "The and attion to thanedble the anea eriner thanea the of and that was " * 3
    rows = [(1, text), (1, "Another " + long), (None, text.upper()), (2, None), (3, ""), (4, "12 34"), (5, text + "x"), (5, text + "x"), (5, "That was and of the anea eriner thanea attion to thanedble")]
    kept = docs(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = written(stage(spark, kept, small), f"{scratch(spark, 'odd')}/{name}")
        assert kept.columns == docs([]).columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("1", text), ("1", "Another " + long), ("5", rows[-1][1])])
    places = corpus_pipeline.packing(spark, kept, small).collect()
    assert {r.doc_id for r in places} == {1, 5} and len({(r.sequence_id, r.offset) for r in places}) == len(places)
    nothing = docs([])
    for name, stage in corpus_pipeline.STAGES:
        nothing = written(stage(spark, nothing, small), f"{scratch(spark, 'none')}/{name}")
        assert nothing.count() == 0
