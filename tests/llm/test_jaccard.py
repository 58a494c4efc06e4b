import random
import re
from itertools import combinations

import numpy as np

from tallywright.llm import jaccard
from tallywright.llm.components import components, hung
from tallywright.llm.common import scratch


def shingle_set(text, size=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) or frozenset([tuple(words)])


def brute(rows, num=9, den=10, size=3):
    """Rows by place, so that rows may repeat an id; components by the smallest id of their rows."""
    sets = {i: shingle_set(t, size) for i, (_, t) in enumerate(rows)}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and den * len(x & y) >= num * len(x | y):
            a, b = root(a), root(b)
            label[max(a, b)] = min(a, b)
    least = {}
    for i in sets:
        least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], len(sets[i]), least[root(i)]) for i in sets)


def family(seed, groups, each, words):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(groups):
        base = [r.choice(vocabulary) for _ in range(words)]
        for _ in range(each):
            text = list(base)
            for _ in range(r.randint(0, max(1, words // 40))):
                text[r.randrange(len(text))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(text)))
    return rows


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_same_components_as_brute_force(docs):
    rows = family(1, 6, 25, 120) + [(1000 + i, t) for i, t in enumerate(["", None, " \t", "One two", "one TWO", "one", "one two three", "É a b", "é a b"])]
    assert result(jaccard.jaccard_components(docs(rows))) == brute(rows)


def test_unlike_sets_that_share_a_digest_stay_apart(docs):
    rows = family(3, 5, 12, 60) + [(900 + i, f"one two three {i}") for i in range(300)] + [(2000, "one two three 7"), (2001, None)]
    for bits in (4, 12):  # all digests shared, and some
        assert result(jaccard.jaccard_components(docs(rows), bits=bits)) == brute(rows)


def test_second_digests_differ_where_first_ones_do_not():
    sets = [np.arange(i, i + 5, dtype=np.uint64) for i in range(500)]
    shared = np.array(sorted({jaccard.digest_of(x, 6) for x in sets[:250]}), np.int64)
    names = [jaccard.name_of(x, shared, 6) for x in sets]
    held = set(shared.tolist())
    taken = [n for n, x in zip(names, sets) if jaccard.digest_of(x, 6) in held]
    assert len(set(taken)) == len(taken) >= 250
    assert all(n == jaccard.digest_of(x, 6) for n, x in zip(names, sets) if jaccard.digest_of(x, 6) not in held)


def test_pages_of_a_large_node_lose_no_link(docs, monkeypatch):
    rows = family(2, 2, 60, 80)
    for name, value in (("PAGE", 16), ("LEAF", 4), ("INNER", 2), ("FEW", 3)):
        monkeypatch.setattr(jaccard, name, value)
    assert result(jaccard.jaccard_components(docs(rows))) == brute(rows)


def test_empty_and_repeated_rows(spark, docs):
    assert jaccard.jaccard_components(docs([])).collect() == []
    out = jaccard.jaccard_components(docs([(5, "a b c d"), (5, "a b c d"), (None, "x y z"), (7, "a b c d")]))
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in out.collect()) == [(-1, -1), (5, 5), (5, 5), (7, 5)]


def test_real_documents(spark, small):
    from tallywright.llm.queries import op8_jaccard_join

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert result(op8_jaccard_join(spark, small)) == brute(rows)


def points_of(sets, labels=None, sides=None):
    points = np.stack([np.frombuffer(jaccard.point_of(x), np.uint8) for x in sets])
    n = len(sets)
    return jaccard.Points(np.arange(n), np.array([len(x) for x in sets]), np.arange(n) if labels is None else labels, np.full(n, -1) if sides is None else sides, points, 9, 10)


def test_the_tree_leaves_out_no_pair_that_links(monkeypatch):
    r = np.random.default_rng(5)
    for name, value in (("LEAF", 4), ("INNER", 2)):
        monkeypatch.setattr(jaccard, name, value)
    base = [np.unique(r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)) for n in (3, 40, 400, 420, 60_000)]
    sets = list(base)
    for x in base[:4]:
        for _ in range(15):
            y = r.choice(x, max(1, len(x) - r.integers(0, 1 + len(x) // 12)), replace=False)
            sets.append(np.unique(np.concatenate([y, r.integers(0, 1 << 63, r.integers(0, 1 + len(x) // 12), np.uint64)])))
    sets.append(base[4][50:])
    for labels, sides in ((None, None), (r.integers(0, 5, len(sets)), None), (None, r.integers(0, 2, len(sets)))):
        held = points_of(sets, labels, sides)
        i, j = jaccard.Tree(held, 0, len(sets)).pairs()
        found = {(max(a, b), min(a, b)) for a, b in zip(i.tolist(), j.tolist())}
        assert len(found) == len(i)
        for a in range(len(sets)):
            for b in range(a):
                common = len(np.intersect1d(sets[a], sets[b]))
                if 10 * common >= 9 * (len(sets[a]) + len(sets[b]) - common) and held.labels[a] != held.labels[b] and (sides is None or sides[a] != sides[b]):
                    assert (a, b) in found
        assert len(found) < len(sets) ** 2 // 4


def test_rows_that_repeat_an_id_with_another_text(docs):
    r = np.random.default_rng(9)
    a, b, c = (" ".join(f"w{x}" for x in r.integers(0, 500, 60)) for _ in range(3))
    for rows in ([(5, a), (5, b), (6, a + " x"), (7, b + " y")], [(9, a), (9, b), (8, b + " y")], [(1, a), (1, b), (1, c), (1, a), (2, c + " z"), (None, a + " q"), (None, None)]):
        known = [(jaccard.NO_ID if i is None else i, t) for i, t in rows]
        got = jaccard.jaccard_components(docs(rows))
        assert sorted((jaccard.NO_ID if i is None else i, n, jaccard.NO_ID if k is None else k) for i, n, k in (tuple(x) for x in got.collect())) == brute(known)


def test_one_row_of_each_component_stays(docs):
    r = np.random.default_rng(10)
    a, b = (" ".join(f"w{x}" for x in r.integers(0, 500, 80)) for _ in range(2))
    rows = [(3, a), (5, a + " x"), (5, b), (5, b), (None, None), (None, None), (8, "")]
    out = jaccard.one_of_each(docs(rows))
    assert out.columns == docs([]).columns
    assert sorted((x.doc_id or -1, x.text or "") for x in out.collect()) == sorted([(3, a), (5, b), (-1, ""), (-1, ""), (8, "")])


def test_a_large_family_of_near_copies_takes_linear_work(docs):
    """Pairs that are verified grow with the rows, not with their square."""
    r = np.random.default_rng(11)
    made = {}
    for n in (300, 1200):
        base = r.integers(0, 4000, 200)
        texts = []
        for _ in range(n):
            x = base.copy()
            x[r.integers(0, 200, 2)] = r.integers(0, 4000, 2)
            texts.append(" ".join(f"w{v}" for v in x))
        sets = [np.unique(jaccard.shingles(jaccard.words_hashed([t])[0], 3)) for t in texts]
        held = points_of(sets)
        i, _ = jaccard.Tree(held, 0, n).near()
        made[n] = len(i)
        assert len({x for x in i.tolist()}) >= 0.9 * n
    assert made[1200] < 5 * made[300]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901)], "a long, b long")
    found = {r.node: r.component for r in components(edges, scratch(spark, "chain")).collect()}
    assert found == {i: 0 for i in range(1, 201)} | {901: 900}


def test_rounds_of_components_broadcast_nothing(spark, tmp_path):
    """A broadcast costs the driver some megabytes and threads, and a round has a plan of its own, however few its edges."""
    spark.createDataFrame([(3, 1), (2, 1), (9, 3)], "a long, b long").write.parquet(f"{tmp_path}/edges")
    round_ = hung(spark.read.parquet(f"{tmp_path}/edges"))
    assert {(r.a, r.b) for r in round_.collect()} == {(2, 1), (3, 1), (9, 1)}
    assert "Broadcast" not in round_._jdf.queryExecution().executedPlan().toString()
