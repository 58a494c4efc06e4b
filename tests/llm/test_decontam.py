import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tallywright.llm import decontam
from tallywright.llm.decontam import contaminated, decontaminated


def words(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def brute(rows, items):
    out = {}
    for item, t in items:
        w = words(t)
        k = min(5, len(w))
        if not k:
            continue
        own = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        m = sum(own.values())
        for doc, text in rows:
            v = words(text)
            all_ = [tuple(v[i : i + k]) for i in range(len(v) - k + 1)]
            for s in range(max(1, len(all_) - m + 1)):
                part = Counter(all_[s : s + m])
                o = sum((own & part).values())
                u = m + sum(part.values()) - o
                if 5 * o >= 4 * u and o / u > out.get((doc, item), (0, 0))[0]:
                    out[doc, item] = (o / u, s)
    return out


def found(df):
    return {(r.doc_id, r.item_id): (r.similarity, r.start) for r in df.collect()}


def test_same_as_brute_force(spark, docs):
    r = random.Random(6)
    pool = [f"w{i}" for i in range(80)]
    items = [(i, " ".join(r.choice(pool) for _ in range(r.randint(8, 60)))) for i in range(12)] + [(50, ""), (51, None), (52, "lone pair"), (53, "a b c d e a b c d e a b c d e a b c d e")]
    rows = []
    for d in range(120):
        text = [r.choice(pool) for _ in range(r.randint(0, 120))]
        item = words(r.choice(items)[1])
        for _ in range(r.randint(0, 2)):
            if item:
                item[r.randrange(len(item))] = "x"
        if r.random() < 0.3 and item:
            item.pop(r.randrange(len(item)))
        text[len(text) // 2 : len(text) // 2] = item
        rows.append((d, ", ".join(text)))
    rows += [(500, None), (501, ""), (502, "Lone, PAIR"), (503, items[0][1]), (504, " ".join([items[1][1]] * 40)), (505, items[53 - 38][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert found(contaminated(docs(rows), bench)) == brute(rows, items)


def test_real_documents(spark, small):
    from tallywright.llm.queries import op6_decontamination

    read = lambda name: [tuple(x) for x in spark.read.parquet(f"{small}/{name}.parquet").select("doc_id" if name == "documents" else "item_id", "text").collect()]
    expected = brute(read("documents"), read("benchmark"))
    assert expected and found(op6_decontamination(spark, small)) == expected


def test_empty_tables(spark, docs):
    bench = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert contaminated(docs([]), bench).collect() == []
    assert contaminated(docs([(1, "a b c d e f g h")]), bench.limit(0)).collect() == []
    assert len(contaminated(docs([(1, "a b c d e f g h"), (1, "a b c d e f g h")]), bench.union(bench)).collect()) == 1


def test_moved_blocks_are_found(spark, docs):
    r = random.Random(7)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(100))) for i in range(6)]
    rows = []
    for i, text in items:
        w = words(text)
        for at, order in enumerate(([w[50:], w[:50]], [w[35:], w[:35]], [w[70:], w[35:70], w[:35]], [w[50:], w[:50], w[:50]])):
            pad = [f"x{r.randrange(1000)}" for _ in range(120)]
            before = r.randint(0, 60)
            rows.append((10 * i + at, " ".join(sum(order, pad[:before]) + pad[before:])))
        rows.append((10 * i + 8, " ".join(w[50:] + w[:50])))
        rows.append((10 * i + 9, " ".join(w[48:] + w[:40])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(rows, items)
    assert len(expected) >= 30 and found(contaminated(docs(rows), bench)) == expected


def test_rows_that_repeat_an_id_stand_each_for_itself(spark, docs):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    bench = spark.createDataFrame([(None, a), (7, b), (7, "q " * 30), (8, b)], "item_id long, text string")
    rows = [(3, a), (3, c), (None, "x y z " + b), (None, c), (5, "q " * 32)]
    out = contaminated(docs(rows), bench).collect()
    assert sorted((str(r.doc_id), str(r.item_id)) for r in out) == [("3", "None"), ("5", "7"), ("None", "7"), ("None", "8")]
    kept = decontaminated(docs(rows), bench)
    assert kept.columns == docs([]).columns and sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("3", c), ("None", c)]


def test_the_index_by_itself_finds_the_windows(spark):
    """Every window of every text gets a fingerprint; nothing but the index proposes pairs."""
    r = random.Random(12)
    pool = [f"w{i}" for i in range(300)]
    rows, items = [], []
    for i in range(8):
        item = [r.choice(pool) for _ in range(60)]
        items.append((i, item))
        for _ in range(6):
            text = list(item)
            for _ in range(r.randint(0, 1)):
                text[r.randrange(60)] = "x"
            rows.append((len(rows), [r.choice(pool) for _ in range(r.randint(0, 40))] + text + [r.choice(pool) for _ in range(20)]))
    m = 56
    cut = lambda w, s: [hash5(w[s + j : s + j + 5]) for j in range(m)]
    windows = spark.createDataFrame([(d, s, cut(w, s)) for d, w in rows for s in range(len(w) - 59)], "doc long, start int, hashes array<long>")
    own = spark.createDataFrame([(i, cut(w, 0)) for i, w in items], "item long, hashes array<long>")
    left = decontam.simhashes(windows, ["doc", "start"]).withColumn("m", F.lit(m))
    right = decontam.simhashes(own, ["item"]).withColumnRenamed("fingerprint", "other").withColumn("m", F.lit(m))
    got = {(x.doc, x.start, x.item) for x in decontam.within_radius(left, right, ["m"]).collect()}
    prints, others = {(x.doc, x.start): x.fingerprint for x in left.collect()}, {x.item: x.other for x in right.collect()}
    near = {(*k, i) for k, f in prints.items() for i, o in others.items() if ((f ^ o) & (1 << 64) - 1).bit_count() <= decontam.RADIUS}
    assert got == near  # all fingerprints within the radius, and no other
    true = {(d, i) for d, i in brute([(d, " ".join(w)) for d, w in rows], [(i, " ".join(w)) for i, w in items])}
    assert len({(d, i) for d, _, i in got} & true) >= 0.9 * len(true) and len(near) < len(prints) * len(others) // 8


def hash5(words):
    import xxhash

    return xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63)


def test_the_index_adds_little_to_the_plan(spark):
    """The driver holds and rewrites plans, so the 2,517 masks of the index are rows of a table, never literals."""
    left = spark.range(1).select(F.col("id").alias("doc"), F.lit(5).alias("m"), F.col("id").alias("fingerprint"))
    right = spark.range(1).select(F.col("id").alias("item"), F.lit(5).alias("m"), F.col("id").alias("other"))
    plans = decontam.within_radius(left, right, ["m"])._jdf.queryExecution()
    assert max(len(plans.analyzed().toJSON()), len(plans.optimizedPlan().toJSON())) < 150_000
    masks = {r.mask for r in decontam.masks(spark).collect()}
    assert masks == {x for x in range(1 << 16) if x.bit_count() <= 4} and len(masks) == 2517
