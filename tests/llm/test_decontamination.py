import random

import numpy as np
from pyspark.sql import functions as F

from cellwright.llm import decontamination as D

from .oracle import agree


def parts(t):
    w = D.words(t)
    s, half = D.shingles(w), (len(w) + 1) // 2
    return set(s), set(s[: max(1, half - D.SHINGLE + 1)]), set(s[min(half, len(s) - 1) :])


def brute(index, items, text):
    """Verified items by looking into every passage for every item."""
    w, out = D.words(text), set()
    for k, (i, t) in enumerate(zip(index.ids, items)):
        n = min(len(D.words(t)), D.SHINGLE)
        for p in range(0, max(1, (len(w) - 1) // index.cell) * index.cell, index.cell):
            have = set(D.shingles(w[p : p + 2 * index.cell], n))
            share = [len(x & have) / len(x) for x in parts(t)]
            if share[0] >= D.OVERLAP and min(share[1:]) >= D.PART_OVERLAP:
                out.add(i)
    return out


def test_retrieval_loses_nothing():
    r = random.Random(11)
    common = ["the", "of", "and", "to", "in"]

    def line(n):
        return " ".join(r.choice(common) if r.random() < 0.6 else f"w{r.randrange(3000)}" for _ in range(n))

    items = [line(r.randrange(1, 60)) for _ in range(150)]
    index = D.Index([(i, t.encode(), None) for i, t in enumerate(items)])
    hits = 0
    for _ in range(400):
        w = line(r.randrange(1, 400)).split()
        for t in r.sample(items, 2):
            t = t.split()
            for _ in range(r.choice([0, 0, 1, 2])):
                t[r.randrange(len(t))] = "edited"
            t = t[r.choice([0, 0, 3]) :]
            k = r.randrange(len(w) + 1)
            w[k:k] = t
        text = " ".join(w).upper().encode()
        want = brute(index, [t.encode() for t in items], text)
        assert {m["item_id"] for m in index.matches(text)} == want
        hits += len(want)
    assert hits > 300


def test_wand_skips_and_loses_nothing():
    r = random.Random(12)
    w = [f"w{int(r.paretovariate(0.7))}" for _ in range(60_000)]
    index = D.Index([(i, " ".join(w[i * 12 : i * 12 + r.randrange(8, 30)]).encode(), None) for i in range(4000)])
    assert D.Index.from_bytes(index.to_bytes()).candidates([x.encode() for x in w[:900]]) == index.candidates([x.encode() for x in w[:900]])
    found = 0
    for _ in range(60):
        a = r.randrange(50_000)
        own = np.array(sorted({index.number[x.encode()] for x in w[a : a + r.randrange(5, 120)] if x.encode() in index.number}), dtype=np.int64)
        score = np.zeros(len(index.ids))
        for t in own:
            score[index.item[index.first[t] : index.first[t + 1]]] += index.weight[index.first[t] : index.first[t + 1]]
        want = np.flatnonzero(score >= 1 - D._EPS).tolist()
        assert index.retrieve(own) == want
        found += len(want)
    assert found > 50


def test_gap_at_any_offset():
    item = [f"q{i}" for i in range(60)]
    index = D.Index([(7, " ".join(item).encode(), None)])
    for lead in range(0, 300, 7):
        text = [*(f"x{i}" for i in range(lead)), *item[:30], *(f"gap{i}" for i in range(30)), *item[30:], *(f"y{i}" for i in range(200))]
        assert [m["item_id"] for m in index.matches(" ".join(text).encode())] == [7]


def test_many_items_and_a_long_one(spark, monkeypatch):
    monkeypatch.setattr(D, "GROUP", 15_000)
    items = spark.range(50_000).select(F.col("id").alias("item_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", k), F.lit(5000)))), " ").alias("text"))
    long = spark.createDataFrame([(99_999, " ".join(f"long{i}" for i in range(30_000)))], "item_id long, text string")
    picked = {r["item_id"]: r["text"] for r in items.where("item_id % 9973 = 5").collect()}
    docs = [(i, f"some words before {t} and after") for i, t in picked.items()] + [(-1, "nothing of it"), (99_999, " ".join(f"long{i}" for i in range(29_000)))]
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items.unionAll(long)).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == sorted((i, i) for i in [*picked, 99_999])


def test_oracle(spark):
    for p in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        agree(D.op6_decontamination(spark, p), D.ORACLES["op6_decontamination"], p)


def test_edges(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "Tiny one"), (4, "a b c d e f g h")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None, 0), (2, "x tiny ONE y", 0), (2, "x tiny ONE y", 0), (None, "q a b c d e f g h", 0), (5, "clean " * 5000, 0)], "doc_id long, text string, matches int")
    got = sorted(((r["doc_id"], r["item_id"]) for r in D.contaminated(docs, items).collect()), key=str)
    assert got == [(2, 3), (2, 3), (None, 4)]
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 5]
    assert D.contaminated(docs, items.limit(0)).count() == 0 and D.contaminated(docs.limit(0), items).count() == 0
