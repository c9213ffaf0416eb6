import random

from pyspark.sql import functions as F

from cellwright.llm import mixing as M

from .oracle import agree


def brute_fill(sizes, weights, budget, epochs):
    """Clamp and deal out again until nothing is above its cap."""
    total, free, target = budget * sum(sizes), set(range(len(sizes))), {}
    while free:
        share = {i: total * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] > epochs * sizes[i]}
        if not over:
            return [target[i] if i in target else share[i] for i in range(len(sizes))]
        for i in over:
            target[i] = float(epochs * sizes[i])
            total -= target[i]
        free -= over
    return [target[i] for i in range(len(sizes))]


def test_water_level(spark):
    r = random.Random(9)
    for n in (1, 2, 7, 20):
        sizes = [r.choice([0, 1, 10, 1000, 10**6]) + r.randrange(9) for _ in range(n)]
        weights = [r.choice([1, 2, 5, 50]) for _ in range(n)]
        df = spark.createDataFrame([(f"s{i:02}", s, w) for i, (s, w) in enumerate(zip(sizes, weights))], "source string, source_size long, weight long")
        for budget in (0.5, 1.5, 2.0, 3.0):
            got = [x["target"] for x in M.water_fill(df, budget, 2).orderBy("source").collect()]
            for a, b in zip(got, brute_fill(sizes, weights, budget, 2)):
                assert abs(a - b) <= 1e-6 * max(1, b)


def test_oracle(spark):
    p = "/root/testdata/sf0.01"
    agree(M.op1_mixing(spark, p), M.ORACLES["op1_mixing"], p)


def test_targets_are_met(spark):
    r = random.Random(10)
    rows = [(i, "w " * r.randrange(1, 60), r.choice(["hot", "hot", "hot", "a", "b", None])) for i in range(4000)]
    rows += [(None, f"n{r.randrange(10**6)} " * r.randrange(1, 60), "no ids") for _ in range(1000)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {}
    for x in got:
        s = by.setdefault(x["source"], [0, x["target"], x["source_size"]])
        s[0] += x["size"] * x["copies"]
        assert 0 <= x["copies"] <= 2
    for taken, target, size in by.values():
        assert abs(taken - target) <= 60 and target <= 2 * size


def test_edges(spark):
    rows = [(1, None, "a", 7), (1, "x y", "a", 7), (None, "", None, 7), (2, "one", "a", 7), (2, "one", "a", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    assert M.mix(df).count() == 5
    out = M.repeat_documents(df)
    assert out.columns == df.columns and out.count() >= 5
    odd = df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("h", "s", "copies", "cut", "whole", "col"))], F.create_map(F.lit(1), F.lit(2)).alias("m"))
    assert sorted(out.collect(), key=repr) == sorted(M.repeat_documents(odd).select(*df.columns).collect(), key=repr)
    assert M.mix(df.limit(0)).count() == 0 and M.repeat_documents(df.limit(0)).count() == 0
