"""Nested histograms against sorted lists."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwright.operators import selection as S


def data():
    r = random.Random(5)
    rows = [("normal", r.gauss(0, 1)) for _ in range(1500)] + [("wide", r.choice([-1, 1]) * 10 ** r.uniform(-12, 12)) for _ in range(1200)]
    rows += [("ties", r.choice([0.0, 1.5, 1.5, 1.5, 2.5])) for _ in range(900)] + [("equal", 7.25)] * 800 + [("hot", 0.0)] * 700 + [("hot", r.random()) for _ in range(700)]
    rows += [("outlier", r.random()) for _ in range(999)] + [("outlier", 1e300), ("one", -3.0), ("none", None), ("nan", float("nan")), ("nan", 2.0), (None, 4.0), (None, 5.0)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("held", [10**6, 0])
def test_percentiles(spark, monkeypatch, held):
    monkeypatch.setattr(S, "LISTED", 20)
    monkeypatch.setattr(S, "BUCKETS", 8)
    rows = data()
    df = spark.createDataFrame([(*x, 1) for x in rows], "kind string, v double, name int").repartition(5)
    wanted = {"p75": (F.col("v"), 0.75), "mid": (F.col("v"), 0.5), "far": (F.abs("v"), 0.9), "least": (F.col("v"), 0.0), "most": (F.col("v"), 1.0)}
    got = {r["kind"]: r for r in S.exact_percentiles(df.drop("name"), ["kind"], wanted, held).collect()}
    assert set(got) == {k for k, _ in rows}
    for kind in got:
        v = np.array([x for k, x in rows if k == kind and x is not None and x == x])
        for name, (p, u) in {"p75": (75, v), "mid": (50, v), "far": (90, np.abs(v)), "least": (0, v), "most": (100, v)}.items():
            if not len(v):
                assert got[kind][name] is None
            else:
                assert got[kind][name] == pytest.approx(np.percentile(u, p), rel=1e-12, abs=1e-15)


def test_no_task_holds_a_group(spark, monkeypatch):
    """What is left for one-by-one counting stays within the bound, however large the group."""
    monkeypatch.setattr(S, "LISTED", 500)
    df = spark.range(200_000).select(F.lit("a").alias("k"), F.lit("m").alias("name"), F.rand(3).alias("x"))
    seen = []
    same = S._same

    def watched(left, right, keys, how="inner"):
        out = same(left, right, keys, how)
        if "inside" in right.columns:
            seen.append(right.agg(F.max("inside")).first()[0])
        return out

    monkeypatch.setattr(S, "_same", watched)
    got = S.ranked_values(df, ["k", "name"], {"m": 0.5}).first()["value"]
    assert abs(got - 0.5) < 0.01 and seen[0] == 200_000 and seen[-1] <= 500 and len(seen) <= 4


def test_empty(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert S.exact_percentiles(df, ["k"], {"m": (F.col("v"), 0.5)}).count() == 0
    assert S.exact_percentiles(df, ["k"], {"m": (F.col("v"), 0.5)}, held=-1).count() == 0
