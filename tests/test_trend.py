"""Trend kernels against plain loops, and known truth on synthetic cubes."""

import math
import random
from math import erfc, sqrt
from statistics import NormalDist, median

import numpy as np
from pyspark.sql import functions as F

from cellwright.config import TrendSettings
from cellwright.functions.scalars import two_sided_normal
from cellwright.operators import trend as T
from cellwright.operators.anomaly import benjamini_hochberg


def kendall(y):
    p = [(t, v) for t, v in enumerate(y) if v is not None]
    s = sum((b > a) - (b < a) for k, (_, a) in enumerate(p) for _, b in p[k + 1 :])
    n, v = len(p), [x for _, x in p]
    ties = sum(v.count(x) * (v.count(x) - 1) * (2 * v.count(x) + 5) for x in set(v))
    var = (n * (n - 1) * (2 * n + 5) - ties) / 18
    z = (s - (s > 0) + (s < 0)) / sqrt(var) if var > 0 else (0.0 if s == 0 else None)
    return s, var, z


def slopes(y):
    p = [(t, v) for t, v in enumerate(y) if v is not None]
    return sorted((b - a) / (u - t) for k, (t, a) in enumerate(p) for u, b in p[k + 1 :])


def ranks(y):
    v = [x for x in y if x is not None]
    return [None if x is None else sum(a < x for a in v) + (v.count(x) + 1) / 2 for x in y]


def autocorrelation(y, k):
    v = [x for x in y if x is not None]
    m = sum(v) / len(v)
    whole = sum((x - m) ** 2 for x in v)
    return sum((a - m) * (b - m) for a, b in zip(y, y[k:]) if a is not None and b is not None) / whole if whole > 0 else None


def hamed_rao(y, slope, lags=3):
    n = sum(v is not None for v in y)
    r = ranks([None if v is None else v - slope * t for t, v in enumerate(y)])
    total = 0
    for k in range(1, lags + 1):
        rho = autocorrelation(r, k)
        if rho is not None and abs(rho) > NormalDist().inv_cdf(0.975) / sqrt(n):
            total += (n - k) * (n - k - 1) * (n - k - 2) * rho
    return max(1.0, 1 + 2 / (n * (n - 1) * (n - 2)) * total)


def yue(y, slope):
    rest = [None if v is None else v - slope * t for t, v in enumerate(y)]
    n, r1 = sum(v is not None for v in y), autocorrelation(rest, 1)
    if r1 is None or abs(r1) <= NormalDist().inv_cdf(0.975) / sqrt(n):
        return y
    return [None if t == 0 or rest[t] is None or rest[t - 1] is None else rest[t] - r1 * rest[t - 1] + slope * t for t in range(len(y))]


def some_series():
    r = random.Random(1)
    out = []
    for k in range(24):
        phi, slope, e, y = r.choice([0, 0.6, 0.9]), r.choice([0, 0.01, -0.05]), 0.0, []
        for t in range(80):
            e = phi * e + r.gauss(0, 1)
            v = e + slope * t
            y.append(None if r.random() < 0.1 else round(v, r.choice([0, 3])))
        out.append(y)
    out += [[1.0] * 80, [None] * 80, [1.0, 2.0] + [None] * 78, [float(t) if t < 30 else None for t in range(80)]]
    return out


def test_statistics_match_loops(spark):
    data = some_series()
    rows = [(c, t, v) for c, y in enumerate(data) for t, v in enumerate(y)]
    got = {r["cell"]: r for r in T.series_statistics(spark.createDataFrame(rows, "cell int, t int, y double"), ["cell"]).collect()}
    for c, y in enumerate(data):
        g, n = got[c], sum(v is not None for v in y)
        assert g["n_valid"] == n and g["status"] == (2 if n >= 60 else 1 if n >= 24 else 0)
        if n < 24:
            assert g["slope"] is None and g["z_mk"] is None
            continue
        s, var, z = kendall(y)
        sl = slopes(y)
        assert math.isclose(g["slope"], 12 * median(sl), abs_tol=1e-9) and math.isclose(g["z_mk"], z, abs_tol=1e-9)
        if var > 0:
            half = NormalDist().inv_cdf(0.975) * sqrt(var)
            lo, hi = math.floor((len(sl) - half) / 2), math.ceil((len(sl) + half) / 2)
            assert math.isclose(g["low"], 12 * sl[lo - 1], abs_tol=1e-9) and math.isclose(g["high"], 12 * sl[min(hi, len(sl) - 1)], abs_tol=1e-9)
        if n >= 60 and var > 0:
            f = hamed_rao(y, median(sl))
            assert math.isclose(g["factor_hr"], f, rel_tol=1e-9)
            assert math.isclose(g["z_hr"], (s - (s > 0) + (s < 0)) / sqrt(var * f), abs_tol=1e-9)
            white = yue(y, median(sl))
            if sum(v is not None for v in white) >= 60:
                assert math.isclose(g["z_yue"], kendall(white)[2], abs_tol=1e-9)
            else:
                assert g["z_yue"] is None


def test_normal_tail(spark):
    z = [0.0, 1.0, -1.96, 5.0, 12.5, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in z], "z double").select(two_sided_normal(F.col("z"))).collect()]
    assert got == [None if v is None else erfc(abs(v) / sqrt(2)) for v in z]


def test_benjamini_hochberg(spark):
    r = random.Random(2)
    rows = [(f, i, None if r.random() < 0.1 else r.random() ** r.choice([1, 4])) for f in range(5) for i in range(300)]
    rows += [(9, i, p) for i, p in enumerate([0.01, 0.01, 0.9, None])] + [(10, 0, 0.0), (11, 0, 1.0)]
    df = spark.createDataFrame(rows, "family int, i int, p double")
    got = {(x["family"], x["i"]): x["significant"] for x in benjamini_hochberg(df, "p", 0.1, ["family"]).collect()}
    for f in {x[0] for x in rows}:
        ps = sorted(p for g, _, p in rows if g == f and p is not None)
        cut = max((p for k, p in enumerate(ps, 1) if p <= 0.1 * k / len(ps)), default=-1)
        for g, i, p in rows:
            if g == f:
                assert got[g, i] == (p is not None and p <= cut)


def test_planted_trend_is_reported(spark):
    r = np.random.default_rng(3)
    rows = []
    for row in range(6):
        for col in range(8):
            slope = 0.05 if row < 3 and col < 3 else 0.0
            rows += [(row, col, 0.0, t, float(10 + slope * t + r.normal(0, 0.3)), 1.0) for t in range(120)]
    df = spark.createDataFrame(rows, "row int, col int, lat double, t int, x double, share double")
    got = T.trend_per_cell(df, 8, TrendSettings()).collect()
    hit = {(g["row"], g["col"]) for g in got if g["reported"]}
    assert {(a, b) for a in range(3) for b in range(3)} <= hit and len(hit) <= 11
    for g in got:
        if g["row"] < 3 and g["col"] < 3:
            assert abs(g["slope"] - 0.6) < 0.1
