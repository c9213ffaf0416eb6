"""Counter-based draws: counts, repeatability, and intervals against an independent bootstrap."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwright.config import CrossSectionRules
from cellwright.operators import crosssection as X
from cellwright.operators import resampling as R


def test_draws(spark):
    units = spark.range(40).select(F.format_string("u%02d", "id").alias("u"), F.col("id").alias("v"))
    rows = R.drawn(units, "u", 500, 7).collect()
    by = {}
    for r in rows:
        by.setdefault(r["replicate"], {})[r["u"]] = r["times"]
    assert set(by) == set(range(500)) and all(sum(t.values()) == 40 for t in by.values())
    times = np.array([[t.get(f"u{k:02d}", 0) for k in range(40)] for t in by.values()])
    assert abs(times.mean(axis=0) - 1).max() < 0.25 and abs(times.var() - (1 - 1 / 40)) < 0.05
    pairs = np.corrcoef(times.T)[np.triu_indices(40, 1)]
    assert abs(pairs.mean() + 1 / 39) < 0.01 and abs(pairs).max() < 0.25
    again = R.drawn(units.repartition(9).unionAll(units), "u", 500, 7).collect()
    assert sorted(again) == sorted(rows) and sorted(R.drawn(units, "u", 500, 8).collect()) != sorted(rows)
    assert R.drawn(units.limit(0), "u", 500, 7).count() == 0


def test_draws_of_groups(spark, monkeypatch):
    monkeypatch.setattr(R, "RUN", 7)
    units = spark.range(60).select(F.when(F.col("id") < 40, "a").when(F.col("id") < 59, "b").otherwise("c").alias("g"), F.format_string("u%02d", F.col("id") % 40).alias("u"))
    got = sorted(tuple(r) for r in R.drawn_by(units.unionAll(units), ["g"], "u", 30, 5).collect())
    want = sorted((g, r["replicate"], r["u"], r["times"]) for g in "abc" for r in R.drawn(units.where(F.col("g") == g), "u", 30, 5).collect())
    assert got == want and R.drawn_by(units.limit(0), ["g"], "u", 30, 5).count() == 0 and R.drawn_by(units, ["g"], "u", 0, 5).count() == 0


def test_grouped_regression(spark):
    pts = spark.range(30).select(F.format_string("c%02d", "id").alias("country"), F.when(F.col("id") < 25, "a").when(F.col("id") < 27, "b").otherwise("c").alias("g"), F.rand(1).alias("x"), F.rand(2).alias("y")).collect()
    pts, rules = spark.createDataFrame(pts, "country string, g string, x double, y double"), CrossSectionRules(bootstrap=40)
    got = {r["g"]: r for r in X.regression(pts, "country", rules, by=("g",)).collect()}
    for g in "abc":
        alone = X.regression(pts.where(F.col("g") == g), "country", rules).first()
        assert all(got[g][c] == (alone[c] if alone[c] is None else pytest.approx(alone[c])) for c in ("n", "slope", "intercept", "r2", "low", "high")), g
    assert got["b"]["slope"] is None and got["b"]["low"] is None


def test_slope_interval_is_that_of_pairs_bootstrap(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=60)
    y = 2 * x + rng.normal(size=60)
    df = spark.createDataFrame([(f"c{k}", float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))], "country string, x double, y double")
    got = X.regression(df, "country", CrossSectionRules(bootstrap=1500)).first()
    slopes = []
    for _ in range(1500):
        k = rng.integers(0, 60, 60)
        slopes.append(np.polyfit(x[k], y[k], 1)[0])
    low, high = np.percentile(slopes, [2.5, 97.5])
    assert got["slope"] == pytest.approx(np.polyfit(x, y, 1)[0]) and got["low"] == pytest.approx(low, abs=0.04) and got["high"] == pytest.approx(high, abs=0.04)
    few = X.regression(df.limit(2), "country", CrossSectionRules(bootstrap=50)).first()
    assert few["n"] == 2 and few["low"] is None and few["high"] is None


def test_uniform(spark):
    u = np.array([r[0] for r in spark.range(20_000).select(R.uniform(3, "id")).collect()])
    assert 0 <= u.min() and u.max() < 1 and abs(np.histogram(u, 20)[0] - 1000).max() < 130
