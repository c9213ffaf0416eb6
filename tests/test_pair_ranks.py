"""Counts and selections among pairs against the pairs themselves."""

import numpy as np
import pytest

from cellwright.operators import pair_ranks as P
from cellwright.operators import trend as T


def pair_slopes(y, t):
    i, j = np.triu_indices(len(y), 1)
    return np.sort((y[j] - y[i]) / (t[j] - t[i]))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 129])
@pytest.mark.parametrize("digits", [0, 1, 8])
def test_counts(n, digits):
    rng = np.random.default_rng([n, digits])
    y = rng.normal(size=(6, n)).round(digits)
    y[3:][rng.random((3, n)) < 0.2] = np.nan
    i, j = np.triu_indices(n, 1)
    assert (P.pairs_in_order(y) == (y[:, i] <= y[:, j]).sum(axis=1)).all()
    s, var, count = P.kendall(y)
    assert np.allclose(s, np.nansum(np.sign(y[:, j] - y[:, i]), axis=1)) and (count == np.isfinite(y).sum(axis=1)).all()
    for row in y:
        v = row[np.isfinite(row)]
        a, b = P.listed_pairs(v)
        assert (a < b).all() and (v[a] <= v[b]).all() and len(set(zip(a.tolist(), b.tolist()))) == len(a) == sum(v[p] <= v[q] for p in range(len(v)) for q in range(p + 1, len(v)))


@pytest.mark.parametrize("n", [60, 500])
@pytest.mark.parametrize("digits", [0, 1, 8])
def test_selection(monkeypatch, n, digits):
    monkeypatch.setattr(P, "LISTED_AT_LEAST", 100)
    rng = np.random.default_rng([n, digits])
    y = (rng.normal(size=n) + 0.01 * np.arange(n)).round(digits)
    t = np.sort(rng.choice(5 * n, n, replace=False)).astype(float)
    want = pair_slopes(y, t)
    for k in (0, 1, len(want) // 3, len(want) // 2, len(want) - 1):
        assert P.ranked_slope(y, t, k) == pytest.approx(want[k], rel=1e-12, abs=1e-12)
    assert P.ranked_slope(np.ones(n), t, 5) == 0.0


def test_long_and_short_series_agree(monkeypatch):
    rng = np.random.default_rng(4)
    y = rng.normal(size=(4, 90)).round(2)
    y[1][rng.random(90) < 0.4] = np.nan
    y[2] = np.nan
    rank = np.array([5, 100, 0, 4004])
    held = P.PairSlopes(y, np.arange(90))
    monkeypatch.setattr(P, "SMALL", 0)
    picked = P.PairSlopes(y, np.arange(90))
    assert not picked.small and held.small
    assert np.allclose(held.at(rank), picked.at(rank), equal_nan=True) and np.allclose(held.median(), picked.median(), equal_nan=True)


def test_ten_thousand_steps_in_a_task(spark):
    """50 million pairs a cell, of which a task holds a few values for each step."""
    rng = np.random.default_rng(6)
    rows = [(c, t, float(v)) for c in range(2) for t, v in enumerate(rng.normal(size=10_000) + 0.003 * c * np.arange(10_000))]
    got = {r["cell"]: r for r in T.pair_statistics(spark.createDataFrame(rows, "cell int, t int, y double"), ["cell"]).collect()}
    assert abs(got[0]["slope"]) < 1e-4 and abs(got[1]["slope"] - 0.003) < 1e-4 and got[1]["z"] > 50 and got[0]["n"] == 10_000


def test_correlogram_matches_products():
    rng = np.random.default_rng(8)
    y = np.cumsum(rng.normal(size=(5, 50)), axis=1)
    y[1, ::7] = np.nan
    y[2] = 3.3
    y[3] = np.nan
    got = T.correlogram(y, 4)
    for row, rho in zip(y, got):
        d = row - np.nanmean(row) if np.isfinite(row).any() else row
        for k in range(1, 5):
            whole = np.nansum(d * d)
            if np.isfinite(row).any() and np.ptp(row[np.isfinite(row)]) > 0:
                assert rho[k - 1] == pytest.approx(np.nansum(d[k:] * d[:-k]) / whole, abs=1e-12)
            else:
                assert np.isnan(rho[k - 1])
