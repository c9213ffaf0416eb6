"""Break-point models of one series per group: none, step, kink, extra regressors; exhaustive over the break."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bic(rss: float, n: int, p: int) -> float:
    return n * np.log(max(rss, 1e-300) / n) + p * np.log(n)


def _fit(columns: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    x = np.stack(columns, axis=1)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    rest = y - x @ beta
    return beta, float(rest @ rest)


def candidates(t: np.ndarray, edge: int) -> list[float]:
    """Breaks with at least ``edge`` values on both sides."""
    ordered = np.sort(t)
    return [k for k in np.unique(t) if np.searchsorted(ordered, k) >= edge and len(t) - np.searchsorted(ordered, k) >= edge]


def models(t: np.ndarray, y: np.ndarray, edge: int = 12, seasonal: bool = False, extra: dict[str, np.ndarray] | None = None) -> pd.DataFrame:
    """One row per model: name, k, coefficient, slope, rss, bic. ``seasonal`` adds calendar-month indicators."""
    base = [np.ones(len(y)), t.astype(float)]
    if seasonal:
        base += [(t % 12 == m).astype(float) for m in range(1, 12)]
    n, p = len(y), len(base)
    beta, rss = _fit(base, y)
    out = [("none", None, None, beta[1], rss, bic(rss, n, p))]
    shapes = {"step": lambda k: (t >= k).astype(float), "kink": lambda k: np.maximum(t - k, 0.0)}
    for name, shape in shapes.items():
        best = None
        for k in candidates(t, edge):
            beta, rss = _fit([*base, shape(k)], y)
            if best is None or rss < best[4]:
                best = (name, int(k), beta[-1], beta[1], rss, bic(rss, n, p + 2))
        if best:
            out.append(best)
    for name, x in (extra or {}).items():
        cols = list(np.atleast_2d(x.T))
        beta, rss = _fit([*base, *cols], y)
        out.append((name, None, beta[-len(cols)], beta[1], rss, bic(rss, n, p + len(cols))))
    return pd.DataFrame(out, columns=["model", "k", "coefficient", "slope", "rss", "bic"])


def break_models(series: DataFrame, by: list[str], t: str = "t", y: str = "y", edge: int = 12, seasonal: bool = False, extra: tuple = ()) -> DataFrame:
    """Models of each group's series; a group is one series of at most some hundred months."""
    kinds = series.select(*by).schema
    rows = series.where(F.col(y).isNotNull()).select(*by, F.col(t).cast("double").alias("t"), F.col(y).cast("double").alias("y"), *extra)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", model string, k int, coefficient double, slope double, rss double, bic double"

    def work(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        if len(pdf) < 3:
            return pd.DataFrame(columns=[*by, "model", "k", "coefficient", "slope", "rss", "bic"])
        out = models(pdf["t"].to_numpy(), pdf["y"].to_numpy(), edge, seasonal, {e: pdf[e].to_numpy(float) for e in extra})
        for name, value in zip(by, key):
            out[name] = value
        out["k"] = out["k"].astype("Int32")
        return out[[*by, "model", "k", "coefficient", "slope", "rss", "bic"]]

    return rows.groupBy(*by).applyInPandas(work, schema)


def break_bootstrap(series: DataFrame, by: list[str], t: str = "t", y: str = "y", replicates: int = 200, block: int = 12, seed: int = 20261005, edge: int = 12) -> DataFrame:
    """(by..., replicate, k): the step's place after resampling the residuals of the best step in moving blocks."""
    kinds = series.select(*by).schema
    rows = series.where(F.col(y).isNotNull()).select(*by, F.col(t).cast("double").alias("t"), F.col(y).cast("double").alias("y"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", replicate int, k int"

    def work(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        tt, yy = pdf["t"].to_numpy(), pdf["y"].to_numpy()
        ks = candidates(tt, edge)
        out = pd.DataFrame(columns=[*by, "replicate", "k"])
        if ks and len(yy) >= block:
            base = np.stack([np.ones(len(yy)), tt], axis=1)
            # residual makers of every candidate, so that a replicate costs one product each
            designs = [np.column_stack([base, tt >= k]) for k in ks]
            makers = [np.eye(len(yy)) - d @ np.linalg.pinv(d) for d in designs]
            best = int(np.argmin([((m @ yy) ** 2).sum() for m in makers]))
            rest = makers[best] @ yy
            rng = np.random.default_rng(seed)
            drawn = []
            for _ in range(replicates):
                starts = rng.integers(0, len(yy) - block + 1, size=-(-len(yy) // block))
                again = yy - rest + np.concatenate([rest[s : s + block] for s in starts])[: len(yy)]
                drawn.append(int(ks[int(np.argmin([((m @ again) ** 2).sum() for m in makers]))]))
            out = pd.DataFrame({"replicate": range(replicates), "k": drawn})
            for name, value in zip(by, key):
                out[name] = value
        return out[[*by, "replicate", "k"]]

    return rows.groupBy(*by).applyInPandas(work, schema)
