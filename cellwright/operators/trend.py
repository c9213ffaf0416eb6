"""Trends per cell: Mann-Kendall, Sen slope, Hamed-Rao and Yue corrections.

Series are gathered per cell (a cell has as many values as months, so a group
is small) and worked on in Arrow batches, a block of cells at once; long series by
counting and selecting among pairs (``pair_ranks``) instead of holding them.
Deseasoning, significance, and the summaries stay DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import TrendSettings
from ..functions.grid import cell_area_km2
from ..functions.quality import snow_suspected
from ..functions.scalars import normal_quantile, two_sided_normal
from .anomaly import benjamini_hochberg
from .components import label_components, number_groups, written
from .pair_ranks import SMALL, PairSlopes, kendall

#: Pairs of time steps that a block of cells may have.
PAIRS = 4_000_000


def alpha_fdr(alpha_global: float = 0.05) -> float:
    """Rate for false discoveries that keeps the global level."""
    return 2 * alpha_global


def deseason(series: DataFrame, cell: list[str], value: str = "x", t: str = "t", minimum: int = 3) -> DataFrame:
    """Add ``y``, the deviation from the cell's median of the calendar month, and ``level``, the cell's median.

    Calendar months with too few values give null.
    """
    same = Window.partitionBy(*cell, F.pmod(F.col(t), F.lit(12)))
    own = Window.partitionBy(*cell)
    enough = F.count(value).over(same) >= minimum
    return series.withColumn("y", F.when(enough, F.col(value) - F.median(value).over(same))).withColumn("level", F.median(value).over(own))


def pair_statistics(series: DataFrame, cell: list[str], value: str = "y", t: str = "t") -> DataFrame:
    """Per cell: n, s, var_s (with ties), z and the Sen slope, by ranks of pairs that are never held (``pair_ranks``)."""

    def work(y: np.ndarray) -> dict[str, np.ndarray]:
        s, var, n = kendall(y)
        return {"n": n, "s": s, "var_s": var, "z": score(s, var), "slope": PairSlopes(y, np.arange(y.shape[1])).median()}

    got = per_block(series.where(F.col(value).isNotNull()), cell, value, t, work, {"n": "double", "s": "double", "var_s": "double", "z": "double", "slope": "double"})
    return got.withColumn("n", F.col("n").cast("long"))


def autocorrelation(series: DataFrame, cell: list[str], lags: int, value: str = "y", t: str = "t") -> DataFrame:
    """(cell..., lag, rho): autocorrelation by time step, so gaps lower the number of pairs, not their distance.

    Mean and denominator come from all values; a constant series has none.
    """
    rows = series.where(F.col(value).isNotNull()).select(*cell, F.col(t).alias("t"), F.col(value).alias("y"))
    whole = rows.groupBy(*cell).agg(F.avg("y").alias("mean"), (F.var_pop("y") * F.count("*")).alias("square"))
    d = rows.join(whole, cell).withColumn("d", F.col("y") - F.col("mean"))
    ahead = d.select(*cell, F.col("d").alias("d2"), F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"), "t").withColumn("t", F.col("t") - F.col("lag"))
    return d.join(ahead, [*cell, "t"]).where("square > 0").groupBy(*cell, "lag").agg((F.sum(F.col("d") * F.col("d2")) / F.first("square")).alias("rho"))


# --- statistics of a block: rows are cells, columns time steps, NaN is missing


def score(s: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Normal score of S, one step nearer to zero; zero for S = 0, none without variance."""
    with np.errstate(invalid="ignore", divide="ignore"):
        z = np.copysign(np.maximum(np.abs(s) - 1, 0), s) / np.sqrt(np.where(var > 0, var, np.nan))
    return np.where(s == 0, 0.0, z)


def mid_ranks(y: np.ndarray) -> np.ndarray:
    """Ranks with ties at their mean, row by row; NaN keeps none."""
    return pd.DataFrame(y.T).rank().to_numpy().T


def correlogram(y: np.ndarray, lags: int) -> np.ndarray:
    """(cells, lags): autocorrelation at lags 1 .. ``lags`` from the power spectrum of the deviations.

    Missing steps count as no deviation, so a lag has the products of the pairs
    that are there; mean and denominator come from all values. A constant or
    empty row has none.
    """
    there = np.isfinite(y)
    n = there.sum(axis=1, keepdims=True)
    filled = np.where(there, y, 0.0)
    off = np.where(there, filled - filled.sum(axis=1, keepdims=True) / np.maximum(n, 1), 0.0)
    power = np.abs(np.fft.rfft(off, 2 * y.shape[1], axis=1)) ** 2
    products = np.fft.irfft(power, 2 * y.shape[1], axis=1)
    square = (off * off).sum(axis=1, keepdims=True)
    varies = np.ptp(np.where(there, y, filled.max(axis=1, keepdims=True)), axis=1, keepdims=True) > 0
    out = np.full((len(y), lags), np.nan)
    width = min(lags, y.shape[1] - 1)
    np.divide(products[:, 1 : width + 1], square, out=out[:, :width], where=varies & (square > 0))
    return out


def telling(rho: np.ndarray, n: np.ndarray, level: float = 0.05) -> np.ndarray:
    """Autocorrelations outside the band of white noise; the others as zero."""
    band = normal_quantile(1 - level / 2)
    return np.where(np.abs(rho) * np.sqrt(n) > band, rho, 0.0)


def variance_factor(y: np.ndarray, t: np.ndarray, slope: np.ndarray, lags: int) -> np.ndarray:
    """Hamed and Rao: widening of Var(S) by the autocorrelation of the ranks around the trend, at least 1.

    1 + 2 sum_k (n-k)_3 rho_k / (n)_3 over the telling lags, (m)_3 = m (m-1) (m-2).
    None for fewer than three values or where the sum is not positive.
    """
    n = np.isfinite(y).sum(axis=1, keepdims=True)

    def three(m: np.ndarray) -> np.ndarray:
        m = np.maximum(m, 0).astype(float)
        return m * (m - 1) * (m - 2)

    rho = telling(correlogram(mid_ranks(y - np.outer(slope, t)), lags), n)
    out = np.full(len(y), np.nan)
    enough = n[:, 0] > 2
    total = (three(n - np.arange(1, lags + 1)) * rho)[enough].sum(axis=1)
    out[enough] = 1 + 2 * total / three(n[enough, 0])
    return np.where(out > 0, np.maximum(out, 1.0), np.nan)


def whitened(y: np.ndarray, t: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Yue: each value less r1 times the residual of the step before, where r1 is telling; and r1.

    The first step then has nothing before it and is missing.
    """
    rest = y - np.outer(slope, t)
    r1 = correlogram(rest, 1)
    r = telling(r1, np.isfinite(y).sum(axis=1, keepdims=True))
    before = np.pad(rest, ((0, 0), (1, 0)), constant_values=np.nan)[:, :-1]
    return np.where(r == 0, y, y - r * before), r1[:, 0]


def slope_band(slopes: PairSlopes, var: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
    """Slopes at the ranks that S reaches within its normal band; none where a rank does not exist."""
    half = normal_quantile(0.5 + level / 2) * np.sqrt(np.where(var > 0, var, np.nan))
    m = slopes.count
    known = np.isfinite(half)
    low = np.floor((m - np.where(known, half, 0)) / 2).astype(np.int64)
    high = np.ceil((m + np.where(known, half, 0)) / 2).astype(np.int64)
    known &= (low > 0) & (high <= m)
    # 1-based ranks: the low-th, and the one after the high-th as far as there is one
    return slopes.at(np.where(known, low - 1, -1)), slopes.at(np.where(known, np.minimum(high, m - 1), -1))


def per_block(series: DataFrame, cell: list[str], value: str, t: str, work, fields: dict[str, str]) -> DataFrame:
    """Gather each cell's series, lay blocks of cells side by side on their common steps, and add what ``work`` finds."""
    points = F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(t).cast("int").alias("t"), F.col(value).cast("double").alias("y"))))
    packed = series.groupBy(*cell).agg(points.alias("points")).select(*cell, F.col("points.t").alias("ts"), F.col("points.y").alias("ys"))
    span = series.agg(F.min(t).cast("int"), F.max(t).cast("int")).first()
    first, length = (span[0] or 0), (span[1] or 0) - (span[0] or 0) + 1
    block = max(1, PAIRS // max(1, min(length * (length - 1) // 2, SMALL)))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), block):
                part = pdf.iloc[k : k + block]
                y = np.full((len(part), length), np.nan)
                lens = part["ts"].map(len).to_numpy()
                if lens.sum():
                    y[np.repeat(np.arange(len(part)), lens), np.concatenate(part["ts"].to_list()) - first] = np.concatenate(part["ys"].to_list())
                yield part[cell].reset_index(drop=True).assign(**work(y))

    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.select(*cell).schema)
    got = packed.mapInPandas(blocks, keys + "".join(f", {name} {kind}" for name, kind in fields.items()))
    return got.select(*cell, *[F.when(~F.isnan(f), F.col(f)).alias(f) if kind == "double" else F.col(f) for f, kind in fields.items()])


FIELDS = ["slope", "low", "high", "low_hr", "high_hr", "z_mk", "z_hr", "factor_hr", "z_yue", "r1"]
#: Those that need the length for autocorrelations.
LONG_FIELDS = FIELDS[3:5] + FIELDS[6:]


def block_statistics(y: np.ndarray, e: TrendSettings) -> dict[str, np.ndarray]:
    """All statistics of a block; slopes are per year."""
    t, n = np.arange(y.shape[1], dtype=float), np.isfinite(y).sum(axis=1)
    s, var, _ = kendall(y)
    slopes = PairSlopes(y, t)
    b = slopes.median()
    factor = variance_factor(y, t, b, e.hamed_rao_lags)
    white, r1 = whitened(y, t, b)
    s_yue, var_yue, n_yue = kendall(white)
    bands = [x * 12 for v in (var, var * factor) for x in slope_band(slopes, v, e.band_level)]
    z_hr = np.where(np.isfinite(factor) | (s == 0), score(s, var * factor), np.nan)
    z_yue = np.where(n_yue >= e.lengths.autocorrelation, score(s_yue, var_yue), np.nan)
    out = dict(zip(FIELDS, (b * 12, *bands, score(s, var), z_hr, factor, z_yue, r1)))
    for name in FIELDS:
        least = e.lengths.autocorrelation if name in LONG_FIELDS else e.lengths.mann_kendall
        out[name] = np.where(n >= max(least, e.lengths.mann_kendall), out[name], np.nan)
    status = (n >= e.lengths.mann_kendall).astype(np.int32) + (n >= e.lengths.autocorrelation)
    return {"n_valid": n.astype(np.int32), "status": np.where(n >= e.lengths.autocorrelation, 2, status).astype(np.int32)} | out


def series_statistics(series: DataFrame, cell: list[str], value: str = "y", t: str = "t", settings: TrendSettings = TrendSettings()) -> DataFrame:
    """Per cell: n_valid, status (0 too short, 1 Mann-Kendall only, 2 all) and the statistics per year."""
    kinds = {"n_valid": "int", "status": "int"} | dict.fromkeys(FIELDS, "double")
    return per_block(series, cell, value, t, lambda y: block_statistics(y, settings), kinds)


def trend_per_cell(series: DataFrame, cols: int, settings: TrendSettings = TrendSettings()) -> DataFrame:
    """Trend map of (row, col, lat, t, x, share): statistics, significance, agreement and reported groups."""
    e, cell = settings, ["row", "col"]
    month = F.pmod(F.col("t"), F.lit(12)).cast("int") + 1
    rows = series.withColumn("snow", snow_suspected(F.col("lat"), month, F.col("share"), e.snow) & F.col("x").isNotNull())
    snow = rows.groupBy(*cell).agg(F.count_if("snow").alias("n_snow"), F.first("lat").alias("lat"))
    if e.exclude_snow:
        rows = rows.withColumn("x", F.when(~F.col("snow"), F.col("x")))
    rows = deseason(rows, cell, minimum=e.lengths.per_calendar_month)
    level = rows.groupBy(*cell).agg(F.first("level").alias("level"))
    # written once: the significance of each test and the groups read it again
    out = written(series_statistics(rows, cell, settings=e).join(level, cell).join(snow, cell))
    q = alpha_fdr(e.alpha_global)
    for name in ("mk", "hr", "yue"):
        out = out.withColumn(f"p_{name}", two_sided_normal(F.col(f"z_{name}")))
    for name in ("mk", "hr", "yue"):
        out = benjamini_hochberg(out, f"p_{name}", q, [], f"significant_{name}")
    both = F.col("p_hr").isNotNull() & F.col("p_yue").isNotNull()
    agree = both & F.col("significant_hr") & F.col("significant_yue") & (F.signum("z_hr") == F.signum("z_yue"))
    out = out.withColumns(
        {
            "disagree": both & (F.col("significant_hr") != F.col("significant_yue")),
            "trend_both": F.coalesce(agree, F.lit(False)),
            "relative_percent": F.when(F.col("level") >= e.relative_brightness, 100 * F.col("slope") / F.col("level")),
        }
    )
    marked = out.where("trend_both").select(*cell, F.signum("z_hr").cast("int").alias("sign"))
    big = number_groups(label_components(marked, cols, ["sign"]), ["sign"], e.min_cells).where("number > 0").select(*cell, F.lit(True).alias("reported"))
    return out.join(big, cell, "left").withColumn("reported", F.coalesce("reported", F.lit(False)))


def trend_summary(cells: DataFrame) -> DataFrame:
    """Counts and area shares of a trend map, one row."""
    area = cell_area_km2(F.col("lat"))
    tested = F.col("p_hr").isNotNull() & F.col("p_yue").isNotNull()

    def share(mask):
        return F.try_divide(F.sum(F.when(mask & tested, area).otherwise(0.0)), F.sum(F.when(tested, area)))

    counts = [F.count_if(F.col("status") == k).alias(f"n_status_{k}") for k in (0, 1, 2)]
    flags = ["significant_mk", "significant_hr", "significant_yue", "disagree", "trend_both", "reported"]
    return cells.agg(*counts, *[F.count_if(f).alias(f"n_{f}") for f in flags], *[share(F.col(f)).alias(f"share_{f}") for f in flags])
