"""Cubes with known truth: level, season, growth, noise, events, unfinished and half-written months."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.months import axis


@dataclass(frozen=True)
class Event:
    month: str
    rows: tuple[int, int]
    cols: tuple[int, int]
    factor: float = 1.0
    add: float = 0.0
    months: int = 1
    filled: float = 0.0
    valid: int | None = None


def synthetic_cube(spark: SparkSession, rows: int = 40, cols: int = 80, first: str = "2013-01", last: str = "2025-12", seed: int = 0, lat0: float = 60.0, step: float = 0.25, brightness: float = 20.0, spread: float = 0.8, season: float = 0.3, noise: float = 0.05, growth: float = 0.0, ar1: float = 0.0, events: tuple = (), unfinished: tuple = (), half_written: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """(cube, states). Random numbers are hashes of cell, month and seed, so any partitioning gives the same cube."""

    def normal(tag: str, *cols_):
        u = [(F.pmod(F.xxhash64(F.lit(f"{tag}{k}{seed}"), *cols_), F.lit(1 << 52)) + 0.5) / float(1 << 52) for k in "ab"]
        return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * 3.141592653589793 * u[1])

    months = axis(spark, first, last)
    first_t = int(first[:4]) * 12 + int(first[5:]) - 1
    cells = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    cells = cells.withColumns({"lat": lat0 - step / 2 - F.col("row") * step, "lon": -180 + step / 2 + F.col("col") * step, "level": brightness * F.exp(spread * normal("level", F.col("row"), F.col("col")))})
    cube = cells.crossJoin(F.broadcast(months))
    eps = normal("noise", F.col("row"), F.col("col"), F.col("t"))
    if ar1:
        # the process from its last 24 shocks, scaled to unit variance
        shocks = [ar1**k * normal("noise", F.col("row"), F.col("col"), F.col("t") - k) for k in range(24)]
        eps = sum(shocks[1:], shocks[0]) * (1 - ar1**2) ** 0.5
    x = F.col("level") * (1 + season * F.cos(2 * 3.141592653589793 * (F.col("t") % 12) / 12)) * F.pow(F.lit(1 + growth), (F.col("t") - first_t) / 12) * (1 + noise * eps)
    valid, filled = F.lit(3600), F.lit(0)
    for e in events:
        t0 = int(e.month[:4]) * 12 + int(e.month[5:]) - 1
        here = F.col("t").between(t0, t0 + e.months - 1) & F.col("row").between(e.rows[0], e.rows[1] - 1) & F.col("col").between(e.cols[0], e.cols[1] - 1)
        x = F.when(here, x * e.factor + e.add).otherwise(x)
        if e.valid is not None:
            valid = F.when(here, e.valid).otherwise(valid)
        if e.filled:
            filled = F.when(here, F.lit(int(3600 * e.filled))).otherwise(filled)
    text = F.date_format("month", "yyyy-MM")
    open_ = text.isin(*unfinished) if unfinished else F.lit(False)
    x = F.when(~open_ & (valid - filled > 0), F.greatest(x, F.lit(0.0)).cast("float"))
    cube = cube.select("month", "row", "col", "lat", "lon", x.alias("mean_obs"), F.when(open_, 0).otherwise(valid).cast("int").alias("valid"), F.when(open_, 0).otherwise(filled).cast("int").alias("filled"))
    not_ready = [*unfinished, *half_written]
    states = months.select("month", F.when(text.isin(*not_ready), 0).otherwise(1).alias("state") if not_ready else F.lit(1).alias("state"))
    return cube, states
