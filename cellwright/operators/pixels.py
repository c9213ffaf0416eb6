"""Pixels to cells: block means with three counters, conservative regridding, daily to monthly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.months import days_in
from ..functions.scalars import clear_night, valid_or_null

# Fill values of the raw products, and the quality code of gap-filled pixels.
FILL_VALUE, FILL_NUM, FILL_GRID = -999.9, 65535, -9999.9
GAP_FILLED = 2
PIXELS_PER_TILE, PIXELS_PER_CELL = 2400, 60


def reduce_tiles(pixels: DataFrame) -> DataFrame:
    """(h, v, py, px, value, num, quality) to cells: means of valid and observed pixels, mean num, counters."""
    value = valid_or_null(F.col("value"), (FILL_VALUE,), 1e-2)
    num = F.when(F.col("num") != FILL_NUM, F.col("num"))
    per = PIXELS_PER_TILE // PIXELS_PER_CELL
    row = F.col("v") * per + F.floor(F.col("py") / PIXELS_PER_CELL)
    col = F.col("h") * per + F.floor(F.col("px") / PIXELS_PER_CELL)
    rows = pixels.select(row.cast("int").alias("row"), col.cast("int").alias("col"), value.cast("double").alias("x"), num.alias("num"), (F.col("quality") == GAP_FILLED).alias("gap"))
    ok, gap = F.col("x").isNotNull(), F.coalesce("gap", F.lit(False))
    return rows.groupBy("row", "col").agg(
        F.avg("x").alias("mean"), F.avg(F.when(~gap, F.col("x"))).alias("mean_observed"), F.avg(F.when(ok, F.col("num"))).alias("num"),
        F.count_if(ok).alias("valid"), F.count_if(ok & ~gap).alias("observed"), F.count_if(ok & gap).alias("filled"),
    )


def check_tiles(files: DataFrame) -> None:
    """Error if the files (month, h, v) repeat a tile or hold more than one month."""
    if files.select("month").distinct().count() > 1:
        raise ValueError("files of more than one month")
    twice = files.groupBy("h", "v").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError(f"tiles that repeat: {[tuple(r) for r in twice.select('h', 'v').limit(5).collect()]}")


def overlaps(spark: SparkSession, n_target: int, target_ticks: int, n_source: int, source_ticks: int) -> DataFrame:
    """(target, source, t0, t1): overlap of two 1-D grids from a common edge, in whole ticks."""
    if n_target * target_ticks != n_source * source_ticks:
        raise ValueError("grids do not cover the same range")
    t = spark.range(n_target).select(F.col("id").cast("int").alias("target"), (F.col("id") * target_ticks).alias("a"))
    s = t.withColumn("source", F.explode(F.sequence(F.floor(F.col("a") / source_ticks), F.floor((F.col("a") + target_ticks - 1) / source_ticks))))
    return s.select("target", F.col("source").cast("int").alias("source"), F.greatest("a", F.col("source") * source_ticks).cast("int").alias("t0"), F.least(F.col("a") + target_ticks, (F.col("source") + 1) * source_ticks).cast("int").alias("t1"))


def lat_weights(spark: SparkSession, n_target: int = 720, target_ticks: int = 5, n_source: int = 1800, source_ticks: int = 2, tick: float = 0.05) -> DataFrame:
    """(m, i, w): area weights of source row i in target row m, south to north."""
    w = F.sin(F.radians(-90.0 + F.col("t1") * tick)) - F.sin(F.radians(-90.0 + F.col("t0") * tick))
    return overlaps(spark, n_target, target_ticks, n_source, source_ticks).select(F.col("target").alias("m"), F.col("source").alias("i"), w.alias("w_lat"))


def lon_weights(spark: SparkSession, n_target: int = 1440, target_ticks: int = 5, n_source: int = 3600, source_ticks: int = 2) -> DataFrame:
    w = (F.col("t1") - F.col("t0")).cast("double")
    return overlaps(spark, n_target, target_ticks, n_source, source_ticks).select(F.col("target").alias("n"), F.col("source").alias("j"), w.alias("w_lon"))


def regrid(pixels: DataFrame, w_lat: DataFrame, w_lon: DataFrame, means: tuple = (), weighted: dict | None = None, minima: tuple = (), by: tuple = ()) -> DataFrame:
    """(by..., i, j, values) to target cells (by..., m, n).

    For each of ``means``: area-weighted mean, valid area share and number of
    valid pixels; for each of ``weighted`` (value to weight column): mean
    weighted by area times the weight, null for a dry cell; for each of
    ``minima``: least valid value. Both weight tables have a few rows per axis
    step and are joined one after the other.
    """
    met = pixels.join(F.broadcast(w_lat), "i").join(F.broadcast(w_lon), "j").withColumn("w", F.col("w_lat") * F.col("w_lon"))
    w, aggs = F.col("w"), []
    for c in means:
        ok = F.col(c).isNotNull()
        aggs += [F.try_divide(F.sum(w * F.col(c)), F.sum(F.when(ok, w))).alias(c), F.coalesce(F.least(F.lit(1.0), F.sum(F.when(ok, w)) / F.sum(w)), F.lit(0.0)).alias(f"{c}_share"), F.count_if(ok).alias(f"{c}_pixels")]
    for c, by_col in (weighted or {}).items():
        u = F.when(F.col(c).isNotNull() & F.col(by_col).isNotNull(), w * F.col(by_col))
        aggs.append(F.when(F.sum(u) > 0, F.try_divide(F.sum(u * F.col(c)), F.sum(u))).alias(c))
    aggs += [F.min(c).alias(f"{c}_min") for c in minima]
    return met.groupBy(*by, "m", "n").agg(*aggs)


def to_month_total(rate: Column, month: Column) -> Column:
    """mm/h to mm/month."""
    return rate * 24 * days_in(month)


def monthly_from_days(days: DataFrame, key: list[str], value: str = "value", fence: float = 1.5, noise: float = 0.5, least: int = 1) -> DataFrame:
    """Nights of good quality to one value per key: Tukey fence, mean, small means to zero.

    ``days``: key..., value, quality, snow, cloud_mask.
    """
    good = days.where((F.col("quality") == 0) & (F.col("snow") == 0) & clear_night(F.col("cloud_mask")) & F.col(value).isNotNull())
    q = good.withColumn("q", F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).over(Window.partitionBy(*key)))
    low, high = F.col("q")[0], F.col("q")[1]
    inside = q.where(F.col(value).between(low - fence * (high - low), high + fence * (high - low)))
    g = inside.groupBy(*key).agg(F.avg(value).alias("mean"), F.count("*").alias("nights")).where(F.col("nights") >= least)
    return g.select(*key, F.when(F.col("mean") < noise, 0.0).otherwise(F.col("mean")).alias(value), "nights")


def composite(months: DataFrame, coverage: str = "cf_cvg", least: int = 1) -> DataFrame:
    return months.where(F.col(coverage) >= least)


def to_grid(pixels: DataFrame, lat: str = "lat", lon: str = "lon", value: str = "value", step: float = 0.25, by: tuple = ()) -> DataFrame:
    """Pixels (null value = invalid) to cells: mean value and valid share."""
    from ..functions.grid import cell_of

    row, col = cell_of(F.col(lat), F.col(lon), step)
    return pixels.groupBy(*by, row.alias("row"), col.alias("col")).agg(F.avg(value).alias("value"), F.avg(F.col(value).isNotNull().cast("int")).alias("share"))


