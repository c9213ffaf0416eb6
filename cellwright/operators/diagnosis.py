"""Diagnosis of a rise: baselines, levels, month and year indices, stable and dark reference cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DiagnosisRules
from ..functions.grid import cell_area_km2, tile_number
from ..functions.months import month_index
from ..functions.quality import brightness_class, observed_share, snow_suspected
from .components import written
from .resampling import drawn

CELL = ["row", "col"]


def prepared(cells: DataFrame, r: DiagnosisRules = DiagnosisRules(), value: str = "mean_obs", step: float = 0.25) -> DataFrame:
    """Cell-months with validity, baseline of the calendar month, level, class, area and tile."""
    share = observed_share(F.col("valid"), F.col("filled"))
    ok = F.col(value).isNotNull() & (share >= r.min_observed) & ~snow_suspected(F.col("lat"), F.month("month"), share)
    rows = cells.select("month", *CELL, "lat", F.col(value).cast("double").alias("x"), ok.alias("ok"))
    base = rows.where(F.col("ok") & F.year("month").isin(*r.base_years))
    per_month = base.groupBy(*CELL, F.month("month").alias("mo")).agg(F.median("x").alias("m"), F.count("*").alias("n"))
    per_month = per_month.select(*CELL, "mo", F.when(F.col("n") >= r.min_base_years, F.col("m")).alias("base"))
    level = base.groupBy(*CELL).agg(F.median("x").alias("m"), F.count("*").alias("n")).select(*CELL, F.when(F.col("n") >= r.min_level_months, F.col("m")).alias("level"))
    out = rows.withColumn("mo", F.month("month")).join(per_month, [*CELL, "mo"], "left").join(level, CELL, "left").drop("mo")
    usable = F.coalesce(F.col("ok") & (F.col("base") >= r.min_base_value), F.lit(False))
    return out.withColumns({"usable": usable, "class": brightness_class(F.col("level"), r), "area": cell_area_km2(F.col("lat"), step), "tile": tile_number(F.col("row"), F.col("col"))})


def month_index_of(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Per month and group: area sum over that of the baseline, unweighted median ratio, cells."""
    u = rows.where("usable")
    g = u.groupBy("month", *by).agg(F.sum(F.col("area") * F.col("x")).alias("sx"), F.sum(F.col("area") * F.col("base")).alias("sb"), F.median(F.col("x") / F.col("base")).alias("median_ratio"), F.count("*").alias("cells"))
    return g.select("month", *by, F.try_divide("sx", "sb").alias("index"), "median_ratio", "cells")


def groups_of(rows: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """One row per cell-month and group it belongs to; a cell may belong to several."""
    each = F.array(*[F.struct(F.lit(n).alias("group"), F.coalesce(c, F.lit(False)).alias("in_it")) for n, c in groups.items()])
    return rows.withColumn("g", F.explode(F.filter(each, lambda s: s["in_it"]))).withColumn("group", F.col("g.group")).drop("g")


def year_index_bootstrap(rows: DataFrame, r: DiagnosisRules = DiagnosisRules()) -> tuple[DataFrame, DataFrame]:
    """(points, replicates): pooled index per year, and per (replicate, year) under multinomial tile weights.

    Only sums per tile and year meet the draws.
    """
    sums = rows.where("usable").groupBy(F.year("month").alias("year"), "tile").agg(F.sum(F.col("area") * F.col("x")).alias("sx"), F.sum(F.col("area") * F.col("base")).alias("sb"))
    sums = written(sums)
    points = sums.groupBy("year").agg(F.try_divide(F.sum("sx"), F.sum("sb")).alias("index"))
    again = sums.join(drawn(sums, "tile", r.bootstrap, r.seed), "tile")
    boot = again.groupBy("replicate", "year").agg(F.try_divide(F.sum(F.col("times") * F.col("sx")), F.sum(F.col("times") * F.col("sb"))).alias("index"))
    return points, boot


def year_intervals(points: DataFrame, boot: DataFrame) -> DataFrame:
    q = boot.groupBy("year").agg(F.percentile("index", 0.025).alias("low"), F.percentile("index", 0.975).alias("high"))
    return points.join(q, "year")


def ratio_interval(points: DataFrame, boot: DataFrame, year: int, to: int) -> DataFrame:
    """Ratio of two years with its bootstrap interval, one row."""
    def at(y: int) -> Column:
        return F.max(F.when(F.col("year") == y, F.col("index")))

    value = points.agg(F.try_divide(at(year), at(to)).alias("ratio"))
    each = boot.groupBy("replicate").agg(F.try_divide(at(year), at(to)).alias("r"))
    return value.crossJoin(each.agg(F.percentile("r", 0.025).alias("low"), F.percentile("r", 0.975).alias("high")))


def dark_reference(rows: DataFrame, land: DataFrame, r: DiagnosisRules = DiagnosisRules()) -> DataFrame:
    """Cells that stayed dark in all base years, on land in the desert belts."""
    base = rows.where(F.col("ok") & F.year("month").isin(*r.base_years)).groupBy(*CELL).agg(F.max("x").alias("top"), F.count("*").alias("n"), F.first("lat").alias("lat"))
    ok = F.abs("lat").between(*r.r1_lat) & (F.col("n") >= r.r1_min_months) & (F.col("top") < r.r1_max)
    return base.join(land.where(F.col("land") >= r.r1_land), CELL, "left_semi").where(ok).select(*CELL)


def stable_reference(rows: DataFrame, r: DiagnosisRules = DiagnosisRules()) -> DataFrame:
    """(row, col, deviation, rule): bright cells near their baseline in every base year.

    With too few of them, the most stable tenth of the eligible cells.
    """
    base = rows.where(F.col("usable") & F.year("month").isin(*r.base_years)).withColumn("year", F.year("month"))
    per_year = base.groupBy(*CELL, "year").agg(F.avg(F.col("x") / F.col("base")).alias("mean"), F.count("*").alias("n"))
    g = per_year.groupBy(*CELL).agg(F.max(F.abs(F.log(F.when(F.col("mean") > 0, F.col("mean"))))).alias("deviation"), F.min("n").alias("least"), F.count("*").alias("years"), F.sum("n").alias("n"))
    cells = rows.select(*CELL, "lat", "class").distinct()
    fit = g.join(cells, CELL).where((F.col("class") == "bright") & (F.abs("lat") < r.r2_lat) & (F.col("n") >= r.r2_min_months) & (F.col("least") >= r.r2_per_year) & (F.col("years") == len(r.base_years)))
    n_main, n_all = fit.agg(F.count_if(F.col("deviation") <= r.r2_deviation), F.count("*")).first()
    if n_main >= r.r2_min_cells:
        return fit.where(F.col("deviation") <= r.r2_deviation).select(*CELL, "deviation", F.lit("main").alias("rule"))
    k = max(1, int(np.ceil(r.r2_fallback * n_all)))
    return fit.orderBy("deviation", *CELL).limit(k).select(*CELL, "deviation", F.lit("fallback").alias("rule"))


def quarter_steps(series: DataFrame, month: str = "month", y: str = "y") -> DataFrame:
    """Steps between quarters: kind 'boundary' (first quarter less the last of the year before) and 'inner'.

    Steps between quarters that do not follow each other are left out.
    """
    q = series.where(F.col(y).isNotNull()).groupBy((F.year(month) * 4 + F.quarter(month) - 1).alias("q")).agg(F.avg(y).alias("mean"))
    w = Window.orderBy("q")  # one row per quarter
    s = q.withColumn("before", F.lag("q").over(w)).withColumn("step", F.col("mean") - F.lag("mean").over(w)).where("q = before + 1")
    return s.select(F.floor(F.col("q") / 4).cast("int").alias("year"), (F.col("q") % 4 + 1).cast("int").alias("quarter"), F.when(F.col("q") % 4 == 0, "boundary").otherwise("inner").alias("kind"), "step")


def quarter_contrast(series: DataFrame, month: str = "month", y: str = "y") -> DataFrame:
    """Mean, population deviation and number of the steps of each kind."""
    return quarter_steps(series, month, y).groupBy("kind").agg(F.avg("step").alias("mean"), F.stddev_pop("step").alias("sd"), F.count("*").alias("n"))


def panel_series(rows: DataFrame, r: DiagnosisRules = DiagnosisRules(), without: tuple = ()) -> DataFrame:
    """(month, y, cells): log of the area sum over the cells that are valid in every month used."""
    t = month_index(F.col("month"))
    used = rows.where(~t.isin(*without)) if without else rows
    months = used.select("month").distinct().count()
    fixed = used.where("ok").groupBy(*CELL).agg(F.count("*").alias("n"), F.first("level").alias("level"), F.first("lat").alias("lat"))
    fixed = fixed.where((F.col("n") == months) & (F.col("level") >= r.dark_to) & (F.abs("lat") < r.panel_lat)).select(*CELL)
    return used.join(fixed, CELL, "left_semi").groupBy("month").agg(F.log(F.sum(F.col("area") * F.col("x"))).alias("y"), F.count("*").alias("cells"))


def largest_changes(series: DataFrame, k: int = 6, month: str = "month", y: str = "y") -> DataFrame:
    """The k largest month-to-month changes between months that follow each other."""
    w = Window.orderBy("t")  # one row per month
    rows = series.withColumn("t", month_index(F.col(month))).withColumn("before", F.lag("t").over(w)).withColumn("change", F.col(y) - F.lag(y).over(w))
    return rows.where("t = before + 1 and change is not null").orderBy(F.desc(F.abs("change")), month).limit(k).select(month, "change")


def mid_ranks(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Ranks with ties at their mean."""
    w = Window.partitionBy(*by).orderBy(value)
    return df.withColumn(out, F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0)


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation per group; null below three pairs or without spread."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = mid_ranks(mid_ranks(rows, by, x, "__rx"), by, y, "__ry")
    ok = (F.count("*") >= 3) & (F.var_pop("__rx") > 0) & (F.var_pop("__ry") > 0)
    r = F.try_divide(F.covar_pop("__rx", "__ry"), F.sqrt(F.var_pop("__rx") * F.var_pop("__ry")))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(ok, r).alias("rho"))


def source_verdict(rows: DataFrame, same_from: float = 2 / 3, none_below: float = 1 / 3, least: float = 0.05) -> DataFrame:
    """Compare the rise in a second source (rise_ref, rise_cand): same, partial, none or no rise to judge."""
    share = F.try_divide("rise_cand", "rise_ref")
    verdict = F.when(F.col("rise_ref") < least, "no rise").when(share >= same_from, "same").when(share < none_below, "none").otherwise("partial")
    return rows.withColumn("share", share).withColumn("verdict", verdict)


def version_share(days: DataFrame, version: str) -> DataFrame:
    """(day, counters map of 'version ...' to number) to the version's share per month."""
    each = days.select(F.substring("day", 1, 7).alias("month"), F.explode("counters").alias("name", "n"))
    new = F.element_at(F.split("name", r"\s+"), 1) == version
    return each.groupBy("month").agg((F.sum(F.when(new, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
