"""Cell values onto units and countries by area share, with coverage gates and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CrossSectionRules, LinkSettings
from ..functions.quality import cell_class, light_density, observed_share_or_null, snow_suspected
from ..functions.scalars import floor_percent

SHARES = ("not_loaded", "no_data", "insufficient", "undistributed", "snow")


def with_land(bridge: DataFrame) -> DataFrame:
    """Add ``land``, the cell's total share over all units."""
    return bridge.withColumn("land", F.sum("share").over(Window.partitionBy("row", "col")))


def light_per_unit(cells: DataFrame, bridge: DataFrame, e: LinkSettings = LinkSettings()) -> DataFrame:
    """Light and areas per month and unit, all months at once.

    ``cells``: month, row, col, lat, mean_obs, valid, filled, not_loaded. A cell
    missing from the table has no data. Below the coverage gate the total is
    null, the partial sum stays.
    """
    loaded = F.col("not_loaded") if "not_loaded" in cells.columns else F.lit(False)
    klass = cell_class(F.col("mean_obs"), F.col("valid"), F.col("filled"), loaded, e)
    share = observed_share_or_null(F.col("valid"), F.col("filled"))
    c = cells.select("month", "row", "col", klass.alias("k"), light_density(F.col("mean_obs"), F.col("valid"), klass).alias("light"), snow_suspected(F.col("lat"), F.month("month"), share, e.snow).alias("snow_cell"))
    z = with_land(bridge).join(c, ["row", "col"])
    sparse = (F.col("k") == 0) & (F.col("land") < e.min_land)
    counts = (F.col("k") == 0) & ~sparse
    if e.distribution == "normalised":
        amount = F.col("light") * (F.col("area_km2") / F.col("share")) * F.col("share") / F.col("land")
    else:
        amount = F.col("light") * F.col("area_km2")

    def area(mask: Column) -> Column:
        return F.sum(F.when(mask, F.col("area_km2")).otherwise(0.0))

    there = z.groupBy("month", "unit_id").agg(
        F.sum("area_km2").alias("there"), area(counts).alias("area_covered_km2"), area(F.col("k") == 1).alias("not_loaded"), area(F.col("k") == 2).alias("no_data"),
        area(F.col("k") == 3).alias("insufficient"), area(sparse).alias("undistributed"), area(F.coalesce("snow_cell", F.lit(False)) & (F.col("k") == 0)).alias("snow"),
        F.sum(F.when(counts, amount).otherwise(0.0)).alias("light"),
    )
    # absent cells are what the unit's own total leaves over: only units, not cells, meet all months of the calendar
    whole = bridge.groupBy("unit_id").agg(F.sum("area_km2").alias("area_km2"), F.count("*").alias("n_cells"))
    g = whole.crossJoin(F.broadcast(cells.select("month").distinct())).join(there, ["month", "unit_id"], "left").fillna(0.0, ["there", "area_covered_km2", "light", *SHARES])
    left_over = F.greatest(F.col("area_km2") - F.col("there"), F.lit(0.0))
    g = g.withColumn("no_data", F.col("no_data") + F.when(left_over > 1e-12 * F.col("area_km2"), left_over).otherwise(0.0))
    g = g.withColumn("coverage", F.col("area_covered_km2") / F.col("area_km2"))
    partial = F.when(F.col("area_covered_km2") > 0, F.col("light"))
    return g.select(
        "month", "unit_id", "area_km2", "area_covered_km2", "coverage", *[(F.col(s) / F.col("area_km2")).alias(f"share_{s}") for s in SHARES],
        partial.alias("light_covered"), F.when(F.col("coverage") >= e.min_coverage, partial).alias("light_sum"), "n_cells",
    )


def country_view(units: DataFrame, with_unclear: bool = True) -> DataFrame:
    """Units that belong to a country; without unclear ones as the check."""
    view = units.where(F.col("country").isNotNull())
    return view if with_unclear else view.where("clarity <> 'unclear'")


def light_per_country(per_unit: DataFrame, units: DataFrame, purity: DataFrame | None = None, e: LinkSettings = LinkSettings()) -> DataFrame:
    """Units summed to countries: area-weighted shares, coverage gate, purity and a flag text."""
    d = per_unit.join(country_view(units, e.with_unclear).select("unit_id", "country", "clarity", "level"), "unit_id")
    unclear = (F.col("clarity") == "unclear") & F.col("level").startswith("special")
    g = d.groupBy("month", "country").agg(
        F.sum("area_km2").alias("area_km2"), F.sum("area_covered_km2").alias("area_covered_km2"), F.sum("light_covered").alias("light_covered"),
        F.sum(F.when(unclear, F.col("area_km2")).otherwise(0.0)).alias("unclear"), F.count("*").alias("n_units"), F.sum("n_cells").alias("n_cells"),
        *[F.sum(F.col(f"share_{s}") * F.col("area_km2")).alias(s) for s in SHARES],
    )
    w = g.select(
        "month", "country", "area_km2", "area_covered_km2", "light_covered", "n_units", "n_cells", (F.col("area_covered_km2") / F.col("area_km2")).alias("coverage"),
        *[(F.col(s) / F.col("area_km2")).alias(f"share_{s}") for s in SHARES], (F.col("unclear") / F.col("area_km2")).alias("share_unclear"),
    )
    w = w.withColumn("light_sum", F.when(F.col("coverage") >= e.min_coverage, F.col("light_covered")))
    w = w.join(purity.select("country", "purity"), "country", "left") if purity is not None else w.withColumn("purity", F.lit(None).cast("double"))
    return w.withColumn("flags", country_flags(e))


def country_flags(e: LinkSettings = LinkSettings()) -> Column:
    """Flag text of a country row; percentages are floored."""

    def pct(name: str) -> Column:
        return F.concat(floor_percent(F.col(name)).cast("string"), F.lit(" %"))

    gate = int(e.min_coverage * 100 + 1e-9)
    mostly = F.col("share_not_loaded") > 0.5
    return F.concat_ws(
        "; ",
        F.when(mostly, F.concat(F.lit("mostly not loaded ("), pct("share_not_loaded"), F.lit(" of the area)")))
        .when(~F.coalesce(F.col("coverage") > 0, F.lit(False)), "no coverage")
        .when(F.col("coverage") < e.min_coverage, F.concat(F.lit("coverage "), pct("coverage"), F.lit(f" below {gate} %: no country sum"))),
        F.when(F.col("share_undistributed") >= 0.05, F.concat(pct("share_undistributed"), F.lit(" of the area in cells with little land"))),
        F.when(F.col("share_not_loaded").between(0.005, 0.5), F.concat(pct("share_not_loaded"), F.lit(" of the area not loaded"))),
        F.when(F.col("share_insufficient") >= 0.05, F.concat(pct("share_insufficient"), F.lit(" insufficient data"))),
        F.when(F.col("share_snow") >= 0.05, F.concat(F.lit("snow suspected on "), pct("share_snow"))),
        F.when(F.col("share_unclear") >= 0.01, F.concat(pct("share_unclear"), F.lit(" of the area in unclear special units"))),
        F.when(F.col("purity") < e.purity_limit, F.concat(F.lit("mixed cells (purity "), pct("purity"), F.lit(")"))),
    )


def purity(units: DataFrame, bridge: DataFrame, key: str = "country", threshold: float = 0.9) -> DataFrame:
    """Per group: share of its area in cells whose land is mostly the group's."""
    own = bridge.join(units.select("unit_id", key).where(F.col(key).isNotNull()), "unit_id").groupBy(key, "row", "col").agg(F.sum("share").alias("share"), F.sum("area_km2").alias("area"))
    land = bridge.groupBy("row", "col").agg(F.sum("share").alias("land"))
    met = own.join(land, ["row", "col"])
    pure = F.sum(F.when(F.col("share") / F.col("land") >= threshold, F.col("area")).otherwise(0.0))
    return met.groupBy(key).agg(F.sum("area").alias("area_km2"), F.try_divide(pure, F.sum("area")).alias("purity"), F.count("*").alias("cells"))


def smaller_than_a_cell(units: DataFrame, bridge: DataFrame) -> DataFrame:
    """Units whose shares sum to less than one cell, units without any cell included."""
    g = bridge.groupBy("unit_id").agg(F.sum("share").alias("share_sum"), F.count("*").alias("cells"), F.count_if(F.col("share") >= 0.5).alias("cells_half"), F.sum("area_km2").alias("area_km2"))
    zero = {"share_sum": 0.0, "cells": 0, "cells_half": 0, "area_km2": 0.0}
    return units.select("unit_id", "name", "level", "country").join(g, "unit_id", "left").fillna(zero).where("share_sum < 1")


def check_shares(bridge: DataFrame, tolerance: float = 1e-9) -> float:
    """Greatest share sum of a cell; error with the ten worst cells if one exceeds 1."""
    sums = bridge.groupBy("row", "col").agg(F.sum("share").alias("share"))
    worst = sums.where(F.col("share") > 1 + tolerance).orderBy(F.desc("share"), "row", "col").limit(10).collect()
    if worst:
        raise ValueError(f"shares above 1: {[tuple(r) for r in worst]}")
    return sums.agg(F.max("share")).first()[0]


def land_differences(bridge: DataFrame, land: DataFrame) -> DataFrame:
    """Per cell of either table (row, col, land): difference between the units' shares and the land share."""
    sums = bridge.groupBy("row", "col").agg(F.sum("share").alias("share"))
    both = sums.join(land, ["row", "col"], "full")
    return both.select("row", "col", F.abs(F.coalesce("share", F.lit(0.0)) - F.coalesce("land", F.lit(0.0))).alias("difference"))


def missing_units(bridge: DataFrame, units: DataFrame) -> DataFrame:
    """Bridge rows whose unit is unknown; must be empty."""
    return bridge.join(units, "unit_id", "left_anti")


def region_per_country(units: DataFrame, bridge: DataFrame) -> DataFrame:
    """Region that holds most of the country's area; ties go to the first by name."""
    area = bridge.groupBy("unit_id").agg(F.sum("area_km2").alias("area_km2"))
    g = country_view(units).where("m49_region <> ''").join(area, "unit_id").groupBy("country", "m49_region").agg(F.sum("area_km2").alias("area"))
    first = F.row_number().over(Window.partitionBy("country").orderBy(F.desc("area"), "m49_region"))
    return g.withColumn("k", first).where("k = 1").select("country", F.col("m49_region").alias("region"))


def land_and_continent(bridge: DataFrame, units: DataFrame) -> DataFrame:
    """Per cell: land share (at most 1), continent of the greatest share, and that share."""
    z = bridge.join(units.select("unit_id", "m49_region"), "unit_id", "left")
    land = z.groupBy("row", "col").agg(F.least(F.sum("share"), F.lit(1.0)).alias("land"))
    by = z.where("m49_region <> ''").groupBy("row", "col", "m49_region").agg(F.sum("share").alias("share"))
    first = F.row_number().over(Window.partitionBy("row", "col").orderBy(F.desc("share"), "m49_region"))
    top = by.withColumn("k", first).where("k = 1").select("row", "col", F.col("m49_region").alias("continent"), F.col("share").alias("continent_share"))
    return land.join(top, ["row", "col"], "left").select("row", "col", "land", F.coalesce("continent", F.lit("")).alias("continent"), F.coalesce("continent_share", F.lit(0.0)).alias("continent_share"))


# --- a year of cells, and countries by it


def cell_year(cells: DataFrame, r: CrossSectionRules = CrossSectionRules()) -> DataFrame:
    """Per (year, row, col): yearly value of good months, estimate of all months, counts, not loaded at any time."""
    loaded = F.col("not_loaded") if "not_loaded" in cells.columns else F.lit(False)
    klass = cell_class(F.col("mean_obs"), F.col("valid"), F.col("filled"), loaded, r.link)
    share = observed_share_or_null(F.col("valid"), F.col("filled"))
    good = (klass == 0) & ~snow_suspected(F.col("lat"), F.month("month"), share, r.link.snow)
    any_ = (klass != 1) & (F.col("valid") > 0) & F.col("mean_obs").isNotNull()
    light = F.col("mean_obs") * F.col("valid") / 3600.0
    g = cells.groupBy(F.year("month").alias("year"), "row", "col").agg(
        F.first("lat").alias("lat"), F.sum(F.when(good, light)).alias("s_good"), F.count_if(good).alias("n_good"), F.sum(F.when(any_, light)).alias("s_any"), F.count_if(any_).alias("n_any"), F.bool_or(loaded).alias("not_loaded"),
    )
    return g.select("year", "row", "col", "lat", F.when(F.col("n_good") >= r.min_good_months, F.col("s_good") / F.col("n_good")).alias("year_value"), F.when(F.col("n_any") > 0, F.col("s_any") / F.col("n_any")).alias("estimate"), "n_good", "not_loaded")


def cell_country_weights(units: DataFrame, bridge: DataFrame, cell_area: Column | None = None, r: CrossSectionRules = CrossSectionRules()) -> DataFrame:
    """Per (country, cell): weight of the cell for the country, and whether the cell is the country's alone."""
    e = r.link
    z = with_land(bridge).join(country_view(units, e.with_unclear).select("unit_id", "country"), "unit_id")
    t = z.groupBy("country", "row", "col").agg(F.sum("share").alias("share"), F.sum("area_km2").alias("area_km2"), F.first("land").alias("land"), F.max(F.col("area_km2") / F.col("share")).alias("cell_km2"))
    size = cell_area if cell_area is not None else F.col("cell_km2")
    w = size * F.col("share") / F.col("land") if e.distribution == "normalised" else F.col("area_km2")
    spread = F.col("land") >= e.min_land
    return t.select("country", "row", "col", "share", "area_km2", "land", F.when(spread, w).otherwise(0.0).alias("weight_km2"), spread.alias("distributed"), (F.col("share") / F.col("land") >= r.pure_from).alias("pure"))


def country_year(weights: DataFrame, years: DataFrame, r: CrossSectionRules = CrossSectionRules()) -> DataFrame:
    """Per (year, country): light and its coverage, purity and doubtful shares. Cells without a row have no value."""
    every = weights.crossJoin(F.broadcast(years.select("year").distinct()))
    z = every.join(years, ["year", "row", "col"], "left")
    a, s, w = F.col("year_value"), F.col("estimate"), F.col("weight_km2")
    has = a.isNotNull()
    light = F.when(has, a * w).otherwise(0.0)
    area = F.col("area_km2")

    def part(mask: Column, x: Column) -> Column:
        return F.sum(F.when(F.coalesce(mask, F.lit(False)), x).otherwise(0.0))

    g = z.groupBy("year", "country").agg(
        F.sum(light).alias("light_sum"), F.sum(F.coalesce(a * w, s * w, F.lit(0.0))).alias("reference"), part(F.col("pure"), light).alias("light_pure"),
        part(has & (F.col("n_good") <= r.few_months_up_to), light).alias("few"), part(F.col("lat") > r.north_limit, light).alias("north"), F.sum(area).alias("area_km2"),
        part(~has & s.isNull() & (w > 0), area).alias("unmeasured"), part(F.col("not_loaded"), area).alias("area_not_loaded"), part(~has, area).alias("no_value"),
    )
    return g.select(
        "year", "country", "light_sum", "light_pure", "area_km2", "area_not_loaded", F.try_divide("light_sum", "reference").alias("light_coverage"), F.try_divide("light_pure", "light_sum").alias("light_purity"),
        F.try_divide("few", "light_sum").alias("share_few_months"), F.try_divide("north", "light_sum").alias("share_north"), F.try_divide("no_value", "area_km2").alias("share_no_value"), F.try_divide("unmeasured", "area_km2").alias("share_unmeasured"),
    )
