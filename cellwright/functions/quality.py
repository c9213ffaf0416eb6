"""Masks and classes of cell-months. Two rules for inconsistent counters are kept apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Criteria, DiagnosisRules, LinkSettings, SeriesRules, SnowRule, Thresholds


def observed_share(valid: Column, filled: Column, pixels: int = 3600) -> Column:
    """For detection: filled pixels never count; inconsistent counters give 0."""
    v, f = F.coalesce(valid, F.lit(0)), F.coalesce(filled, F.lit(0))
    return F.when((f < 0) | (f > v), F.lit(0.0)).otherwise(F.greatest(v - f, F.lit(0)) / float(pixels))


def observed_share_or_null(valid: Column, filled: Column, pixels: int = 3600) -> Column:
    """For linking and trend: inconsistent or empty counters give null."""
    return F.when((valid > 0) & (filled >= 0) & (filled <= valid), (valid - filled) / float(pixels))


def snow_suspected(lat: Column, month: Column, share: Column, rule: SnowRule = SnowRule()) -> Column:
    """Winter of the hemisphere, away from the tropics, poorly observed; unknown share is no suspicion."""
    winter = F.when(lat >= 0, month.isin(*rule.winter_north)).otherwise(month.isin(*rule.winter_south))
    return F.coalesce((F.abs(lat) >= rule.min_lat) & winter & (share < rule.observed_below), F.lit(False))


def cell_class(mean: Column, valid: Column, filled: Column, not_loaded: Column, e: LinkSettings = LinkSettings()) -> Column:
    """0 valid, 1 not loaded, 2 no data, 3 insufficient; not loaded overrides, then no data."""
    v = F.coalesce(valid, F.lit(0))
    share = observed_share_or_null(v, F.coalesce(filled, F.lit(0)))
    return (
        F.when(F.coalesce(not_loaded, F.lit(False)), 1)
        .when((v <= 0) | share.isNull(), 2)
        .when((share < e.min_observed) | mean.isNull(), 3)
        .otherwise(0)
    )


def light_density(mean: Column, valid: Column, klass: Column, pixels: int = 3600) -> Column:
    return F.when(klass == 0, mean * valid / float(pixels))


def brightness_class(level: Column, r: DiagnosisRules = DiagnosisRules()) -> Column:
    return F.when(level < r.dark_to, "dark").when(level < r.medium_to, "medium").when(level >= r.medium_to, "bright").otherwise("")


def band(z: Column, s: Thresholds = Thresholds()) -> Column:
    """1 noticeable, 2 strong, 3 extreme, of a marked cell."""
    return F.when(F.abs(z) >= s.z_extreme, 3).when(F.abs(z) >= s.z_strong, 2).otherwise(1)


def month_status(coverage: Column, snow: Column, not_loaded: Column, partial: Column, r: SeriesRules = SeriesRules()) -> Column:
    """not_loaded, none, low, snow or valid, in this order of precedence."""
    return (
        F.when(not_loaded >= r.not_loaded_from, "not_loaded")
        .when(coverage.isNull() | (coverage <= 0) | partial.isNull(), "none")
        .when(coverage < r.min_coverage, "low")
        .when(snow >= r.snow_from, "snow")
        .otherwise("valid")
    )


def year_value_check(light: Column, coverage: Column, area_not_loaded: Column, present: Column, r: SeriesRules = SeriesRules()) -> Column:
    """(valid, reason) of a country's yearly value."""
    reason = (
        F.when(~present, "no cell in the bridge")
        .when(area_not_loaded > 0, "parts of the country are not loaded yet")
        .when(~F.coalesce(light > 0, F.lit(False)), "light sum is 0 or cannot be determined")
        .when(~F.coalesce(coverage >= r.min_coverage, F.lit(False)), F.concat(F.lit("only "), F.coalesce(F.floor(coverage * 100 + 1e-9).cast("string"), F.lit("?")), F.lit(" % of the light has a valid yearly value")))
        .otherwise("")
    )
    return F.struct((reason == "").alias("valid"), reason.alias("reason"))


def usable(valid_share: Column, minimum: float = 0.5) -> Column:
    return F.coalesce(valid_share >= minimum, F.lit(False))


def reduced_quality(lat: Column, beyond: float = 60.0) -> Column:
    return F.abs(lat) > beyond


def comparison_class(ref: Column, c: Criteria = Criteria()) -> Column:
    return F.when(ref < c.dark_to, "dark").when(ref < c.medium_to, "medium").otherwise("bright")
