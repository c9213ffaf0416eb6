"""Country time series: status, trailing mean, seasonal deviation, index and nested result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SeriesRules
from ..functions.months import month_index, month_text
from ..functions.quality import month_status, year_value_check
from ..functions.scalars import floor_percent, significant


def with_status(rows: DataFrame, r: SeriesRules = SeriesRules()) -> DataFrame:
    """Add status and the shown value of country-months: the total, below the coverage gate the partial sum."""
    status = month_status(F.col("coverage"), F.col("share_snow"), F.col("share_not_loaded"), F.col("light_covered"), r)
    rows = rows.withColumn("status", status)
    shown = F.when(F.col("status").isin("valid", "snow"), F.col("light_sum")).when(F.col("status") == "low", F.col("light_covered"))
    return rows.withColumn("shown", shown)


def trailing_mean(rows: DataFrame, key: list[str], value: str, r: SeriesRules = SeriesRules()) -> DataFrame:
    """Rows whose last ``window`` calendar months are all valid, with their mean; a gap gives no row."""
    t = month_index(F.col("month"))
    ok = F.when((F.col("status") == "valid"), F.col(value))
    span = Window.partitionBy(*key).orderBy("t").rangeBetween(-(r.window - 1), 0)
    out = rows.withColumn("t", t).withColumn("n", F.count(ok).over(span)).withColumn("mean", F.avg(ok).over(span))
    return out.where(F.col("n") == r.window).select(*key, "month", "mean")


def seasonal_deviation(rows: DataFrame, key: list[str], value: str, r: SeriesRules = SeriesRules()) -> DataFrame:
    """Deviation from the median of the calendar month, of keys with enough valid values in all twelve."""
    ok = rows.where((F.col("status") == "valid") & F.col(value).isNotNull()).withColumn("mo", F.month("month"))
    per = ok.groupBy(*key, "mo").agg(F.count("*").alias("n"), F.median(value).alias("med"))
    enough = per.groupBy(*key).agg(F.count("*").alias("months"), F.min("n").alias("least")).where((F.col("months") == 12) & (F.col("least") >= r.per_calendar_month))
    return ok.join(enough.select(*key), key).join(per, [*key, "mo"]).select(*key, "month", (F.col(value) - F.col("med")).alias("deviation"))


def seasonal_check(rows: DataFrame, key: list[str], value: str, r: SeriesRules = SeriesRules()) -> DataFrame:
    """Per key: whether the seasonal deviation can be determined, least count and short calendar months."""
    ok = (F.col("status") == "valid") & F.col(value).isNotNull()
    counts = [F.count_if(ok & (F.month("month") == m)) for m in range(1, 13)]
    g = rows.groupBy(*key).agg(F.array(*counts).alias("counts"))
    short = F.size(F.filter("counts", lambda n: n < r.per_calendar_month))
    return g.select(*key, "counts", F.array_min("counts").alias("least"), short.alias("short_months"), (short == 0).alias("determinable"))


def index_to_base(rows: DataFrame, key: list[str], year: str, value: str, base: int) -> DataFrame:
    """Value as a percentage of the base year, half to even; keys without a positive base give no row."""
    at_base = F.max(F.when(F.col(year) == base, F.col(value))).over(Window.partitionBy(*key))
    out = rows.withColumn("base", at_base).where((F.col("base") > 0) & F.col(value).isNotNull())
    return out.select(*key, year, F.rint(100.0 * F.col(value) / F.col("base")).cast("int").alias("index"))


def checked_years(rows: DataFrame, r: SeriesRules = SeriesRules()) -> DataFrame:
    """Country-years with (valid, reason)."""
    check = year_value_check(F.col("light_sum"), F.col("light_coverage"), F.col("area_not_loaded"), F.lit(True), r)
    return rows.withColumn("check", check).select("*", "check.valid", "check.reason").drop("check")


def per_head_allowed(indicators: DataFrame) -> DataFrame:
    """Countries none of whose rows are marked not to be used."""
    return indicators.groupBy("country").agg((~F.bool_or("do_not_use")).alias("per_head_allowed"))


def country_documents(months: DataFrame, years: DataFrame, population: DataFrame | None = None, r: SeriesRules = SeriesRules()) -> DataFrame:
    """One nested row per country: points, rolling, season, years, index and flags, ready for ``to_json``.

    ``months``: rows of ``light_per_country``; ``years``: of ``country_year``;
    ``population``: country, year, population (null where per-head values are not allowed).
    """
    m = with_status(months, r).withColumn("year", F.year("month"))
    m = m.join(population, ["country", "year"], "left") if population is not None else m.withColumn("population", F.lit(None).cast("double"))
    text = month_text(F.col("month"))
    # the months of a country are shuffled once: windows and the last grouping keep to that
    own = Window.partitionBy("country")
    span, same = own.orderBy("t").rangeBetween(-(r.window - 1), 0), Window.partitionBy("country", "mo")
    m = m.withColumns({"per_head": F.try_divide("shown", "population"), "per_km2": F.try_divide("shown", "area_km2"), "t": month_index(F.col("month")), "mo": F.month("month"), "ok": F.when(F.col("status") == "valid", F.col("shown"))})
    m = m.withColumns({"n_span": F.count("ok").over(span), "mean": F.avg("ok").over(span)}).withColumn("middle", F.median("ok").over(same))

    def ordered(c: Column) -> Column:
        return F.array_sort(F.collect_list(c))

    def some(c: Column) -> Column:
        return F.when(F.size(c) > 0, c)

    point = F.struct(text.alias("month"), "status", significant(F.col("shown")).alias("sum"), significant(F.col("per_head")).alias("per_head"), significant(F.col("per_km2")).alias("per_km2"), floor_percent(F.col("coverage")).alias("coverage"), floor_percent(F.col("share_snow")).alias("snow"), floor_percent(F.col("share_not_loaded")).alias("not_loaded"))
    rolling = F.when(F.col("n_span") == r.window, F.struct(text.alias("month"), significant(F.col("mean")).alias("value")))
    season = F.when(F.col("ok").isNotNull(), F.struct(text.alias("month"), significant(F.col("ok") - F.col("middle")).alias("value")))
    least = F.least(*[F.count_if(F.col("ok").isNotNull() & (F.col("mo") == k)) for k in range(1, 13)])
    parts = m.groupBy("country").agg(
        ordered(point).alias("points"), some(ordered(rolling)).alias("rolling"), F.when(least >= r.per_calendar_month, some(ordered(season))).alias("season"),
        F.first("area_km2").alias("area_km2"), F.max_by("flags", "month").alias("flags"), *[F.count_if(F.col("status") == s).alias(f"months_{s}") for s in ("low", "snow", "not_loaded")],
    )
    y = checked_years(years, r)
    base = F.max(F.when(F.col("valid") & (F.col("year") == r.index_year), F.col("light_sum"))).over(own)
    y = y.withColumn("base", base)
    index = F.when(F.col("valid") & (F.col("base") > 0) & F.col("light_sum").isNotNull(), F.struct("year", F.rint(100.0 * F.col("light_sum") / F.col("base")).cast("int").alias("index")))
    year = F.struct("year", "valid", "reason", significant(F.when(F.col("valid"), F.col("light_sum"))).alias("light_sum"), floor_percent(F.col("light_coverage")).alias("coverage"), floor_percent(F.col("light_purity")).alias("purity"))
    by_year = y.groupBy("country").agg(ordered(year).alias("years"), some(ordered(index)).alias("index"))
    return parts.join(by_year, "country", "left")
