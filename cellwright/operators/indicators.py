"""Country indicator tables: long format, completeness, consistency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long_table(countries: DataFrame, data: DataFrame, indicators: DataFrame, first: int, last: int, provisional_from: int = 2024, per_head: tuple = (), deviating: tuple = (), fetched: str = "") -> DataFrame:
    """One row per real country, year and indicator, with a null value where the source has none.

    ``countries``: id, iso2Code, name, region struct (value "Aggregates" marks
    aggregates). ``data``: indicator and country structs, date, value.
    ``indicators``: code, short, unit, updated.
    """
    real = countries.where(F.trim("region.value") != "Aggregates").select(F.col("id").alias("iso3"), F.col("iso2Code").alias("iso2"), "name", F.trim("region.value").alias("region"))
    years = countries.sparkSession.range(first, last + 1).select(F.col("id").cast("smallint").alias("year"))
    every = real.crossJoin(F.broadcast(years)).crossJoin(F.broadcast(indicators))
    values = data.select(F.col("country.id").alias("iso2"), F.col("date").cast("smallint").alias("year"), F.col("indicator.id").alias("code"), F.col("value").cast("double").alias("value"))
    return every.join(values, ["iso2", "year", "code"], "left").select(
        "iso3", "iso2", "name", "region", "year", F.col("code").alias("indicator"), "short", "value", "unit", "updated", F.col("value").isNotNull().alias("has_value"),
        (F.col("year") >= provisional_from).alias("provisional"), (F.col("code").isin(*per_head) & F.col("iso3").isin(*deviating)).alias("do_not_use"), F.lit(fetched).alias("fetched_utc"),
    )


def check_long_table(countries: DataFrame, data: DataFrame, table: DataFrame) -> None:
    """Error for unknown units, repeated keys and values that are negative or not finite."""
    unknown = data.select(F.col("country.id").alias("iso2")).distinct().join(countries.select(F.col("iso2Code").alias("iso2")), "iso2", "left_anti")
    if not unknown.isEmpty():
        raise ValueError(f"unknown units: {[r[0] for r in unknown.limit(5).collect()]}")
    twice = table.groupBy("iso3", "year", "indicator").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("repeated keys (country, year, indicator)")
    bad = table.where(F.isnan("value") | (F.col("value") < 0) | (F.col("value") == float("inf")))
    if not bad.isEmpty():
        raise ValueError(f"values negative or not finite: {bad.select('iso3', 'year', 'indicator', 'value').limit(5).collect()}")


def missing_share(table: DataFrame, years: list[int], indicator: str = "indicator", year: str = "year", value: str = "value") -> DataFrame:
    """Share of missing values, indicators by years; the list of years fixes the columns."""
    return table.groupBy(indicator).pivot(year, years).agg(F.avg(F.col(value).isNull().cast("int")))


def consistency(table: DataFrame, whole: str, per_head: str, heads: str, key: tuple = ("country", "year"), indicator: str = "indicator", value: str = "value") -> DataFrame:
    """One row: n, min, median and max of per-head times heads over the whole, where all three are there."""
    wide = table.groupBy(*key).pivot(indicator, [whole, per_head, heads]).agg(F.first(value)).na.drop().where(F.col(whole) > 0)
    ratio = F.col(per_head) * F.col(heads) / F.col(whole)
    return wide.agg(F.count("*").alias("n"), F.min(ratio).alias("min"), F.median(ratio).alias("median"), F.max(ratio).alias("max"))


def repeated_keys(table: DataFrame, key: list[str]) -> DataFrame:
    return table.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def reconcile(boundaries: DataFrame, listed: DataFrame, code: str = "iso3") -> dict[str, DataFrame]:
    """Codes in both, in one only, and codes with several boundaries."""
    return {
        "both": boundaries.join(listed, code, "left_semi").select(code).distinct(),
        "only_boundary": boundaries.join(listed, code, "left_anti").select(code).distinct(),
        "only_list": listed.join(boundaries, code, "left_anti").select(code).distinct(),
        "several": boundaries.groupBy(code).agg(F.sort_array(F.collect_list("name")).alias("names")).where(F.size("names") > 1),
    }
