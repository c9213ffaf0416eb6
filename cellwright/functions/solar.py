"""Which tile rows may lack a month because no night is dark enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NIGHT_ZENITH, SAFETY = 102.0, 1.0
#: Days from 1970-01-01 to the almanac's zero, 2000-01-01 12:00.
NOON = 10957.5


def declination(days: Column) -> Column:
    """Declination of the sun in degrees, low-precision almanac formula; days since 2000-01-01 12:00 UTC."""
    n = days
    length = F.radians(F.pmod(280.460 + 0.9856474 * n, F.lit(360.0)))
    anomaly = F.radians(F.pmod(357.528 + 0.9856003 * n, F.lit(360.0)))
    ecliptic = length + F.radians(F.lit(1.915)) * F.sin(anomaly) + F.radians(F.lit(0.020)) * F.sin(2 * anomaly)
    return F.degrees(F.asin(F.sin(F.radians(23.439 - 0.0000004 * n)) * F.sin(ecliptic)))


def row_findings(months: DataFrame) -> DataFrame:
    """Per (month, v): greatest zenith angle of the sun in the tile row, and whether missing it is explainable.

    The hours of each month, a day more at both ends, are sampled.
    """
    # hours are counted from the date's number, so no session time zone has a part in them
    first, last = F.unix_date("month") * 24 - 24, F.unix_date(F.add_months("month", 1)) * 24 + 24
    hours = months.select("month", F.explode(F.sequence(first, last)).alias("hour"))
    sun = declination(F.col("hour") / 24.0 - NOON)
    range_ = hours.groupBy("month").agg(F.min(sun).alias("lo"), F.max(sun).alias("hi"))
    both = range_.select("*", F.explode(F.sequence(F.lit(0), F.lit(17))).alias("v"))
    south, north = 80.0 - 10.0 * F.col("v"), 90.0 - 10.0 * F.col("v")
    low, high = south + F.col("lo"), north + F.col("hi")
    least = F.when((low <= 0) & (high >= 0), 0.0).when(low > 0, low).otherwise(-high)
    out = both.select("month", "v", south.alias("lat_south"), north.alias("lat_north"), (180.0 - least).alias("zenith"))
    out = out.withColumn("distance", NIGHT_ZENITH - F.col("zenith"))
    return out.withColumn("missing_explainable", F.col("distance") > SAFETY)
