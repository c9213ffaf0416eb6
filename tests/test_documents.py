"""The nested result of a country against its parts, which SQL checks elsewhere."""

from dataclasses import replace

from pyspark.sql import functions as F

from cellwright.config import SeriesRules
from cellwright.functions.months import month_text
from cellwright.functions.scalars import significant
from cellwright.operators import series as SE

R = replace(SeriesRules(), index_year=2001)


def rows(spark):
    """Country 0 whole, 1 with gaps and years without a base, 2 with one month only."""
    k, m = F.col("id") % 3, F.floor(F.col("id") / 3)
    month = F.add_months(F.lit("2000-01-01").cast("date"), m.cast("int"))
    at = spark.range(3 * 48).select(F.format_string("C%d", k).alias("country"), month.alias("month"), m.alias("m"), k.alias("k"), (10 + F.abs(F.xxhash64("id")) % 90).cast("double").alias("v"))
    at = at.where("k = 0 or (k = 1 and m % 7 <> 3) or (k = 2 and m = 5)")
    low = (F.col("m") % 11 == 4) & (F.col("m") < 20)
    zero = F.lit(0.0)
    months = at.select("country", "month", F.when(~low, F.col("v")).alias("light_sum"), F.col("v").alias("light_covered"), F.when(low, 0.5).otherwise(0.95).alias("coverage"), zero.alias("share_snow"), zero.alias("share_not_loaded"), F.lit(5.0).alias("area_km2"), F.col("m").cast("string").alias("flags"))
    years = spark.range(8).select(F.format_string("C%d", F.col("id") % 2).alias("country"), (2000 + F.floor(F.col("id") / 2)).cast("int").alias("year"), (100.0 + F.col("id")).alias("light_sum"), F.lit(0.95).alias("light_coverage"), F.lit(0.8).alias("light_purity"), F.when(F.col("id") == 3, 1.0).otherwise(0.0).alias("area_not_loaded"))
    return months, years


def test_parts(spark):
    months, years = rows(spark)
    got = {r["country"]: r for r in SE.country_documents(months, years, None, R).collect()}
    assert set(got) == {"C0", "C1", "C2"} and len(got["C0"]["points"]) == 48 and len(got["C2"]["points"]) == 1
    m = SE.with_status(months, R)
    for name, part, value in (("rolling", SE.trailing_mean(m, ["country"], "shown", R), "mean"), ("season", SE.seasonal_deviation(m, ["country"], "shown", R), "deviation")):
        want = {}
        for r in part.select("country", month_text(F.col("month")).alias("month"), significant(F.col(value)).alias("value")).collect():
            want.setdefault(r["country"], []).append((r["month"], r["value"]))
        assert {c: sorted(w) for c, w in want.items()} == {c: [tuple(x) for x in r[name]] for c, r in got.items() if r[name] is not None}, name
    assert got["C2"]["rolling"] is None and got["C2"]["season"] is None and len(got["C0"]["rolling"]) == 21 and got["C1"]["rolling"] is None and got["C0"]["season"]
    index = SE.index_to_base(SE.checked_years(years, R).where("valid"), ["country"], "year", "light_sum", R.index_year).collect()
    assert sorted((r["country"], r["year"], r["index"]) for r in index) == sorted((c, x["year"], x["index"]) for c, r in got.items() for x in r["index"] or [])
    assert got["C1"]["index"] is None and len(got["C1"]["years"]) == 4 and got["C2"]["years"] is None
    assert SE.country_documents(months.limit(0), years.limit(0), None, R).count() == 0
