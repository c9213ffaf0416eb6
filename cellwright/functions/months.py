"""Month arithmetic: months are dates of their first day, indices are year * 12 + month - 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def month_index(month: Column) -> Column:
    return F.year(month) * 12 + F.month(month) - 1


def month_of(index: Column) -> Column:
    return F.make_date(F.floor(index / 12).cast("int"), F.pmod(index, F.lit(12)) + 1, F.lit(1))


def month_text(month: Column) -> Column:
    return F.date_format(month, "yyyy-MM")


def from_text(text: Column) -> Column:
    """Month of 'YYYY-MM'."""
    return F.to_date(F.concat(text, F.lit("-01")))


def days_in(month: Column) -> Column:
    return F.dayofmonth(F.last_day(month))


def month_of_day(year: Column, day_of_year: Column) -> Column:
    return F.trunc(F.date_add(F.make_date(year, F.lit(1), F.lit(1)), day_of_year - 1), "MM")


def axis(spark: SparkSession, first: str, last: str) -> DataFrame:
    """All months from first to last ('YYYY-MM'), with their index."""
    row = spark.range(1).select(F.explode(F.expr(f"sequence(date'{first}-01', date'{last}-01', interval 1 month)")).alias("month"))
    return row.withColumn("t", month_index(F.col("month")))
