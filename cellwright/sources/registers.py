"""Registers in YAML: special units and layers, validated when they are read (yaml only when used)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT_SCHEMA = "unit_id string, name string, level string, country string, clarity string, sources array<string>"


def units_from_yaml(spark: SparkSession, path: str) -> DataFrame:
    """Special units of a small YAML file; rows that break a rule are an error."""
    import yaml

    with open(path, encoding="utf-8") as f:
        rows = yaml.safe_load(f) or []
    df = spark.createDataFrame([tuple(r.get(k) for k in ("unit_id", "name", "level", "country", "clarity", "sources")) for r in rows], UNIT_SCHEMA)
    broken = broken_units(df)
    if not broken.isEmpty():
        raise ValueError(f"units that break a rule: {broken.limit(5).collect()}")
    return df


def broken_units(df: DataFrame) -> DataFrame:
    """Units without id or source, of unknown clarity, unclear without a country, or repeated."""
    twice = df.groupBy("unit_id").count().where("count > 1").select("unit_id")
    bad = df.where(F.col("unit_id").isNull() | (F.coalesce(F.size("sources"), F.lit(0)) < 1) | ~F.col("clarity").isin("clear", "unclear", "none") | ((F.col("clarity") == "unclear") & F.col("country").isNull()))
    return bad.unionByName(df.join(twice, "unit_id", "left_semi").select(df.columns)).distinct()
