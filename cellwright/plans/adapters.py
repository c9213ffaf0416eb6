"""The test tables seen as cubes, bridges and country tables, in Spark and in SQL.

``lineitem`` is a cube of 10 x 20 cells, ``orders`` a yearly country table,
``nation`` the units. Every frame has a twin: a named SQL expression that the
oracles begin with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS, COLS = 10, 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """month, row, col, lat, lon, mean_obs, mean_cand, valid, filled."""
    cell = F.col("l_partkey") % 200
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    net = F.round(F.col("l_extendedprice") * (100 - F.round(F.col("l_discount") * 100))).cast("long")
    g = table(spark, sf_dir, "lineitem").groupBy(F.to_date(F.trunc("l_shipdate", "MM")).alias("month"), F.floor(cell / COLS).cast("int").alias("row"), (cell % COLS).cast("int").alias("col"))
    g = g.agg(F.sum(cents).alias("cents"), F.sum(net).alias("net"), F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    return g.select(
        "month", "row", "col", (36.0 - 8.0 * F.col("row")).alias("lat"), (-171.0 + 18.0 * F.col("col")).alias("lon"),
        (F.expr("cents div n") / 1e5).alias("mean_obs"), (F.expr("net div n") / 1e5).alias("mean_cand"),
        F.lit(3600).alias("valid"), F.floor(1800.0 * F.col("r") / F.col("n")).cast("int").alias("filled"),
    )


CUBE = f"""cube as (select month, "row", col, 36e0 - 8e0 * "row" lat, -171e0 + 18e0 * col lon, (cents // n) / 1e5 mean_obs, (net // n) / 1e5 mean_cand, 3600 valid, floor(18e2 * r / n)::int filled
from (select date_trunc('month', l_shipdate)::date as month, ((l_partkey % 200) // {COLS})::int "row", (l_partkey % {COLS})::int col,
    sum(round(l_extendedprice * 100)::bigint)::bigint cents, sum(round(l_extendedprice * (100 - round(l_discount * 100)))::bigint)::bigint net, count(*) n, count(*) filter (l_returnflag = 'R') r from lineitem group by all))"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month, state): most months finished, some only in the region, some not loaded."""
    month = table(spark, sf_dir, "lineitem").select(F.to_date(F.trunc("l_shipdate", "MM")).alias("month")).distinct()
    k = F.year("month") * 12 + F.month("month")
    return month.select("month", F.when(k % 23 == 0, 0).when(k % 17 == 0, 4).otherwise(1).alias("state"))


STATES = """states as (select month, case when (year(month) * 12 + month(month)) % 23 = 0 then 0 when (year(month) * 12 + month(month)) % 17 = 0 then 4 else 1 end state
from (select distinct date_trunc('month', l_shipdate)::date as month from lineitem))"""


def region(spark: SparkSession) -> DataFrame:
    """Cells of the region: the western half."""
    return spark.range(ROWS * COLS // 2).select(F.floor(F.col("id") / (COLS // 2)).cast("int").alias("row"), (F.col("id") % (COLS // 2)).cast("int").alias("col"))


REGION = f"""region as (select (i // {COLS // 2})::int "row", (i % {COLS // 2})::int col from range({ROWS * COLS // 2}) t(i))"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit_id, country, clarity, level, name, m49_region."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    u = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    k = F.col("n_nationkey")
    return u.select(
        k.alias("unit_id"), F.when(k % 9 != 8, F.format_string("C%02d", F.when(k >= 20, k - 10).otherwise(k))).alias("country"), F.when(k % 11 == 3, "unclear").otherwise("clear").alias("clarity"),
        F.when(k % 11 == 3, "special unit").otherwise("base unit").alias("level"), F.col("n_name").alias("name"), F.col("r_name").alias("m49_region"),
    )


UNITS = """units as (select n_nationkey unit_id, case when n_nationkey % 9 <> 8 then printf('C%02d', (case when n_nationkey >= 20 then n_nationkey - 10 else n_nationkey end)::int) end country,
case when n_nationkey % 11 = 3 then 'unclear' else 'clear' end clarity, case when n_nationkey % 11 = 3 then 'special unit' else 'base unit' end as level, n_name as name, r_name m49_region from nation join region_ on n_regionkey = r_regionkey)"""
UNITS = UNITS.replace("region_", "main.region")


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, unit_id, area_km2, share: every third cell is shared, every seventh is mostly sea."""
    cells = spark.range(ROWS * COLS).select(F.col("id").cast("int").alias("k"))
    k = F.col("k")
    main = cells.select("k", (k % 25).alias("unit_id"), F.when(k % 7 == 6, 0.25).when(k % 3 == 0, 0.5).otherwise(1.0).alias("share"))
    second = cells.where((k % 3 == 0) & ((k * 7 + 3) % 25 != k % 25)).select("k", ((k * 7 + 3) % 25).alias("unit_id"), F.lit(0.25).alias("share"))
    tiny = cells.where(k % 40 == 13).select("k", ((k * 3 + 1) % 25).alias("unit_id"), F.lit(0.03125).alias("share"))
    both = main.where(k % 40 != 13).union(second.where(k % 40 != 13)).union(tiny)
    area = 700.0 + 4.0 * F.floor(k / COLS)
    return both.select(F.floor(k / COLS).cast("int").alias("row"), (k % COLS).cast("int").alias("col"), "unit_id", (area * F.col("share")).alias("area_km2"), "share")


BRIDGE = f"""bridge as (select (k // {COLS})::int "row", (k % {COLS})::int col, unit_id::int unit_id, (7e2 + 4e0 * (k // {COLS})) * share area_km2, share from (
select k, k % 25 unit_id, case when k % 7 = 6 then 25e-2 when k % 3 = 0 then 5e-1 else 1e0 end share from range({ROWS * COLS}) t(k) where k % 40 <> 13
union all select k, (k * 7 + 3) % 25, 25e-2 from range({ROWS * COLS}) t(k) where k % 3 = 0 and (k * 7 + 3) % 25 <> k % 25 and k % 40 <> 13
union all select k, (k * 3 + 1) % 25, 3125e-5 from range({ROWS * COLS}) t(k) where k % 40 = 13))"""


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long country table: country, year, indicator, value (gdp, gdp_per_head, population)."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    u = units(spark, sf_dir).where("country is not null")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(u, F.col("c_nationkey") == F.col("unit_id"))
    g = rows.groupBy("country", F.year("o_orderdate").alias("year")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.count("*").alias("n"))
    long = g.select("country", "year", F.explode(F.create_map(F.lit("gdp"), F.col("cents") / 1e2, F.lit("gdp_per_head"), F.col("cents") / (F.col("n") * 1e2), F.lit("population"), F.col("n").cast("double"))).alias("indicator", "value"))
    gap = (F.col("indicator") == "gdp_per_head") & (F.col("year") % 4 == 1) & (F.substring("country", 3, 1) == "3")
    return long.withColumn("value", F.when(~gap, F.col("value")))


INDICATORS = """ind0 as (select country, year(o_orderdate)::int as year, sum(round(o_totalprice * 100)::bigint)::bigint cents, count(*) n from orders join customer on o_custkey = c_custkey join units on c_nationkey = unit_id where country is not null group by all),
indicators as (select country, year, 'gdp' indicator, cents / 1e2 as value from ind0 union all
select country, year, 'gdp_per_head', case when year % 4 = 1 and substr(country, 3, 1) = '3' then null else cents / (n * 1e2) end from ind0 union all
select country, year, 'population', n::double from ind0)"""


def with_(*names: str) -> str:
    """SQL that names the asked frames."""
    return "with recursive " + ",\n".join(names)
