"""Queries of tile regions, absent tiles, and tables written for reading parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import AbsenceRules
from ..operators import tiles as TI
from ..sources import layout, places, tables
from . import adapters as A
from .base import Registry, pick, r

R = Registry()

EUROPE_ASIA = ("ASIA", "EUROPE")
RULE = "a cell with land of a unit in EUROPE or ASIA"

# customers as a bridge: a cell each, land where the account is above zero; nations as units, some without a region
PARTS = """with b as (select printf('h%02dv%02d', ((c_nationkey * 57 + c_custkey % 97) % 1440 // 40)::int, (c_custkey * 37 % 720 // 40)::int) tile, c_nationkey u from customer where c_acctbal > 0),
u as (select n_nationkey u, n_name as name, case when n_nationkey % 11 = 3 then '' else r_name end g from nation join region on n_regionkey = r_regionkey),
j as (select tile, name, g, g in ('ASIA', 'EUROPE') inside, g <> '' and g not in ('ASIA', 'EUROPE') other, (substr(tile, 2, 2)::int * 7 + substr(tile, 5, 2)::int * 3) % 5 <> 0 listed from b join u using (u)),
t as (select tile, bool_or(inside) inside, bool_or(other) other, bool_or(listed) listed from j group by tile),
parts as (select 'tile' kind, tile as name from t where inside and listed union all select 'outside reference', tile from t where inside and not listed union all select 'mixed', tile from t where inside and listed and other
    union all select distinct 'unit without region', name from j join t using (tile) where g = '' and not t.inside)"""


def region_of_customers(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    share = F.when(F.col("c_acctbal") > 0, 0.25).otherwise(0.0)
    bridge = A.table(spark, sf_dir, "customer").select((k * 37 % 720).cast("int").alias("row"), ((n * 57 + k % 97) % 1440).cast("int").alias("col"), n.alias("unit_id"), share.alias("share"))
    nation, region = A.table(spark, sf_dir, "nation"), A.table(spark, sf_dir, "region")
    units = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_nationkey").alias("unit_id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 11 != 3, F.col("r_name")).otherwise("").alias("m49_region"))
    h, v = F.floor(F.col("id") / 18), F.col("id") % 18
    reference = spark.range(36 * 18).where((h * 7 + v * 3) % 5 != 0).select(F.format_string("h%02dv%02d", h, v).alias("tile"))
    return TI.region_parts(bridge, units, EUROPE_ASIA, reference)


@R.add(f"{PARTS} select kind, name from parts")
def region_tiles(spark, sf_dir):
    return region_of_customers(spark, sf_dir)


def _listed(text: str, kind: str) -> str:
    return f"select '# {text}: ' || coalesce(string_agg(name, ', ' order by name), 'none') as value from parts where kind = '{kind}'"


@R.add(
    f"""{PARTS}, h as (select 0 n, '# region: europe-asia' as value union all select 1, '# rule: {RULE}' union all select 2, '# source bridge: customer' union all select 3, '# source units: nation'
    union all select 4, '# tiles: ' || count(*) from parts where kind = 'tile' union all select 5, * from ({_listed('not in the reference list', 'outside reference')})
    union all select 6, * from ({_listed('with cells of other regions', 'mixed')}) union all select 7, * from ({_listed('units without a region elsewhere', 'unit without region')})
    union all select 7 + row_number() over (order by name), name from parts where kind = 'tile') select n::int n, value from h"""
)
def region_tile_list(spark, sf_dir):
    return TI.region_list(region_of_customers(spark, sf_dir), "europe-asia", RULE, {"bridge": "customer", "units": "nation"})


@R.add(f"{PARTS} select name as tile from parts where kind = 'tile'")
def region_tile_list_read(spark, sf_dir):
    """The list written as text, its number of tiles checked, and read back."""
    path = places.shared_folder(spark, "region-list")
    TI.write_region_list(region_tile_list(spark, sf_dir), path)
    tables.check_tile_count(spark.read.text(path))
    return tables.tile_list(spark, path)


@R.add(
    """with w as (select month::date as month, printf('h%02dv%02d', h::int, v::int) tile, v from generate_series(date '1996-01-01', date '1997-12-01', interval 1 month) m(month), range(6) a(h), range(8) b(v)),
    c as (select distinct date_trunc('month', l_shipdate)::date as month, printf('h%02dv%02d', (l_partkey % 36)::int, (l_orderkey % 18)::int) tile from lineitem),
    a as (select * from w anti join c using (month, tile)), g as (select month, count(*) n_absent, list_sort(list(tile)) ts, list_sort(list(tile) filter (v > 3)) south from a group by month)
    select month, n_absent, array_to_string(ts[1:5], ', ') first_tiles, concat_ws('; ', case when n_absent > 20 then n_absent || ' tiles (at most 20)' end, case when month(month) not between 4 and 8 then 'outside months 4 to 8' end,
        case when len(coalesce(south, [])) > 0 then 'south of the known rows: ' || array_to_string(south[1:5], ', ') end) reasons from g"""
)
def absent_tile_findings(spark, sf_dir):
    """Tiles that no line was shipped from in a month of two years."""
    reference = spark.range(48).select(F.format_string("h%02dv%02d", F.floor(F.col("id") / 8), F.col("id") % 8).alias("tile"))
    shipped = A.table(spark, sf_dir, "lineitem").select(F.to_date(F.trunc("l_shipdate", "MM")).alias("month"), F.format_string("h%02dv%02d", F.col("l_partkey") % 36, F.col("l_orderkey") % 18).alias("tile"))
    return TI.absence_findings(TI.absent_tiles(reference, shipped, "1996-01", "1997-12"), AbsenceRules(most=20))


@R.add("select l_orderkey, l_linenumber, l_partkey, l_shipdate::date l_shipdate from lineitem where l_shipdate >= date '1996-03-01' and l_shipdate < date '1996-06-01' and l_partkey between 20 and 60")
def clustered_box(spark, sf_dir):
    """All lines written along a curve through date and part, and a box of it read back."""
    lines = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("l_shipdate"))
    laid = layout.write_clustered(lines, places.shared_folder(spark, "clustered"), ["l_shipdate", "l_partkey"])
    return laid.where("l_shipdate >= date '1996-03-01' and l_shipdate < date '1996-06-01' and l_partkey between 20 and 60")


@R.add(f"{A.with_(A.UNITS, A.INDICATORS)} select country, indicator, year, {r('value', digits=2)}, row_number() over (order by country, indicator, year) place from indicators")
def sorted_indicators(spark, sf_dir):
    """The country table written in the order of its key; each row's place in the files."""
    rows = A.indicators(spark, sf_dir).select("country", "indicator", "year", "value")
    laid = layout.write_sorted(rows, places.shared_folder(spark, "sorted"), ["country", "indicator", "year"])
    return pick(layout.with_place(laid), ["country", "indicator", "year", "place"], ["value"], 2)
