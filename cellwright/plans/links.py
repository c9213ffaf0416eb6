"""Linking, country, cross-section and indicator queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import CrossSectionRules, SeriesRules
from ..operators import crosssection as CS
from ..operators import indicators as IN
from ..operators import link as LK
from ..operators import series as SE
from . import adapters as A
from .base import Registry, pick, r, rs
from .scans import reader

R = Registry()

CELLS = f"""{A.with_(A.CUBE, A.STATES, A.REGION, A.UNITS, A.BRIDGE)},
cells as (select month, "row", col, lat, case when not ng then mean_obs end mean_obs, case when not ng then valid end as valid, case when not ng then filled end filled, ng from
    (select cube.*, state = 4 and region.col is null ng from cube join states using (month) left join region using ("row", col) where state in (1, 4)))"""
WINTER = "(case when lat >= 0 then month(month) in (11, 12, 1, 2, 3, 4) else month(month) in (5, 6, 7, 8, 9, 10) end)"
KLASS = f"""{CELLS}, k0 as (select *, case when valid > 0 and filled >= 0 and filled <= valid then (valid - filled) / 36e2 end s from cells),
k as (select *, case when ng then 1 when coalesce(valid, 0) <= 0 or s is null then 2 when s < 5e-1 or mean_obs is null then 3 else 0 end k, coalesce(abs(lat) >= 235e-1 and {WINTER} and s < 9e-1, false) snow from k0)"""
SHARES = ("not_loaded", "no_data", "insufficient", "undistributed", "snow")


def cells(spark, sf_dir):
    return reader(spark, sf_dir).read_with_region(["mean_obs", "valid", "filled", "lat"], A.region(spark)).drop("lat").join(A.cube(spark, sf_dir).select("row", "col", "lat").distinct(), ["row", "col"])


@R.add(f"{KLASS} select month, \"row\", col, k as class, {r('case when k = 0 then mean_obs * valid / 36e2 end', 'light')} from k")
def cell_classes(spark, sf_dir):
    from ..functions.quality import cell_class, light_density

    k = cell_class(F.col("mean_obs"), F.col("valid"), F.col("filled"), F.col("not_loaded"))
    got = cells(spark, sf_dir).select("month", "row", "col", k.alias("class"), light_density(F.col("mean_obs"), F.col("valid"), k).alias("light"))
    return pick(got, ["month", "row", "col", "class"], ["light"])


UNIT = f"""{KLASS}, mo as (select distinct month from k), bl as (select *, sum(share) over (partition by "row", col) land from bridge),
j as (select mo.month, bl.*, coalesce(k.k, 2) k, coalesce(k.snow, false) snow, mean_obs * valid / 36e2 light from bl cross join mo left join k on k.month = mo.month and k."row" = bl."row" and k.col = bl.col),
u0 as (select month, unit_id, sum(area_km2) area_km2, sum(case when k = 0 and land >= 5e-2 then area_km2 else 0 end) cov, sum(case when k = 1 then area_km2 else 0 end) not_loaded, sum(case when k = 2 then area_km2 else 0 end) no_data,
    sum(case when k = 3 then area_km2 else 0 end) insufficient, sum(case when k = 0 and land < 5e-2 then area_km2 else 0 end) undistributed, sum(case when snow and k = 0 then area_km2 else 0 end) snow,
    sum(case when k = 0 and land >= 5e-2 then light * area_km2 / land else 0 end) light, count(*) n_cells from j group by all),
per_unit as (select month, unit_id, area_km2, cov area_covered_km2, cov / area_km2 coverage, {', '.join(f'{s} / area_km2 share_{s}' for s in SHARES)}, case when cov > 0 then light end light_covered, case when cov / area_km2 >= 9e-1 then light end light_sum, n_cells from u0)"""
SH = [f"share_{s}" for s in SHARES]


def per_unit(spark, sf_dir):
    return LK.light_per_unit(cells(spark, sf_dir), A.bridge(spark, sf_dir))


@R.add(f"{UNIT} select month, unit_id, {rs('area_km2', 'area_covered_km2', 'light_covered', 'light_sum', digits=2)}, {rs('coverage', *SH)}, n_cells from per_unit")
def light_per_unit(spark, sf_dir):
    got = per_unit(spark, sf_dir).withColumn("unit_id", F.col("unit_id").cast("int"))
    return pick(pick(got, ["month", "unit_id", "n_cells", "coverage", *SH], ["area_km2", "area_covered_km2", "light_covered", "light_sum"], 2), ["month", "unit_id", "n_cells", "area_km2", "area_covered_km2", "light_covered", "light_sum"], ["coverage", *SH])


PURITY = """own as (select country, "row", col, sum(share) share, sum(area_km2) area from bridge join units using (unit_id) where country is not null group by all), landc as (select "row", col, sum(share) land from bridge group by all),
pur as (select country, sum(area) area_km2, sum(case when share / land >= 9e-1 then area else 0 end) / sum(area) purity, count(*) cells from own join landc using ("row", col) group by country)"""
COUNTRY = f"""{UNIT}, {PURITY}, c0 as (select month, country, sum(area_km2) area_km2, sum(area_covered_km2) area_covered_km2, sum(light_covered) light_covered, sum(case when clarity = 'unclear' and level like 'special%' then area_km2 else 0 end) / sum(area_km2) share_unclear,
    count(*) n_units, {', '.join(f'sum({s} * area_km2) / sum(area_km2) {s}' for s in SH)} from per_unit join units using (unit_id) where country is not null group by all),
per_country as (select c0.*, area_covered_km2 / c0.area_km2 coverage, case when area_covered_km2 / c0.area_km2 >= 9e-1 then light_covered end light_sum, purity from c0 left join pur using (country))"""


def per_country(spark, sf_dir):
    u = A.units(spark, sf_dir)
    return LK.light_per_country(per_unit(spark, sf_dir), u, LK.purity(u, A.bridge(spark, sf_dir)))


def _pct(x: str) -> str:
    return f"floor({x} * 100 + 1e-9)::int || ' %'"


FLAGS = f"""concat_ws('; ', case when share_not_loaded > 5e-1 then 'mostly not loaded (' || {_pct('share_not_loaded')} || ' of the area)' when not coalesce(coverage > 0, false) then 'no coverage' when coverage < 9e-1 then 'coverage ' || {_pct('coverage')} || ' below 90 %: no country sum' end,
case when share_undistributed >= 5e-2 then {_pct('share_undistributed')} || ' of the area in cells with little land' end, case when share_not_loaded between 5e-3 and 5e-1 then {_pct('share_not_loaded')} || ' of the area not loaded' end,
case when share_insufficient >= 5e-2 then {_pct('share_insufficient')} || ' insufficient data' end, case when share_snow >= 5e-2 then 'snow suspected on ' || {_pct('share_snow')} end, case when share_unclear >= 1e-2 then {_pct('share_unclear')} || ' of the area in unclear special units' end,
case when purity < 5e-1 then 'mixed cells (purity ' || {_pct('purity')} || ')' end)"""


@R.add(f"{COUNTRY} select month, country, n_units, {rs('area_km2', 'light_covered', 'light_sum', digits=2)}, {rs('coverage', 'purity', 'share_unclear', *SH)}, {FLAGS} flags from per_country")
def light_per_country(spark, sf_dir):
    got = per_country(spark, sf_dir)
    more = ["coverage", "purity", "share_unclear", *SH]
    first = pick(got, ["month", "country", "n_units", "flags", *more], ["area_km2", "light_covered", "light_sum"], 2)
    return pick(first, ["month", "country", "n_units", "flags", "area_km2", "light_covered", "light_sum"], more)


STATUS = f"""{COUNTRY}, st as (select *, case when share_not_loaded >= 5e-3 then 'not_loaded' when coverage is null or coverage <= 0 or light_covered is null then 'none' when coverage < 9e-1 then 'low' when share_snow >= 5e-2 then 'snow' else 'valid' end status from per_country),
sh as (select *, case when status in ('valid', 'snow') then light_sum when status = 'low' then light_covered end shown, (year(month) * 12 + month(month) - 1)::int t from st)"""


@R.add(f"{STATUS} select month, country, status, {r('shown', digits=2)} from sh")
def country_month_status(spark, sf_dir):
    return pick(SE.with_status(per_country(spark, sf_dir)), ["month", "country", "status"], ["shown"], 2)


@R.add(f"""{STATUS}, w as (select country, month, count(v) over w n, avg(v) over w m from (select *, case when status in ('valid', 'snow', 'low') then shown end v from sh) window w as (partition by country order by t range between 5 preceding and current row)) select country, month, {r('m', 'mean', 2)} from w where n = 6""")
def trailing_mean(spark, sf_dir):
    rows = SE.with_status(per_country(spark, sf_dir)).withColumn("status", F.when(F.col("status").isin("valid", "snow", "low"), "valid"))
    return pick(SE.trailing_mean(rows, ["country"], "shown", replace(SeriesRules(), window=6)), ["country", "month"], ["mean"], 2)


@R.add(
    f"""{STATUS}, v as (select *, month(month) mo from sh where status in ('valid', 'snow', 'low')), p as (select country, mo, count(*) n, median(shown) med from v group by all), e as (select country from p group by country having count(*) = 12 and min(n) >= 2)
    select country, month, {r('shown - med', 'deviation', 7)} from v join e using (country) join p using (country, mo)"""
)
def seasonal_deviation(spark, sf_dir):
    rows = SE.with_status(per_country(spark, sf_dir)).withColumn("status", F.when(F.col("status").isin("valid", "snow", "low"), "valid"))
    return pick(SE.seasonal_deviation(rows, ["country"], "shown", replace(SeriesRules(), per_calendar_month=2)), ["country", "month"], ["deviation"], 7)


@R.add(f"""{STATUS}, c as (select country, {', '.join(f"count(*) filter (month(month) = {m} and status in ('valid', 'snow', 'low')) m{m}" for m in range(1, 13))} from sh group by country) select country, least({', '.join(f'm{m}' for m in range(1, 13))}) as least, ({' + '.join(f'(m{m} < 3)::int' for m in range(1, 13))})::int short_months from c""")
def seasonal_check(spark, sf_dir):
    rows = SE.with_status(per_country(spark, sf_dir)).withColumn("status", F.when(F.col("status").isin("valid", "snow", "low"), "valid"))
    return SE.seasonal_check(rows, ["country"], "shown").select("country", "least", "short_months")


# --- years of cells and countries

YEARS = f"""{KLASS}, cy0 as (select year(month)::int as year, "row", col, min(lat) lat, sum(case when k = 0 and not snow then mean_obs * valid / 36e2 end) sg, count(*) filter (k = 0 and not snow) n_good, sum(case when k <> 1 and valid > 0 and mean_obs is not null then mean_obs * valid / 36e2 end) sa,
    count(*) filter (k <> 1 and valid > 0 and mean_obs is not null) na, bool_or(ng) not_loaded from k group by all), cy as (select year, "row", col, lat, case when n_good >= 4 then sg / n_good end year_value, case when na > 0 then sa / na end estimate, n_good, not_loaded from cy0)"""
RULES = replace(CrossSectionRules(), min_good_months=4, few_months_up_to=6, north_limit=30.0, bootstrap=200)


def years(spark, sf_dir):
    return LK.cell_year(cells(spark, sf_dir), RULES)


@R.add(f"{YEARS} select year, \"row\", col, {rs('year_value', 'estimate', digits=9)}, n_good, not_loaded from cy")
def cell_years(spark, sf_dir):
    return pick(years(spark, sf_dir), ["year", "row", "col", "n_good", "not_loaded"], ["year_value", "estimate"], 9)


WEIGHTS = """bl as (select *, sum(share) over (partition by "row", col) land from bridge), w0 as (select country, "row", col, sum(share) share, sum(area_km2) area_km2, min(land) land, max(area_km2 / share) cell_km2 from bl join units using (unit_id) where country is not null group by all),
w as (select *, case when land >= 5e-2 then cell_km2 * share / land else 0 end weight_km2, land >= 5e-2 distributed, share / land >= 999e-3 pure from w0)"""


def weights(spark, sf_dir):
    return LK.cell_country_weights(A.units(spark, sf_dir), A.bridge(spark, sf_dir), r=RULES)


@R.add(f"{A.with_(A.UNITS, A.BRIDGE)}, {WEIGHTS} select country, \"row\", col, {rs('share', 'area_km2', 'weight_km2')}, distributed, pure from w")
def cell_country_weights(spark, sf_dir):
    return pick(weights(spark, sf_dir), ["country", "row", "col", "distributed", "pure"], ["share", "area_km2", "weight_km2"])


CYEAR = f"""{YEARS}, {WEIGHTS}, yy as (select distinct year from cy), g0 as (select yy.year, w.*, year_value a, estimate s, n_good, lat, coalesce(not_loaded, false) nl from w cross join yy left join cy on cy.year = yy.year and cy."row" = w."row" and cy.col = w.col),
g as (select year, country, sum(coalesce(a * weight_km2, 0)) light_sum, sum(coalesce(a * weight_km2, s * weight_km2, 0)) ref, sum(case when pure then coalesce(a * weight_km2, 0) else 0 end) light_pure, sum(case when a is not null and n_good <= 6 then a * weight_km2 else 0 end) few,
    sum(case when lat > 30 then coalesce(a * weight_km2, 0) else 0 end) north, sum(area_km2) area_km2, sum(case when a is null and s is null and weight_km2 > 0 then area_km2 else 0 end) unm, sum(case when nl then area_km2 else 0 end) area_not_loaded, sum(case when a is null then area_km2 else 0 end) nov from g0 group by all),
country_year as (select year, country, light_sum, light_pure, area_km2, area_not_loaded, light_sum / nullif(ref, 0) light_coverage, light_pure / nullif(light_sum, 0) light_purity, few / nullif(light_sum, 0) share_few_months, north / nullif(light_sum, 0) share_north, nov / area_km2 share_no_value, unm / area_km2 share_unmeasured from g)"""
CYS = ["light_coverage", "light_purity", "share_few_months", "share_north", "share_no_value", "share_unmeasured"]


def country_years(spark, sf_dir):
    return LK.country_year(weights(spark, sf_dir), years(spark, sf_dir), RULES)


@R.add(f"{CYEAR} select year, country, {rs('light_sum', 'light_pure', 'area_km2', 'area_not_loaded', digits=2)}, {rs(*CYS)} from country_year")
def country_year(spark, sf_dir):
    first = pick(country_years(spark, sf_dir), ["year", "country", *CYS], ["light_sum", "light_pure", "area_km2", "area_not_loaded"], 2)
    return pick(first, ["year", "country", "light_sum", "light_pure", "area_km2", "area_not_loaded"], CYS)


@R.add(f"""{CYEAR}, v as (select *, case when area_not_loaded > 0 then 'parts of the country are not loaded yet' when not coalesce(light_sum > 0, false) then 'light sum is 0 or cannot be determined'
    when not coalesce(light_coverage >= 9e-1, false) then 'only ' || coalesce(floor(light_coverage * 100 + 1e-9)::int::text, '?') || ' % of the light has a valid yearly value' else '' end reason from country_year) select year, country, reason = '' as valid, reason from v""")
def checked_country_years(spark, sf_dir):
    return SE.checked_years(country_years(spark, sf_dir)).select("year", "country", "valid", "reason")


@R.add(f"""{CYEAR}, b as (select *, max(case when year = 1998 then light_sum end) over (partition by country) base from country_year) select country, year, round_even(100 * light_sum / base, 0)::int as index from b where base > 0 and light_sum is not null""")
def index_to_base_year(spark, sf_dir):
    return SE.index_to_base(country_years(spark, sf_dir), ["country"], "year", "light_sum", 1998)


@R.add()
def country_documents(spark, sf_dir):
    """Nested result of all countries; its parts are checked by the queries above."""
    pop = A.indicators(spark, sf_dir).where("indicator = 'population'").select("country", "year", F.col("value").alias("population"))
    docs = SE.country_documents(per_country(spark, sf_dir), country_years(spark, sf_dir), pop, replace(SeriesRules(), index_year=1998))
    return docs.select("country", F.to_json(F.struct("points", "rolling", "season", "years", "index")).alias("document"))


# --- bridge and units


@R.add(f"{A.with_(A.UNITS, A.BRIDGE)}, {PURITY} select country, {rs('area_km2', 'purity')}, cells from pur")
def purity(spark, sf_dir):
    return pick(LK.purity(A.units(spark, sf_dir), A.bridge(spark, sf_dir)), ["country", "cells"], ["area_km2", "purity"])


@R.add(f"""{A.with_(A.UNITS, A.BRIDGE)}, g as (select unit_id, sum(share) share_sum, count(*) cells, count(*) filter (share >= 5e-1) cells_half from bridge where share < 1 and unit_id < 20 group by unit_id) select unit_id, name, coalesce(share_sum, 0) share_sum, coalesce(cells, 0) cells, coalesce(cells_half, 0) cells_half from units left join g using (unit_id) where coalesce(share_sum, 0) < 1""")
def small_units(spark, sf_dir):
    """Units that the shared cells of the bridge make smaller than one cell; units without cells included."""
    shared = A.bridge(spark, sf_dir).where("share < 1 and unit_id < 20")
    return LK.smaller_than_a_cell(A.units(spark, sf_dir), shared).select("unit_id", "name", "share_sum", "cells", "cells_half")


@R.add(f"""{A.with_(A.BRIDGE)}, s as (select "row", col, sum(share) share from bridge group by all), l as (select (k // {A.COLS})::int "row", (k % {A.COLS})::int col, 1e0 land from range(150) t(k)) select "row", col, abs(coalesce(share, 0) - coalesce(land, 0)) difference from s full join l using ("row", col)""")
def land_differences(spark, sf_dir):
    land = spark.range(150).select(F.floor(F.col("id") / A.COLS).cast("int").alias("row"), (F.col("id") % A.COLS).cast("int").alias("col"), F.lit(1.0).alias("land"))
    return LK.land_differences(A.bridge(spark, sf_dir), land)


@R.add(f"""{A.with_(A.BRIDGE)} select "row", col, unit_id, share from bridge where unit_id >= 20""")
def bridge_without_unit(spark, sf_dir):
    got = LK.missing_units(A.bridge(spark, sf_dir), A.units(spark, sf_dir).where("unit_id < 20"))
    return got.select("row", "col", F.col("unit_id").cast("int").alias("unit_id"), "share")


@R.add(f"""{A.with_(A.UNITS, A.BRIDGE)}, a as (select country, m49_region, sum(area_km2) area from bridge join units using (unit_id) where country is not null group by all) select country, m49_region region from (select *, row_number() over (partition by country order by area desc, m49_region) k from a) where k = 1""")
def region_per_country(spark, sf_dir):
    return LK.region_per_country(A.units(spark, sf_dir), A.bridge(spark, sf_dir))


@R.add(f"""{A.with_(A.UNITS, A.BRIDGE)}, a as (select "row", col, m49_region, sum(share) s from bridge join units using (unit_id) group by all), l as (select "row", col, least(sum(share), 1) land from bridge group by all),
    t as (select *, row_number() over (partition by "row", col order by s desc, m49_region) k from a) select "row", col, land, coalesce(m49_region, '') continent, coalesce(s, 0) continent_share from l left join (select * from t where k = 1) using ("row", col)""")
def land_and_continent(spark, sf_dir):
    return LK.land_and_continent(A.bridge(spark, sf_dir), A.units(spark, sf_dir))


# --- indicators and the cross-section

IND = A.with_(A.UNITS, A.INDICATORS)
YEARS_LIST = list(range(1995, 2002))


@R.add(f"{IND} select indicator, {', '.join(f'avg(case when year = {y} then (value is null)::int end) y{y}' for y in YEARS_LIST)} from indicators group by indicator")
def missing_share(spark, sf_dir):
    got = IN.missing_share(A.indicators(spark, sf_dir), YEARS_LIST)
    return got.select("indicator", *[F.col(str(y)).alias(f"y{y}") for y in YEARS_LIST])


@R.add(f"""{IND}, w as (select country, year, max(case indicator when 'gdp' then value end) g, max(case indicator when 'gdp_per_head' then value end) h, max(case indicator when 'population' then value end) p from indicators group by all)
    select count(*) n, {r('min(h * p / g)', 'min')}, {r('median(h * p / g)', 'median')}, {r('max(h * p / g)', 'max')} from w where g > 0 and h is not null and p is not null""")
def indicator_consistency(spark, sf_dir):
    return pick(IN.consistency(A.indicators(spark, sf_dir), "gdp", "gdp_per_head", "population"), ["n"], ["min", "median", "max"])


@R.add("select o_custkey, o_orderdate, count(*) n from orders group by all having count(*) > 1")
def repeated_keys(spark, sf_dir):
    return IN.repeated_keys(A.table(spark, sf_dir, "orders"), ["o_custkey", "o_orderdate"])


CROSS = f"{CYEAR}, {A.INDICATORS}, ref as (select country, value gdp from indicators where indicator = 'gdp' and year = 1999 and country <> 'C05')"
SELECTED = f"""{CROSS}, f as (select coalesce(l.country, ref.country) country, gdp, l.country is not null here, light_sum, light_pure, light_coverage, light_purity, share_few_months, area_not_loaded from (select * from country_year where year = 1999) l full join ref on ref.country = l.country),
sel as (select *, list_filter([case when gdp is null then 'no reference value for this year' end, case when not here then 'no cell in the bridge' end, case when here and area_not_loaded > 0 then 'not completely loaded' end, case when here and not coalesce(light_sum > 0, false) then 'light sum is 0 or cannot be determined' end,
    case when here and light_sum > 0 and not coalesce(light_coverage >= 9e-1, false) then 'light coverage' end, case when here and light_sum > 0 and not coalesce(light_purity >= 1e-1, false) then 'purity' end], lambda x: x is not null) reasons from f)"""
LOOSE = replace(RULES, purity_limit=0.1, purity_variants=(0.05, 0.3))


def cross_inputs(spark, sf_dir):
    light = country_years(spark, sf_dir).where("year = 1999").drop("year").withColumn("area_not_loaded", F.col("area_not_loaded"))
    gdp = A.indicators(spark, sf_dir).where("indicator = 'gdp' and year = 1999 and country <> 'C05'").select("country", F.col("value").alias("gdp"))
    return light, gdp


@R.add(f"{SELECTED} select country, {r('gdp', digits=2)}, {r('light_sum', digits=2)}, len(reasons) = 0 included, array_to_string(reasons, '; ') reasons from sel")
def selected_countries(spark, sf_dir):
    got = CS.select_countries(*cross_inputs(spark, sf_dir), LOOSE)
    short = F.transform("reasons", lambda x: F.when(x.startswith("light coverage"), "light coverage").when(x.startswith("purity"), "purity").otherwise(x))
    return pick(got.select("country", "included", F.array_join(short, "; ").alias("reasons"), "gdp", "light_sum"), ["country", "included", "reasons"], ["gdp", "light_sum"], 2)


POINTS = f"{CROSS}, pt as (select country, ln(gdp) x, ln(light_sum) y from (select * from country_year where year = 1999) join ref using (country) where light_sum > 0 and gdp > 0)"


def points(spark, sf_dir):
    light, gdp = cross_inputs(spark, sf_dir)
    return light.join(gdp, "country").where("light_sum > 0 and gdp > 0").select("country", F.log("gdp").alias("x"), F.log("light_sum").alias("y"))


@R.add(f"{POINTS} select count(*) n, {r('regr_slope(y, x)', 'slope')}, {r('regr_intercept(y, x)', 'intercept', 4)}, {r('regr_r2(y, x)', 'r2')} from pt")
def light_on_gdp(spark, sf_dir):
    got = CS.least_squares(points(spark, sf_dir), [])
    return pick(got.withColumn("intercept", F.round("intercept", 4) + 0.0), ["n", "intercept"], ["slope", "r2"])


@R.add(f"{POINTS}, l as (select regr_slope(y, x) b, regr_intercept(y, x) a from pt) select country, {r('y - a - b * x', 'residual', 5)} from pt, l order by abs(y - a - b * x) desc, country limit 10")
def largest_residuals(spark, sf_dir):
    return pick(CS.residuals(points(spark, sf_dir)), ["country"], ["residual"], 5)


@R.add()
def regression_with_interval(spark, sf_dir):
    return pick(CS.regression(points(spark, sf_dir), "country", LOOSE), ["n"], ["slope", "intercept", "r2", "low", "high"])


def _variant(name: str, value: str, more: str) -> str:
    return f"select '{name}' variant, ln(gdp) x, ln({value}) y from f where gdp is not null and light_sum > 0 and light_coverage >= 9e-1 and {value} > 0 and {more}"


VARIANTS = f"""{CROSS}, f as (select * from (select * from country_year where year = 1999) join ref using (country)), pts as ({' union all '.join([
    _variant('main', 'light_sum', 'light_purity >= 1e-1'), _variant('pure_cells_only', 'light_pure', 'light_purity >= 1e-1'), _variant('purity_5', 'light_sum', 'light_purity >= 5e-2'),
    _variant('purity_30', 'light_sum', 'light_purity >= 3e-1'), _variant('without_few_months', 'light_sum', 'light_purity >= 1e-1 and not coalesce(share_few_months > 1 / 3e0, false)'),
    _variant('without_unclear_territory', 'light_sum', 'light_purity >= 1e-1')])})"""


@R.add(f"{VARIANTS} select variant, count(*) n, case when count(*) >= 3 then round(regr_slope(y, x), 6) + 0e0 end slope, case when count(*) >= 3 then round(regr_r2(y, x), 6) + 0e0 end r2 from pts group by variant")
def regression_variant_lines(spark, sf_dir):
    """The lines of all variants, without the intervals of ``regression_variants``."""
    light, gdp = cross_inputs(spark, sf_dir)
    _, pts = CS.variant_points(light.withColumn("area_not_loaded", F.lit(0.0)), gdp, LOOSE)
    return pick(CS.least_squares(pts, ["variant"]), ["variant", "n"], ["slope", "r2"])


@R.add()
def regression_variants(spark, sf_dir):
    light, gdp = cross_inputs(spark, sf_dir)
    return pick(CS.variants(light.withColumn("area_not_loaded", F.lit(0.0)), gdp, LOOSE), ["variant", "n"], ["slope", "r2", "low", "high"])


@R.add(f"""{IND}, i as (select country, year, sum(case when indicator = 'gdp' then value end) v from indicators group by all), g as (select country, count(*) n, regr_slope(v, year) slope, regr_r2(v, year) r2 from i where v is not null group by country) select country, n, {r('slope', digits=3)}, {r('r2')} from g where n >= 3""")
def slopes_per_country(spark, sf_dir):
    p = A.indicators(spark, sf_dir).where("indicator = 'gdp' and value is not null").select("country", F.col("year").cast("double").alias("x"), F.col("value").alias("y"))
    got = CS.least_squares(p, ["country"]).where("n >= 3").withColumn("slope", F.round("slope", 3) + 0.0)
    return pick(got, ["country", "n", "slope"], ["r2"])


