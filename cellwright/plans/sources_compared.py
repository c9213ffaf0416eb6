"""Pixel, regridding, diagnosis, comparison and streaming-shaped queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import Criteria, DiagnosisRules
from ..functions.months import month_index
from ..operators import breaks as BR
from ..operators import compare as CO
from ..operators import diagnosis as DI
from ..operators import pixels as PX
from ..streaming import live
from . import adapters as A
from .base import Registry, pick, r, rs

R = Registry()

# --- pixels: lineitem rows as pixels of tiles and of a fine grid

PIX = """px as (select (l_partkey % 4)::int h, (l_suppkey % 3)::int v, (l_orderkey * 7 % 2400)::int py, (l_orderkey * 13 % 2400)::int px, case when l_linenumber = 7 then -9999e-1 else round(l_extendedprice)::double end as value, case when l_linenumber = 6 then 65535 else l_quantity::int end num,
case when l_returnflag = 'R' then 2 else 0 end quality from lineitem)"""


def pixels(spark, sf_dir):
    li = A.table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    return li.select(
        (F.col("l_partkey") % 4).cast("int").alias("h"), (F.col("l_suppkey") % 3).cast("int").alias("v"), (k * 7 % 2400).cast("int").alias("py"), (k * 13 % 2400).cast("int").alias("px"),
        F.when(F.col("l_linenumber") == 7, -999.9).otherwise(F.round("l_extendedprice")).alias("value"), F.when(F.col("l_linenumber") == 6, 65535).otherwise(F.col("l_quantity").cast("int")).alias("num"), F.when(F.col("l_returnflag") == "R", 2).otherwise(0).alias("quality"),
    )


@R.add(
    f"""with {PIX}, x as (select (v * 40 + py // 60)::int "row", (h * 40 + px // 60)::int col, case when value > -900 then value end x, case when num <> 65535 then num end num, quality = 2 gap from px)
    select "row", col, {r('avg(x)', 'mean', 4)}, {r('avg(case when not gap then x end)', 'mean_observed', 4)}, {r('avg(case when x is not null then num end)', 'num', 4)}, count(x) as valid, count(x) filter (not gap) observed, count(x) filter (gap) filled from x group by all"""
)
def reduced_tiles(spark, sf_dir):
    return pick(PX.reduce_tiles(pixels(spark, sf_dir)), ["row", "col", "valid", "observed", "filled"], ["mean", "mean_observed", "num"], 4)


FINE = """fine as (select (l_orderkey % 30)::int i, (l_partkey % 60)::int j, case when count(*) % 5 > 0 then sum(round(l_extendedprice)::bigint) / 1e6 end a, case when count(*) % 4 > 0 then sum(l_quantity::int) / 1e2 end p, min(l_tax) q from lineitem group by all)"""


def fine(spark, sf_dir):
    g = A.table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 30).cast("int").alias("i"), (F.col("l_partkey") % 60).cast("int").alias("j"))
    n = F.count("*")
    return g.agg(F.when(n % 5 > 0, F.sum(F.round("l_extendedprice").cast("long")) / 1e6).alias("a"), F.when(n % 4 > 0, F.sum(F.col("l_quantity").cast("int")) / 1e2).alias("p"), F.min("l_tax").alias("q"))


def axis_sql(name: str, n: int, m: int) -> str:
    return f"select t::int {name[0]}, s::int {name[1]}, greatest(t * 5, s * 2) t0, least(t * 5 + 5, s * 2 + 2) t1 from range({n}) a(t), range({m}) b(s) where s * 2 < t * 5 + 5 and s * 2 + 2 > t * 5"


@R.add(f"""with w as ({axis_sql('mi', 12, 30)}) select m target, i source, t0::int t0, t1::int t1 from w""")
def axis_overlaps(spark, sf_dir):
    return PX.overlaps(spark, 12, 5, 30, 2)


@R.add(
    f"""with {FINE}, la as (select m, i, sin(radians(-90 + t1 * 3e0)) - sin(radians(-90 + t0 * 3e0)) wl from ({axis_sql('mi', 12, 30)})), lo as (select n, j, (t1 - t0)::double wo from ({axis_sql('nj', 24, 60)})),
    x as (select m, n, wl * wo w, a, p, q from fine join la using (i) join lo using (j)) select m, n, {r('sum(w * a) / sum(case when a is not null then w end)', 'a')}, {r('coalesce(least(1, sum(case when a is not null then w end) / sum(w)), 0)', 'a_share')}, count(a) a_pixels,
    {r('sum(w * p * q) / nullif(sum(case when q is not null then w * p end), 0)', 'q')}, {r('min(q)', 'q_min')} from x group by all"""
)
def regridded(spark, sf_dir):
    """A 30 x 60 grid onto 12 x 24 cells: mean, share and pixels, weighted mean, minimum."""
    wl, wo = PX.lat_weights(spark, 12, 5, 30, 2, 3.0), PX.lon_weights(spark, 24, 5, 60, 2)
    got = PX.regrid(fine(spark, sf_dir), wl, wo, means=("a",), weighted={"q": "p"}, minima=("q",))
    return pick(got, ["m", "n", "a_pixels"], ["a", "a_share", "q", "q_min"])


DAYS = """dy as (select user_id % 40 cell, value, case when event_id % 11 = 0 then 1 else 0 end quality, case when event_id % 13 = 0 then 1 else 0 end snow, ((event_id * 37) % 256)::int cloud_mask from events)"""


@R.add(
    f"""with {DAYS}, g as (select * from dy where quality = 0 and snow = 0 and ((cloud_mask >> 6) & 3) <= 1 and (cloud_mask & 1) = 0), q as (select cell, quantile_cont(value, 25e-2) a, quantile_cont(value, 75e-2) b from g group by cell),
    m as (select cell, avg(value) v, count(*) nights from g join q using (cell) where value between a - 15e-1 * (b - a) and b + 15e-1 * (b - a) group by cell) select cell, nights, round(case when v < 5e-1 then 0 else v end, 6) + 0e0 as value from m"""
)
def months_from_days(spark, sf_dir):
    e, k = A.table(spark, sf_dir, "events"), F.col("event_id")
    d = e.select((F.col("user_id") % 40).alias("cell"), "value", F.when(k % 11 == 0, 1).otherwise(0).alias("quality"), F.when(k % 13 == 0, 1).otherwise(0).alias("snow"), (k * 37 % 256).cast("int").alias("cloud_mask"))
    return pick(PX.monthly_from_days(d, ["cell"]), ["cell", "nights"], ["value"])


@R.add(f"""{A.with_(A.CUBE)}, p as (select lat + month(month) / 1e1 lat, lon, case when month(month) % 5 > 0 then mean_obs end v from cube) select floor((90 - lat) / 5)::int "row", floor((lon + 180) / 5)::int col, {r('avg(v)', 'value', 2)}, {r('avg((v is not null)::int)', 'share', 2)} from p group by all""")
def pixels_on_grid(spark, sf_dir):
    m = F.month("month")
    p = A.cube(spark, sf_dir).select((F.col("lat") + m / 10.0).alias("lat"), "lon", F.when(m % 5 > 0, F.col("mean_obs")).alias("value"))
    return pick(PX.to_grid(p, step=5.0), ["row", "col"], ["value", "share"], 2)


@R.add(f"""{A.with_(A.CUBE)} select month, {r('sum(mean_obs * 24 * day(last_day(month)))', 'total', 2)} from cube where valid >= 1 group by month""")
def month_totals(spark, sf_dir):
    c = PX.composite(A.cube(spark, sf_dir), "valid")
    return pick(c.groupBy("month").agg(F.sum(PX.to_month_total(F.col("mean_obs"), F.col("month"))).alias("total")), ["month"], ["total"], 2)


# --- diagnosis on the cube

DR = replace(DiagnosisRules(), base_years=(1995, 1996, 1997, 1998), min_base_years=3, min_level_months=20, min_base_value=30.0, dark_to=36.0, medium_to=38.0, r1_lat=(0.0, 40.0), r1_min_months=20, r1_max=85.0, r2_lat=90.0, r2_min_months=20, r2_per_year=4, r2_min_cells=3, r2_deviation=0.3, bootstrap=50, panel_lat=90.0)
WINTER = "(case when lat >= 0 then month(month) in (11, 12, 1, 2, 3, 4) else month(month) in (5, 6, 7, 8, 9, 10) end)"
PREP = f"""{A.with_(A.CUBE)}, d0 as (select month, "row", col, lat, mean_obs x, (valid - filled) / 36e2 s, month(month) mo, year(month) yr from cube), d1 as (select *, s >= 5e-1 and not coalesce(abs(lat) >= 235e-1 and {WINTER} and s < 9e-1, false) ok from d0),
bm as (select "row", col, mo, case when count(*) >= 3 then median(x) end base from d1 where ok and yr between 1995 and 1998 group by all), lv as (select "row", col, case when count(*) >= 20 then median(x) end level from d1 where ok and yr between 1995 and 1998 group by all),
prep as (select d1.*, base, level, coalesce(ok and base >= 30, false) usable, case when level < 36 then 'dark' when level < 38 then 'medium' when level >= 38 then 'bright' else '' end as class,
    6371e0 * 6371e0 * radians(25e-2) * (sin(radians(lat + 125e-3)) - sin(radians(lat - 125e-3))) area from d1 left join bm using ("row", col, mo) left join lv using ("row", col))"""


def prepared(spark, sf_dir):
    return DI.prepared(A.cube(spark, sf_dir), DR)


@R.add(f"{PREP} select month, \"row\", col, ok, {rs('base', 'level')}, usable, class from prep")
def baselines_and_levels(spark, sf_dir):
    return pick(prepared(spark, sf_dir), ["month", "row", "col", "ok", "usable", "class"], ["base", "level"])


@R.add(
    f"""{PREP}, g as (select *, 'all' grp from prep union all select *, 'north' from prep where lat > 0 union all select *, class from prep where class in ('medium', 'bright'))
    select month, grp as "group", {r('sum(area * x) / sum(area * base)', 'index')}, {r('median(x / base)', 'median_ratio')}, count(*) cells from g where usable group by all"""
)
def month_indices(spark, sf_dir):
    groups = {"all": F.lit(True), "north": F.col("lat") > 0, "medium": F.col("class") == "medium", "bright": F.col("class") == "bright"}
    return pick(DI.month_index_of(DI.groups_of(prepared(spark, sf_dir), groups), ["group"]), ["month", "group", "cells"], ["index", "median_ratio"])


@R.add(f"{PREP} select yr::int as year, {r('sum(area * x) / sum(area * base)', 'index')} from prep where usable group by yr")
def year_indices(spark, sf_dir):
    return pick(DI.year_index_bootstrap(prepared(spark, sf_dir), DR)[0], ["year"], ["index"])


@R.add()
def year_intervals(spark, sf_dir):
    points, boot = DI.year_index_bootstrap(prepared(spark, sf_dir).withColumn("tile", F.col("col")), DR)
    return pick(DI.year_intervals(points, boot), ["year"], ["index", "low", "high"])


@R.add()
def year_ratio(spark, sf_dir):
    points, boot = DI.year_index_bootstrap(prepared(spark, sf_dir).withColumn("tile", F.col("col")), DR)
    return pick(DI.ratio_interval(points, boot, 2000, 1998), [], ["ratio", "low", "high"])


@R.add(f"""{PREP}, l as (select (k // {A.COLS})::int "row", (k % {A.COLS})::int col from range({A.ROWS * A.COLS}) t(k) where k % 3 = 0), b as (select "row", col, max(x) top, count(*) n, min(lat) lat from prep where ok and yr between 1995 and 1998 group by all) select "row", col from b join l using ("row", col) where abs(lat) between 0 and 40 and n >= 20 and top < 85""")
def dark_reference_cells(spark, sf_dir):
    land = spark.range(A.ROWS * A.COLS).where("id % 3 = 0").select(F.floor(F.col("id") / A.COLS).cast("int").alias("row"), (F.col("id") % A.COLS).cast("int").alias("col"), F.lit(1.0).alias("land"))
    return DI.dark_reference(prepared(spark, sf_dir), land, DR)


@R.add(
    f"""{PREP}, y as (select "row", col, yr, avg(x / base) m, count(*) n from prep where usable and yr between 1995 and 1998 group by all), g as (select "row", col, max(abs(ln(m))) dev, min(n) lo, count(*) ys, sum(n) n from y group by all),
    f as (select g.*, class from g join (select distinct "row", col, class from prep) using ("row", col)), e as (select * from f where class = 'bright' and n >= 20 and lo >= 4 and ys = 4), c as (select count(*) filter (dev <= 3e-1) k, count(*) a from e)
    select "row", col, {r('dev', 'deviation')}, case when k >= 3 then 'main' else 'fallback' end rule from (select e.*, c.*, row_number() over (order by dev, "row", col) rn from e, c) where (k >= 3 and dev <= 3e-1) or (k < 3 and rn <= greatest(1, ceil(1e-1 * a)))"""
)
def stable_reference_cells(spark, sf_dir):
    return pick(DI.stable_reference(prepared(spark, sf_dir), DR), ["row", "col", "rule"], ["deviation"])


MONTHLY = f"{PREP}, ms as (select month, ln(sum(area * x)) y from prep where ok group by month)"


def monthly(spark, sf_dir):
    return prepared(spark, sf_dir).where("ok").groupBy("month").agg(F.log(F.sum(F.col("area") * F.col("x"))).alias("y"))


@R.add(f"""{MONTHLY}, q as (select year(month) * 4 + quarter(month) - 1 q, avg(y) m from ms group by 1), s as (select q, m - lag(m) over (order by q) step, lag(q) over (order by q) b from q) select case when q % 4 = 0 then 'boundary' else 'inner' end kind, {r('avg(step)', 'mean')}, {r('stddev_pop(step)', 'sd')}, count(*) n from s where q = b + 1 group by 1""")
def quarter_contrast(spark, sf_dir):
    return pick(DI.quarter_contrast(monthly(spark, sf_dir)), ["kind", "n"], ["mean", "sd"])


@R.add(f"""{MONTHLY}, s as (select month, y - lag(y) over (order by month) change, year(month) * 12 + month(month) - lag(year(month) * 12 + month(month)) over (order by month) gap from ms) select month, {r('change')} from s where gap = 1 order by abs(change) desc, month limit 6""")
def largest_month_changes(spark, sf_dir):
    return pick(DI.largest_changes(monthly(spark, sf_dir)), ["month"], ["change"])


PSPAN = "month between date '1998-01-01' and date '1998-06-01'"


@R.add(f"""{PREP}, u as (select * from prep where {PSPAN}), f as (select "row", col from u where ok and level >= 36 group by all having count(*) = (select count(distinct month) from u)) select month, {r('ln(sum(area * x))', 'y')}, count(*) cells from u join f using ("row", col) group by month""")
def panel_series(spark, sf_dir):
    return pick(DI.panel_series(prepared(spark, sf_dir).where(PSPAN.replace("date ", "date")), DR), ["month", "cells"], ["y"])


@R.add(f"""{A.with_(A.CUBE)}, y as (select "row", col, year(month) yr, avg(mean_obs) a, avg(mean_cand) b from cube where year(month) in (1997, 2000) group by all), w as (select "row", col, max(case yr when 2000 then a end) - max(case yr when 1997 then a end) ra, max(case yr when 2000 then b end) - max(case yr when 1997 then b end) rb from y group by all)
    select "row", col, {r('rb / ra', 'share', 4)}, case when ra < 5e-2 then 'no rise' when rb / ra >= 2e0 / 3 then 'same' when rb / ra < 1e0 / 3 then 'none' else 'partial' end verdict from w where ra <> 0""")
def source_verdicts(spark, sf_dir):
    g = A.cube(spark, sf_dir).where(F.year("month").isin(1997, 2000)).groupBy("row", "col", F.year("month").alias("yr")).agg(F.avg("mean_obs").alias("a"), F.avg("mean_cand").alias("b"))

    def rise(c):
        return F.max(F.when(F.col("yr") == 2000, F.col(c))) - F.max(F.when(F.col("yr") == 1997, F.col(c)))

    rows = g.groupBy("row", "col").agg(rise("a").alias("rise_ref"), rise("b").alias("rise_cand")).where("rise_ref <> 0")
    return pick(DI.source_verdict(rows), ["row", "col", "verdict"], ["share"], 4)


@R.add("""select strftime(ts, '%Y-%m') as month, sum(case when event_type = 'click' then 1 else 0 end)::double / count(*) share from events group by 1""")
def version_share(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))
    days = e.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("event_type", F.lit(" v1")), "n"))).alias("counters"))
    return DI.version_share(days, "click")


@R.add()
def break_models(spark, sf_dir):
    """One series per row of cells; tested against plain least squares."""
    c = A.cube(spark, sf_dir).groupBy("row", "month").agg(F.avg("mean_obs").alias("y")).withColumn("t", month_index(F.col("month")))
    return pick(BR.break_models(c, ["row"]), ["row", "model", "k"], ["coefficient", "slope", "rss", "bic"], 4)


@R.add()
def break_models_with_season(spark, sf_dir):
    c = A.cube(spark, sf_dir).groupBy("month").agg(F.avg("mean_obs").alias("y")).withColumn("t", month_index(F.col("month"))).withColumn("all", F.lit(1))
    return pick(BR.break_models(c, ["all"], seasonal=True), ["model", "k"], ["coefficient", "bic"], 4)


@R.add()
def break_bootstrap(spark, sf_dir):
    c = A.cube(spark, sf_dir).groupBy("month").agg(F.avg("mean_obs").alias("y")).withColumn("t", month_index(F.col("month"))).withColumn("all", F.lit(1))
    return BR.break_bootstrap(c, ["all"], replicates=50).groupBy("k").agg(F.count("*").alias("n"))


# --- two sources

C = replace(Criteria(), dark_to=30.0, medium_to=40.0, k4_false_from=29.0)
PAIR = f"""{A.with_(A.CUBE)}, pair as (select "row", col, lat, mean_obs as "ref", mean_cand cand, ("row" + col) % 7 <> 3 ref_has, ("row" * 3 + col) % 8 <> 5 cand_has from cube where month = date '1998-05-01'),
both_ as (select *, case when "ref" < 30 then 'dark' when "ref" < 40 then 'medium' else 'bright' end k, cand / "ref" q, log10(greatest("ref", 0) + 1e-1) lr, log10(greatest(cand, 0) + 1e-1) lc from pair where ref_has and cand_has)"""


def pair(spark, sf_dir):
    c = A.cube(spark, sf_dir).where("month = date'1998-05-01'")
    return c.select("row", "col", "lat", F.col("mean_obs").alias("ref"), F.col("mean_cand").alias("cand"), ((F.col("row") + F.col("col")) % 7 != 3).alias("ref_has"), ((F.col("row") * 3 + F.col("col")) % 8 != 5).alias("cand_has"))


MEASURES = f"{r('median(q)', 'median_q')}, {r('median(abs(q - 1))', 'median_dev')}, {r('avg((q > 2 or q < 5e-1)::int)', 'factor2')}"


@R.add(
    f"""{PAIR} select k as class, count(*) cells, {r('corr(lr, lc)', 'r_log')}, {r('avg(cand - "ref")', 'mean_difference', 5)}, {r("median(case when k <> 'dark' then q end)", 'median_q')}, {r("median(case when k <> 'dark' then abs(q - 1) end)", 'median_dev')},
    {r("avg(case when k <> 'dark' then (q > 2 or q < 5e-1)::int end)", 'factor2')}, {r("avg(case when k = 'dark' then (cand >= 29)::int end)", 'false_light')} from both_ group by k having count(*) >= 3"""
)
def comparison_by_class(spark, sf_dir):
    got = CO.class_measures(pair(spark, sf_dir), C).where("cells >= 3").withColumn("mean_difference", F.round("mean_difference", 5) + 0.0)
    return pick(got, ["class", "cells", "mean_difference"], ["r_log", "median_q", "median_dev", "factor2", "false_light"])


@R.add(f"""{PAIR}, g as (select *, sqrt(greatest("ref", 0) * greatest(cand, 0)) gm from both_) select case when gm < 40 then 'medium' else 'bright' end as class, count(*) cells, {MEASURES} from g where gm >= 30 group by 1""")
def comparison_by_both(spark, sf_dir):
    return pick(CO.classes_by_both(pair(spark, sf_dir), C), ["class", "cells"], ["median_q", "median_dev", "factor2"])


BANDS = ((20, 40), (0, 20), (-20, 0), (-40, -20))


@R.add(
    f"""{PAIR}, b as (select unnest([20e0, 0e0, -20e0, -40e0]) lat_from, unnest([40e0, 20e0, 0e0, -20e0]) lat_to), j as (select pair.*, lat_from, lat_to, cand / "ref" q, ref_has and cand_has bv from pair join b on lat >= lat_from and lat < lat_to)
    select lat_from, lat_to, count(*) filter (bv and "ref" >= 30) cells, {r('median(case when bv and "ref" >= 30 then q end)', 'median_q')}, {r('median(case when bv and "ref" >= 30 then abs(q - 1) end)', 'median_dev')}, count(*) filter (bv and "ref" < 30 and cand >= 29) false_light,
    count(*) filter (ref_has and not cand_has) only_ref, count(*) filter (cand_has and not ref_has) only_cand from j group by all"""
)
def comparison_by_latitude(spark, sf_dir):
    got = CO.by_latitude(pair(spark, sf_dir), BANDS, C)
    return pick(got, ["lat_from", "lat_to", "cells", "false_light", "only_ref", "only_cand"], ["median_q", "median_dev"])


@R.add(
    f"""{PAIR}, v as (select (select count(*) from pair) cells_region, count(*) cells_both, corr(lr, lc) filter ("ref" >= 30) r_log, median(q) filter (k = 'medium') mq, median(abs(q - 1)) filter (k = 'medium') md, median(q) filter (k = 'bright') bq, median(abs(q - 1)) filter (k = 'bright') bd,
    avg((q > 2 or q < 5e-1)::int) filter (k = 'medium') mf, avg((q > 2 or q < 5e-1)::int) filter (k = 'bright') bf, avg((cand >= 29)::int) filter (k = 'dark') fl from both_), s as (select avg((ref_has = cand_has)::int) same, avg((not cand_has)::int) filter (ref_has) miss from pair),
    c as (select v.*, s.*, coalesce(r_log >= 95e-2, false) k1, coalesce(mq between 9e-1 and 11e-1 and md <= 15e-2, false) and coalesce(bq between 9e-1 and 11e-1 and bd <= 15e-2, false) k2, coalesce(mf <= 5e-2 and bf <= 5e-2, false) k3, coalesce(fl <= 2e-2, false) k4, coalesce(same >= 95e-2 and miss <= 5e-2, false) k5 from v, s)
    select cells_region, cells_both, {r('r_log')}, {r('mq', 'medium_q')}, {r('bq', 'bright_q')}, {r('same', 'same_state')}, k1, k2, k3, k4, k5, case when k1 and k2 and k3 and k4 and k5 then 'met' when k1 then 'partly' else 'not met' end verdict from c"""
)
def comparison_verdict(spark, sf_dir):
    got = CO.verdict(pair(spark, sf_dir), c=C)
    return pick(got, ["cells_region", "cells_both", "k1", "k2", "k3", "k4", "k5", "verdict"], ["r_log", "medium_q", "bright_q", "same_state"])


@R.add()
def comparison_bootstrap(spark, sf_dir):
    return pick(CO.block_bootstrap(pair(spark, sf_dir), 100, per_block=5, c=C), ["measure"], ["low", "high"])


# --- the stream's expression on the batch table


@R.add(f"""select date_trunc('day', ts) as start, date_trunc('day', ts) + interval 1 day as "end", event_type, count(*) n, {r('sum(value)', 'total', 4)} from events group by all""")
def events_per_day(spark, sf_dir):
    got = live.windowed(A.table(spark, sf_dir, "events"))
    got = got.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})
    return pick(got, ["start", "end", "event_type", "n"], ["total"], 4)


@R.add("""with g as (select *, case when ts - lag(ts) over w < interval 6 hour then 0 else 1 end fresh from events window w as (partition by user_id order by ts)), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) k from g) select user_id, min(ts) as start, max(ts) + interval 6 hour as "end", count(*) n from s group by user_id, k""")
def event_sessions(spark, sf_dir):
    got = live.sessions(A.table(spark, sf_dir, "events"))
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
