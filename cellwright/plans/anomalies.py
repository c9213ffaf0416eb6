"""Anomaly, event, trend and spatial queries on the ``lineitem`` cube.

Thresholds are lower than the defaults: the table's prices hardly vary.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import MinLengths, Thresholds, TrendSettings
from ..functions.months import month_index
from ..functions.quality import snow_suspected
from ..operators import anomaly as AN
from ..operators import components as C
from ..operators import diagnosis as DI
from ..operators import spatial as SP
from ..operators import trend as TR
from . import adapters as A
from .base import Registry, pick, r, rs

R = Registry()
DEMO = replace(Thresholds(), z_min=1.0, z_strong=2.0, z_extreme=3.0, min_cells=2, pool_min_cells=20, q=0.6)

SNOW = "(abs(lat) >= 235e-1 and (case when lat >= 0 then month(month) in (11, 12, 1, 2, 3, 4) else month(month) in (5, 6, 7, 8, 9, 10) end) and observed < 9e-1)"
SCORED = f"""{A.with_(A.CUBE, A.STATES)},
b0 as (select cube.*, year(month) yr, month(month) mo, case when filled < 0 or filled > valid then 0e0 else (valid - filled) / 36e2 end observed from cube join states using (month) where state = 1),
b1 as (select *, observed >= 5e-1 and {SNOW} snow, observed >= 5e-1 and not {SNOW} usable from b0),
h as (select a.month, a."row", a.col, list(b.mean_obs) l from b1 a join b1 b on a."row" = b."row" and a.col = b.col and a.mo = b.mo and b.yr < a.yr and b.usable group by all),
m as (select b1.*, coalesce(len(l), 0)::int n_base, list_aggregate(l, 'median') med, list_aggregate(l, 'avg') bm, case when len(l) > 1 then list_aggregate(l, 'stddev_samp') end bs, l from b1 left join h using (month, "row", col)),
d as (select *, 14826e-4 * list_aggregate(list_transform(l, lambda v: abs(v - med)), 'median') sm from m),
p0 as (select month, n_base, case when med >= 1 then sm / greatest(abs(med), 1) end rel from d where n_base >= 5),
p1 as (select month, n_base, count(rel) n, quantile_cont(rel, 75e-2) own from p0 group by all), p2 as (select month, count(rel) n_all, quantile_cont(rel, 75e-2) whole from p0 group by all),
rho as (select month, n_base, case when n >= 20 then own when n_all >= 20 then whole end rho from p1 join p2 using (month)),
z0 as (select d.*, rho, coalesce(usable and n_base >= 5 and rho is not null and med is not null, false) scored from d left join rho using (month, n_base)),
z as (select *, case when scored then (mean_obs - med) / (greatest(coalesce(sm, 0), rho * greatest(abs(med), 1), 5e-1) * sqrt(1 + pi() / 2 / greatest(n_base, 1))) end z,
    case when scored then (mean_obs - bm) / (greatest(coalesce(bs, 0), rho * greatest(abs(bm), 1), 5e-1) * sqrt(1 + 1 / greatest(n_base, 1)::double)) end zc from z0),
scored as (select month, "row", col, lat, lon, observed, snow, n_base, scored, z, zc, coalesce((abs(z) >= 1) <> (abs(zc) >= 1), false) disagree,
    case when not scored then 0 when observed >= 9e-1 and n_base >= 8 then 3 when observed >= 7e-1 and n_base >= 6 then 2 else 1 end quality, filled / valid::double filled_share,
    case when med >= 1 then (mean_obs - med) / med end relative_change, coalesce(scored and med >= 1, false) bright, (year(month) * 12 + month(month) - 1)::int t from z)"""


def scored(spark, sf_dir):
    return AN.score_cells(A.cube(spark, sf_dir), A.states(spark, sf_dir), DEMO)


@R.add(f"{SCORED} select month, \"row\", col, {rs('observed')}, snow, n_base, scored, {rs('z')}, {r('zc', 'z_classic')}, disagree, quality, {rs('filled_share', 'relative_change')}, bright from scored")
def anomaly_cell_map(spark, sf_dir):
    return pick(scored(spark, sf_dir), ["month", "row", "col", "snow", "n_base", "scored", "disagree", "quality", "bright"], ["observed", "z", "z_classic", "filled_share", "relative_change"])


@R.add(f"{SCORED} select month, \"row\", col, {rs('z')} from scored where z is not null order by abs(z) desc, month, \"row\", col limit 25")
def anomaly_top_cells(spark, sf_dir):
    got = scored(spark, sf_dir).where("z is not null").orderBy(F.desc(F.abs("z")), "month", "row", "col").limit(25)
    return pick(got, ["month", "row", "col"], ["z"])


P = "exp(-2 * abs(z))"
MARKED = f"""{SCORED},
f0 as (select *, case when z is not null then {P} end p from scored), f1 as (select *, row_number() over (partition by month order by p) i, count(*) over (partition by month) m from f0 where p is not null),
cut as (select month, max(p) cut from f1 where p <= 6e-1 * i / m group by month),
k0 as (select f0.*, coalesce(p <= cut, false) bh from f0 left join cut using (month)),
k1 as (select *, coalesce(bh and abs(z) >= 1, false) marked from k0), k2 as (select *, case when marked then sign(z)::int else 0 end sign from k1),
k3 as (select *, t - row_number() over (partition by "row", col, sign order by t) island from k2),
marked as (select *, case when marked then row_number() over (partition by "row", col, sign, island order by t) else 0 end run from k3)"""


def marked(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("p", F.when(F.col("z").isNotNull(), F.exp(-2 * F.abs("z"))))
    return AN.mark_cells(rows, DEMO, "p")


@R.add(f"{MARKED} select month, \"row\", col, {rs('p')}, bh, marked, sign, run::int run from marked")
def false_discovery_and_runs(spark, sf_dir):
    return pick(marked(spark, sf_dir), ["month", "row", "col", "bh", "marked", "sign", "run"], ["p"])


GROUPS = f"""{MARKED}, nodes as (select *, "row"::bigint * {A.COLS} + col node from marked where marked and run >= 1),
e as (select a.month, a.sign, a.node a, b.node b from nodes a join nodes b on a.month = b.month and a.sign = b.sign and abs(a."row" - b."row") <= 1 and (a.col - b.col + {A.COLS}) % {A.COLS} in (0, 1, {A.COLS - 1}) and a.node <> b.node),
reach(month, sign, node, far) as (select month, sign, node, node from nodes union select reach.month, reach.sign, reach.node, e.b from reach join e on e.month = reach.month and e.sign = reach.sign and e.a = reach.far),
roots as (select month, sign, node, min(far) root from reach group by all), big as (select month, sign, root from roots group by all having count(*) >= 2),
nr as (select *, row_number() over (partition by month order by sign desc, root) nr from big),
ev as (select nodes.*, nr, case when abs(z) >= 3 then 3 when abs(z) >= 2 then 2 else 1 end band from nodes join roots using (month, sign, node) join nr using (month, sign, root))"""


@R.add(f"{GROUPS} select month, \"row\", col, sign, nr::int nr, band from ev")
def event_cells(spark, sf_dir):
    return AN.event_cells(marked(spark, sf_dir), A.COLS, DEMO).select("month", "row", "col", "sign", "nr", "band")


@R.add(
    f"""{GROUPS}, mid as (select month, nr, degrees(atan2(avg(sin(radians(lon))), avg(cos(radians(lon))))) lon_mid from ev group by all),
    o as (select ev.*, lon_mid, ((lon - lon_mid + 180) % 360 + 360) % 360 - 180 off from ev join mid using (month, nr))
    select 'light-' || strftime(month, '%Y-%m') || '-' || lpad(nr::text, 3, '0') id, month, case when min(sign) > 0 then 'rise' else 'decline' end direction, count(*) n_cells,
    round(sum(6371e0 * 6371e0 * radians(8e0) * (sin(radians(lat + 4)) - sin(radians(lat - 4)))), 2) + 0e0 area_km2, round(avg(lat), 4) + 0e0 lat_mid, min(lat) lat_min, max(lat) lat_max, round(median(z), 6) + 0e0 z_median,
    case when median(abs(z)) >= 3 then 'extreme' when median(abs(z)) >= 2 then 'strong' else 'noticeable' end band, ['insufficient', 'thin', 'medium', 'good'][min(quality) + 1] quality, min(n_base) n_base_min, round(avg(disagree::int), 6) + 0e0 disagree_share,
    case when abs(lon_mid) > 1799999e-4 then 18e1 else round(lon_mid, 4) + 0e0 end lon_mid, round(((lon_mid + min(off) + 180) % 360 + 360) % 360 - 180, 4) + 0e0 lon_min, round(((lon_mid + max(off) + 180) % 360 + 360) % 360 - 180, 4) + 0e0 lon_max,
    round((list(z order by abs(z) desc, "row", col))[1], 6) + 0e0 z_max from o group by month, nr, lon_mid"""
)
def events(spark, sf_dir):
    got = AN.events(AN.event_cells(marked(spark, sf_dir), A.COLS, DEMO), DEMO, "light", 8.0)
    # both ends of the longitude axis are the same place
    got = got.withColumn("lon_mid", F.when(F.abs("lon_mid") > 179.9999, 180.0).otherwise(F.col("lon_mid")))
    got = got.withColumns({"area_km2": F.round("area_km2", 2) + 0.0} | {c: F.round(c, 4) + 0.0 for c in ("lat_mid", "lon_mid", "lon_min", "lon_max")})
    return pick(got, ["id", "month", "direction", "n_cells", "area_km2", "lat_mid", "lat_min", "lat_max", "lon_mid", "lon_min", "lon_max", "band", "quality", "n_base_min"], ["z_median", "z_max", "disagree_share"])


@R.add(f"{MARKED} select month, count(*) n_bright, {r('median(z)', 'median_z')}, {r('avg(marked::int)', 'marked_share')}, abs(median(z)) > 5e-1 or avg(marked::int) > 1e-1 suspicious from marked where bright group by month")
def month_diagnosis(spark, sf_dir):
    return pick(AN.month_diagnosis(marked(spark, sf_dir), DEMO), ["month", "n_bright", "suspicious"], ["median_z", "marked_share"])


@R.add(
    f"""{MARKED}, ax as (select month, state, (coalesce(sum((state = 1)::int) over w, 0))::bigint base_months, (coalesce(sum((state <> 1)::int) over w, 0))::bigint missing_base_months from states
    window w as (partition by month(month) order by year(month) rows between unbounded preceding and 1 preceding)), g as (select month, count(*) filter (scored) n_tested, count(*) filter (bh) n_bh, count(*) filter (marked) n_marked from marked group by month)
    select month, case when state <> 1 then 'not loaded' when base_months < 5 then 'cannot be scored' else 'scored' end status, base_months, missing_base_months, coalesce(n_tested, 0) n_tested, coalesce(n_bh, 0) n_bh, coalesce(n_marked, 0) n_marked from ax left join g using (month)"""
)
def month_results(spark, sf_dir):
    return AN.month_results(A.states(spark, sf_dir), marked(spark, sf_dir), DEMO).select("month", "status", "base_months", "missing_base_months", "n_tested", "n_bh", "n_marked")


@R.add()
def nominal_p_values(spark, sf_dir):
    """The normal tail itself, which SQL lacks: tested against the error function."""
    return pick(AN.mark_cells(scored(spark, sf_dir), DEMO), ["month", "row", "col", "bh", "marked"], ["p"])


# --- trends

SERIES = f"""{A.with_(A.CUBE, A.STATES)}, s0 as (select "row", col, lat, (year(month) * 12 + month(month) - 1)::int t, mean_obs x from cube join states using (month) where state = 1),
s1 as (select *, median(x) over (partition by "row", col, t % 12) cm, count(x) over (partition by "row", col, t % 12) cn, median(x) over (partition by "row", col) level from s0),
ys as (select "row", col, lat, t, x, level, case when cn >= 3 then x - cm end y from s1)"""


def series(spark, sf_dir):
    c = A.cube(spark, sf_dir).join(A.states(spark, sf_dir).where("state = 1"), "month", "left_semi")
    return c.select("row", "col", "lat", month_index(F.col("month")).alias("t"), F.col("mean_obs").alias("x"), ((F.col("valid") - F.col("filled")) / 3600.0).alias("share"))


@R.add(f"{SERIES} select \"row\", col, t, {rs('y', 'level')} from ys")
def deseasoned(spark, sf_dir):
    return pick(TR.deseason(series(spark, sf_dir), ["row", "col"]), ["row", "col", "t"], ["y", "level"])


@R.add(
    f"""{SERIES}, v as (select * from ys where y is not null), pr as (select a."row", a.col, sign(b.y - a.y) s, (b.y - a.y) / (b.t - a.t) sl from v a join v b on a."row" = b."row" and a.col = b.col and a.t < b.t),
    pa as (select "row", col, sum(s)::double s, median(sl) slope from pr group by all), ti as (select "row", col, sum(k * (k - 1) * (2 * k + 5))::double ties, sum(k)::bigint n from (select "row", col, y, count(*) k from v group by all) group by all),
    q as (select ti.*, coalesce(s, 0) s, slope, (n * (n - 1) * (2 * n + 5) - ties) / 18e0 var_s from ti left join pa using ("row", col))
    select "row", col, n, s, {rs('var_s')}, round(case when var_s > 0 then (s - sign(s)) / sqrt(var_s) when s = 0 then 0 end, 6) + 0e0 z, {rs('slope')} from q"""
)
def mann_kendall_and_sen(spark, sf_dir):
    return pick(TR.pair_statistics(TR.deseason(series(spark, sf_dir), ["row", "col"]), ["row", "col"]), ["row", "col", "n", "s"], ["var_s", "z", "slope"])


@R.add(
    f"""{SERIES}, v as (select "row", col, t, y, y - avg(y) over (partition by "row", col) d from ys where y is not null), w as (select "row", col, sum(d * d) sq from v group by all)
    select a."row", a.col, (b.t - a.t)::int lag, {r('sum(a.d * b.d) / min(sq)', 'rho')} from v a join v b on a."row" = b."row" and a.col = b.col and b.t - a.t between 1 and 3 join w on w."row" = a."row" and w.col = a.col where sq > 1e-9 group by all"""
)
def autocorrelation(spark, sf_dir):
    rows = TR.deseason(series(spark, sf_dir), ["row", "col"])
    return pick(TR.autocorrelation(rows, ["row", "col"], 3), ["row", "col", "lag"], ["rho"])


@R.add(f"""{SERIES} select "row", col, t, rank() over (partition by "row", col order by x) + (count(*) over (partition by "row", col, x) - 1) / 2e0 rank from ys""")
def mid_ranks(spark, sf_dir):
    return DI.mid_ranks(series(spark, sf_dir), ["row", "col"], "x", "rank").select("row", "col", "t", "rank")


@R.add(
    """with p as (select event_id, event_type, pow(((event_id * 7919) % 100003 + 1) / 100004e0, 3) p from events), i as (select *, row_number() over (partition by event_type order by p) i, count(*) over (partition by event_type) m from p),
    c as (select event_type, max(p) cut from i where p <= 1e-1 * i / m group by event_type) select event_id, coalesce(p <= cut, false) significant from p left join c using (event_type)"""
)
def false_discovery_by_family(spark, sf_dir):
    p = F.pow(((F.col("event_id") * 7919) % 100003 + 1) / 100004.0, F.lit(3.0))
    rows = A.table(spark, sf_dir, "events").select("event_id", "event_type", p.alias("p"))
    return AN.benjamini_hochberg(rows, "p", 0.1, ["event_type"]).select("event_id", "significant")


SHORT = TrendSettings(lengths=MinLengths(mann_kendall=24, autocorrelation=36), min_cells=2)


@R.add()
def trend_map(spark, sf_dir):
    """All corrections; tested against plain loops over the pairs."""
    got = TR.trend_per_cell(series(spark, sf_dir), A.COLS, SHORT)
    return pick(got, ["row", "col", "n_valid", "status", "disagree", "trend_both", "reported"], ["slope", "low", "high", "z_mk", "z_hr", "factor_hr", "z_yue", "r1", "relative_percent"])


@R.add()
def trend_summary(spark, sf_dir):
    return TR.trend_summary(TR.trend_per_cell(series(spark, sf_dir), A.COLS, SHORT))


@R.add(
    f"""{SERIES}, a as (select t, "row", col, x, x - avg(x) over (partition by t) z, count(*) over (partition by t) n from ys where t between 23976 and 23999),
    e as (select a.t, a."row" * {A.COLS} + a.col i, b."row" * {A.COLS} + b.col j, a.z * b.z zz from a join a b on a.t = b.t and abs(a."row" - b."row") <= 1 and (a.col - b.col + {A.COLS}) % {A.COLS} in (0, 1, {A.COLS - 1}) and (a."row" <> b."row" or a.col <> b.col)),
    dg as (select t, i, count(*) d from e group by all), s as (select t, sum(d)::double s0, sum(d * d)::double d2 from dg group by t), c as (select t, sum(zz) cross_ from e group by t), q as (select t, max(n)::double n, sum(z * z) sq from a group by t),
    f as (select t, n::bigint n, s0, n / s0 * cross_ / sq i, -1 / (n - 1) ex, (n * n * 2 * s0 - n * 4 * d2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - 1 / ((n - 1) * (n - 1)) va from q join s using (t) join c using (t) where sq > 0 and n > 2)
    select t, n, s0, {r('i')}, {r('ex', 'expectation')}, {r('va', 'variance')}, {r('(i - ex) / sqrt(va)', 'z')} from f where va > 0"""
)
def morans_i(spark, sf_dir):
    rows = series(spark, sf_dir).where("t between 23976 and 23999")
    return pick(SP.morans_i(rows, A.COLS, ["t"]).where("variance > 0"), ["t", "n", "s0"], ["i", "expectation", "variance", "z"])


@R.add(
    f"""{SERIES}, n as (select distinct "row", col from ys where x > 50 and t = 23990), e as (select a."row" * {A.COLS} + a.col a, b."row" * {A.COLS} + b.col b from n a join n b on abs(a."row" - b."row") <= 1 and (a.col - b.col + {A.COLS}) % {A.COLS} in (0, 1, {A.COLS - 1}) and (a."row", a.col) <> (b."row", b.col)),
    reach(node, far) as (select "row" * {A.COLS} + col, "row" * {A.COLS} + col from n union select node, e.b from reach join e on e.a = reach.far) select (node // {A.COLS})::int "row", (node % {A.COLS})::int col, min(far)::bigint root from reach group by node"""
)
def connected_groups(spark, sf_dir):
    return C.label_components(series(spark, sf_dir).where("x > 50 and t = 23990").select("row", "col"), A.COLS).select("row", "col", "root")


@R.add(
    f"""{SERIES}, rk as (select *, rank() over (partition by "row" order by x) + (count(*) over (partition by "row", x) - 1) / 2e0 rx, rank() over (partition by "row" order by y) + (count(*) over (partition by "row", y) - 1) / 2e0 ry from ys where y is not null)
    select "row", count(*) n, {r('corr(rx, ry)', 'rho')} from rk group by "row" """
)
def rank_correlation(spark, sf_dir):
    rows = TR.deseason(series(spark, sf_dir), ["row", "col"])
    return pick(DI.spearman(rows, ["row"], "x", "y"), ["row", "n"], ["rho"])


@R.add(f"""{SERIES} select t, {r('sum(case when x > 40 and level > 38 then a else 0 end) / sum(case when level > 38 then a end)', 'share')} from (select *, sin(radians(lat + 4)) - sin(radians(lat - 4)) a from ys) group by t having sum(case when level > 38 then 1 end) > 0""")
def area_share_bright(spark, sf_dir):
    from ..functions.grid import area_share

    rows = TR.deseason(series(spark, sf_dir), ["row", "col"])
    return pick(area_share(rows, F.col("x") > 40, F.col("level") > 38, step=8.0, by=("t",)).where("share is not null"), ["t"], ["share"])


@R.add(f"""{A.with_(A.CUBE)} select month, "row", col from cube where {SNOW.replace('observed', '((valid - filled) / 36e2)')}""")
def snow_cells(spark, sf_dir):
    c = A.cube(spark, sf_dir)
    return c.where(snow_suspected(F.col("lat"), F.month("month"), (F.col("valid") - F.col("filled")) / 3600.0)).select("month", "row", "col")
