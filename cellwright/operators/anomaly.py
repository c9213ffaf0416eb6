"""Seasonal-baseline anomalies: robust score, false-discovery control, duration, events.

A month is compared with earlier years of the same calendar month only. The
baseline of all months comes from one ordered window per cell and calendar
month; nothing is looped over months.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FINISHED, Thresholds
from ..functions.grid import cell_area_km2
from ..functions.months import month_index, month_text
from ..functions.quality import band, observed_share, snow_suspected
from ..functions.scalars import median_of, two_sided_normal
from ..sources.cube import check_hold_out
from .components import label_components, number_groups, written
from .selection import with_percentiles

METHOD = "robust z against earlier years of the same calendar month, Benjamini-Hochberg on nominal p"
VERSION = "1.0"


def baseline(rows: DataFrame, s: Thresholds, mean: str = "mean_obs", valid: str = "valid", filled: str = "filled") -> DataFrame:
    """Add observed, snow, usable, base_values, n_base, med, mad_spread, base_mean, base_sd."""
    year, month = F.year("month"), F.month("month")
    rows = rows.withColumn("observed", observed_share(F.col(valid), F.col(filled), s.pixels_per_cell))
    enough = (F.col("observed") >= s.min_observed) & F.col(mean).isNotNull()
    # snow is judged by the share of cells that have pixels at all
    share = F.when(F.col(valid) > 0, F.col("observed"))
    rows = rows.withColumn("snow", snow_suspected(F.col("lat"), month, share, s.snow) & enough)
    rows = rows.withColumn("usable", enough & ~F.col("snow")).withColumn("base_value", F.when(F.col("usable"), F.col(mean).cast("double")))
    earlier = Window.partitionBy("row", "col", month).orderBy(year).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "base_values": F.collect_list("base_value").over(earlier),
            "base_mean": F.avg("base_value").over(earlier),
            "base_sd": F.stddev_samp("base_value").over(earlier),
        }
    ).drop("base_value")
    rows = rows.withColumn("n_base", F.size("base_values")).withColumn("med", median_of(F.col("base_values")))
    return rows.withColumn("mad_spread", s.mad_factor * median_of(F.transform("base_values", lambda v: F.abs(v - F.col("med")))))


def pooled_spread(rows: DataFrame, s: Thresholds) -> DataFrame:
    """(month, n_base, rho): relative spread of the bright cells, by number of base years.

    Groups of too few cells take that of the whole month, which is null if the
    month has too few itself.
    """
    relative = F.col("mad_spread") / F.greatest(F.abs("med"), F.lit(s.pool_brightness))
    bright = (F.col("n_base") >= s.min_base_years) & (F.col("med") >= s.pool_brightness)
    pool = rows.where(F.col("n_base") >= s.min_base_years).select("month", "n_base", F.when(bright, relative).alias("rel"))
    p = s.pool_percentile / 100
    # both groupings from one table of the cells; rows of whole months have no n_base
    both = written(pool.select("month", F.explode(F.array(F.col("n_base"), F.lit(None).cast("int"))).alias("n_base"), "rel"))
    both = with_percentiles(both.groupBy("month", "n_base").agg(F.count("rel").alias("n")), both, ["month", "n_base"], {"value": (F.col("rel"), p)})
    enough = F.when(F.col("n") >= s.pool_min_cells, F.col("value"))
    both = both.withColumn("general", F.max(F.when(F.col("n_base").isNull(), enough)).over(Window.partitionBy("month")))
    return both.where("n_base is not null").select("month", "n_base", F.col("n").alias("pool_cells"), F.when(F.col("n") >= s.pool_min_cells, F.col("value")).otherwise(F.col("general")).alias("rho"))


def score_cells(cube: DataFrame, states: DataFrame, s: Thresholds = Thresholds(), mean: str = "mean_obs", valid: str = "valid", filled: str = "filled") -> DataFrame:
    """All finished cell-months with their scores; unscored ones keep null scores."""
    ready = states.where(F.col("state") == FINISHED).select("month")
    rows = baseline(cube.join(ready, "month", "left_semi"), s, mean, valid, filled)
    rows = rows.join(pooled_spread(rows, s), ["month", "n_base"], "left")
    x = F.col(mean).cast("double")
    scored = F.col("usable") & (F.col("n_base") >= s.min_base_years) & F.col("rho").isNotNull() & F.col("med").isNotNull()
    n = F.greatest(F.col("n_base"), F.lit(1))

    def spread(width: str, centre: str) -> Column:
        level = F.greatest(F.abs(F.coalesce(centre, F.lit(0.0))), F.lit(s.pool_brightness))
        return F.greatest(F.coalesce(width, F.lit(0.0)), F.col("rho") * level, F.lit(s.min_spread))

    z = (x - F.col("med")) / (spread("mad_spread", "med") * F.sqrt(1 + (pi / 2) / n))
    z_classic = (x - F.col("base_mean")) / (spread("base_sd", "base_mean") * F.sqrt(1 + 1 / n))
    rows = rows.withColumn("scored", F.coalesce(scored, F.lit(False)))
    rows = rows.withColumns({"z": F.when(F.col("scored"), z), "z_classic": F.when(F.col("scored"), z_classic)})
    share, years = F.col("observed"), F.col("n_base")
    quality = (
        F.when(~F.col("scored"), 0)
        .when((share >= s.good_observed) & (years >= s.good_base_years), 3)
        .when((share >= s.medium_observed) & (years >= s.medium_base_years), 2)
        .otherwise(1)
    )
    return rows.withColumns(
        {
            "disagree": F.coalesce((F.abs("z") >= s.z_min) != (F.abs("z_classic") >= s.z_min), F.lit(False)),
            "quality": quality,
            "filled_share": F.when(F.col(valid) > 0, F.col(filled) / F.col(valid)),
            "relative_change": F.when(F.col("med") >= s.pool_brightness, (x - F.col("med")) / F.col("med")),
            "bright": F.coalesce(F.col("scored") & (F.col("med") >= s.pool_brightness), F.lit(False)),
        }
    ).drop("base_values")


def benjamini_hochberg(df: DataFrame, p: str, q: float, family: list[str], out: str = "significant") -> DataFrame:
    """Mark p-values up to the step-up cut-off of their family; null p is not tested.

    Ranks come from bucket counts and a rank within the bucket, so no task
    holds a whole family.
    """
    bucket = F.least(F.lit(4095), F.floor(-F.log2(F.greatest(F.col(p), F.lit(1e-300))) * 4)).cast("int")
    tested = df.where(F.col(p).isNotNull()).select(*family, F.col(p).alias("__p"), bucket.alias("__b"))
    counts = tested.groupBy(*family, "__b").agg(F.count("*").alias("__n"))
    # buckets count down as p grows
    down = Window.partitionBy(*family).orderBy(F.desc("__b")) if family else Window.orderBy(F.desc("__b"))
    all_ = Window.partitionBy(*family) if family else Window.partitionBy()
    counts = counts.withColumn("__upto", F.sum("__n").over(down)).withColumn("__m", F.sum("__n").over(all_))
    # only buckets whose last rank could pass hold the cut-off
    low = F.pow(F.lit(2.0), -(F.col("__b") + 1) / 4.0)
    open_ = counts.where((low <= q * F.col("__upto") / F.col("__m")) | (F.col("__b") >= 4095))
    inside = Window.partitionBy(*family, "__b").orderBy("__p")
    ranked = tested.join(open_, [*family, "__b"]).withColumn("__i", F.col("__upto") - F.col("__n") + F.row_number().over(inside))
    passed = ranked.where(F.col("__p") <= q * F.col("__i") / F.col("__m"))
    if family:
        cut = passed.groupBy(*family).agg(F.max("__p").alias("__cut"))
        marked = df.join(cut, family, "left")
    else:
        marked = df.crossJoin(F.broadcast(passed.agg(F.max("__p").alias("__cut"))))
    return marked.withColumn(out, F.coalesce(F.col(p) <= F.col("__cut"), F.lit(False))).drop("__cut")


def mark_cells(scored: DataFrame, s: Thresholds = Thresholds(), p: str | None = None) -> DataFrame:
    """Add p, bh, marked, sign, run (months in a row) and effective (marked for long enough)."""
    if p is None:
        scored, p = scored.withColumn("p", two_sided_normal(F.col("z"))), "p"
    # written once: the ranks of the p-values read the scored cells three times
    rows = benjamini_hochberg(written(scored), p, s.q, ["month"], "bh")
    rows = rows.withColumn("marked", F.coalesce(F.col("bh") & (F.abs("z") >= s.z_min), F.lit(False)))
    rows = rows.withColumn("sign", F.when(F.col("marked"), F.signum("z").cast("int")).otherwise(0)).withColumn("t", month_index(F.col("month")))
    # a month that is missing, unscored or unmarked leaves a gap in t and so ends the run
    marked = Window.partitionBy("row", "col", "sign").orderBy("t")
    runs = rows.withColumn("island", F.col("t") - F.row_number().over(marked))
    run = F.row_number().over(Window.partitionBy("row", "col", "sign", "island").orderBy("t"))
    rows = runs.withColumn("run", F.when(F.col("marked"), run).otherwise(0)).drop("island")
    return rows.withColumn("effective", F.col("marked") & (F.col("run") >= s.min_months))


def event_cells(marked: DataFrame, cols: int, s: Thresholds = Thresholds()) -> DataFrame:
    """Effective cells with the number of their event in the month; rises are numbered before declines."""
    labelled = label_components(marked.where("effective"), cols, ["month", "sign"])
    sized = number_groups(labelled, ["month", "sign"], s.min_cells).where("number > 0").drop("number")
    events = sized.groupBy("month", "sign", "root").agg(F.lit(1).alias("one"))
    nr = F.row_number().over(Window.partitionBy("month").orderBy(F.desc("sign"), "root"))
    return sized.join(events.select("month", "sign", "root", nr.alias("nr")), ["month", "sign", "root"]).withColumn("band", band(F.col("z"), s))


def events(cells: DataFrame, s: Thresholds = Thresholds(), field: str = "light", step: float | None = None) -> DataFrame:
    """One row per event, with extent, severity, data quality and stated uncertainty."""
    step = step or s.cell_degrees
    lon = F.radians("lon")
    centred = F.pmod(F.col("lon") - F.col("lon_mid") + 180, F.lit(360.0)) - 180
    key = ["month", "nr"]
    mid = cells.groupBy(*key).agg(F.degrees(F.atan2(F.avg(F.sin(lon)), F.avg(F.cos(lon)))).alias("lon_mid"))
    rows = cells.join(mid, key).withColumn("off", centred)

    def wrapped(x: Column) -> Column:
        return F.pmod(F.col("lon_mid") + x + 180, F.lit(360.0)) - 180

    agg = rows.groupBy(*key, "lon_mid").agg(
        F.first("sign").alias("sign"), F.count("*").alias("n_cells"), F.sum(cell_area_km2(F.col("lat"), step)).alias("area_km2"),
        F.avg("lat").alias("lat_mid"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("off").alias("off_min"), F.max("off").alias("off_max"),
        F.max_by("z", F.struct(F.abs("z"), -F.col("row"), -F.col("col"))).alias("z_max"),
        F.min("quality").alias("quality"), F.avg("filled_share").alias("filled_share"),
        F.min("n_base").alias("n_base_min"), F.avg(F.col("disagree").cast("int")).alias("disagree_share"), F.avg(F.col("snow").cast("int")).alias("snow_share"),
    )
    middles = {"z_median": (F.col("z"), 0.5), "z_abs": (F.abs("z"), 0.5), "relative_change": (F.col("relative_change"), 0.5)}
    agg = with_percentiles(agg, rows, key, middles)
    names = {"quality": ["insufficient", "thin", "medium", "good"], "band": ["none", "noticeable", "strong", "extreme"]}
    text = F.concat_ws("; ", F.lit("p-values nominal"), F.when(F.col("disagree_share") > 0, F.format_string("classic and robust z disagree in %.0f%% of cells", F.col("disagree_share") * 100)), F.when(F.col("snow_share") > 0, F.format_string("snow suspected in %.0f%% of cells", F.col("snow_share") * 100)))
    return agg.select(
        F.concat_ws("-", F.lit(field), month_text(F.col("month")), F.lpad(F.col("nr").cast("string"), 3, "0")).alias("id"), "nr", F.lit(field).alias("field"), "month",
        F.when(F.col("sign") > 0, "rise").otherwise("decline").alias("direction"), F.array(*map(F.lit, names["band"]))[band(F.col("z_abs"), s)].alias("band"),
        "n_cells", "area_km2", "lat_mid", "lon_mid", "lat_min", "lat_max", wrapped(F.col("off_min")).alias("lon_min"), wrapped(F.col("off_max")).alias("lon_max"),
        "z_median", "z_max", "relative_change", F.array(*map(F.lit, names["quality"]))[F.col("quality")].alias("quality"), "filled_share", "n_base_min",
        "disagree_share", "snow_share", text.alias("uncertainty"), F.lit(METHOD).alias("method"), F.lit("observed").alias("evidence"), F.lit(VERSION).alias("version"),
    )


def month_diagnosis(marked: DataFrame, s: Thresholds = Thresholds()) -> DataFrame:
    """Per month over bright cells: median z and marked share; suspicious if the whole month seems shifted."""
    rows = marked.where("bright").select("month", "z", "marked")
    bright = rows.groupBy("month").agg(F.count("*").alias("n_bright"), F.avg(F.col("marked").cast("int")).alias("marked_share"))
    bright = with_percentiles(bright, rows, ["month"], {"median_z": (F.col("z"), 0.5)})
    return bright.withColumn("suspicious", (F.abs("median_z") > s.diagnosis_median_z) | (F.col("marked_share") > s.diagnosis_marked))


def month_results(cube_states: DataFrame, marked: DataFrame, s: Thresholds = Thresholds()) -> DataFrame:
    """One row per month of the axis: scored, cannot be scored or not loaded, with the reason and counts."""
    t = month_index(F.col("month"))
    years = Window.partitionBy(F.month("month")).orderBy(F.year("month")).rowsBetween(Window.unboundedPreceding, -1)
    axis = cube_states.withColumn("base_months", F.coalesce(F.sum((F.col("state") == FINISHED).cast("int")).over(years), F.lit(0)))
    axis = axis.withColumn("missing_base_months", F.coalesce(F.sum((F.col("state") != FINISHED).cast("int")).over(years), F.lit(0)))
    got = marked.groupBy("month").agg(F.count_if("scored").alias("n_tested"), F.count_if("bh").alias("n_bh"), F.count_if("marked").alias("n_marked"))
    status = F.when(F.col("state") != FINISHED, "not loaded").when(F.col("base_months") < s.min_base_years, "cannot be scored").otherwise("scored")
    reason = F.when(F.col("state") != FINISHED, F.concat(F.lit("state "), F.col("state"))).when(F.col("base_months") < s.min_base_years, F.format_string("%d finished earlier years, %d needed", F.col("base_months"), F.lit(s.min_base_years))).otherwise("")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_tested", "n_bh", "n_marked")]
    return axis.join(got, "month", "left").select("month", t.alias("t"), status.alias("status"), reason.alias("reason"), F.col("base_months").cast("long").alias("base_months"), F.col("missing_base_months").cast("long").alias("missing_base_months"), *zero)


def detect(cube: DataFrame, states: DataFrame, cols: int, s: Thresholds = Thresholds(), first: tuple | None = None, last: tuple | None = None, released: bool = False, **columns) -> dict[str, DataFrame]:
    """Cells, events, diagnosis and months of a range; the hold-out check precedes any read of values."""
    t = month_index(F.col("month"))
    span = states
    if first:
        span = span.where(t >= first[0] * 12 + first[1] - 1)
    if last:
        span = span.where(t <= last[0] * 12 + last[1] - 1)
    asked = [(r[0] // 12, r[0] % 12 + 1) for r in span.select(t).collect()]  # one row per month of the axis
    check_hold_out(asked, released)
    scored = score_cells(cube, states, s, **columns).join(span.select("month"), "month", "left_semi")
    marked = mark_cells(scored, s)
    numbered = event_cells(marked, cols, s)
    return {"cells": marked, "events": events(numbered, s), "diagnosis": month_diagnosis(marked, s), "months": month_results(states, marked, s).join(span.select("month"), "month", "left_semi")}
