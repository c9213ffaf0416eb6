"""Cell-by-cell comparison of two sources: criteria, classes, bands, block bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LATITUDE_BANDS, Criteria
from ..functions.grid import cell_of
from ..functions.quality import comparison_class
from .resampling import drawn
from .selection import with_percentiles


def log_value(x: Column, offset: float = 0.1) -> Column:
    return F.log10(F.greatest(x, F.lit(0.0)) + offset)


def log_correlation(ref: Column, cand: Column, where: Column, c: Criteria = Criteria()) -> Column:
    """Aggregate: correlation of the logs where the condition holds; null below three or without spread."""
    x, y = F.when(where, log_value(ref, c.log_offset)), F.when(where, log_value(cand, c.log_offset))
    ok = (F.count_if(where) >= 3) & (F.var_pop(x) > 0) & (F.var_pop(y) > 0)
    return F.when(ok, F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y))))


def both_valid() -> Column:
    return F.col("ref_has") & F.col("cand_has") & F.col("ref").isNotNull() & F.col("cand").isNotNull()


def middles(q: Column) -> dict[str, tuple[Column, float]]:
    """Median ratio and median distance from one."""
    return {"median_q": (q, 0.5), "median_dev": (F.abs(q - 1), 0.5)}


def ratio_measures(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group: cells, median ratio, median deviation from 1, share beyond a factor of two."""
    q = F.col("cand") / F.col("ref")
    whole = rows.groupBy(*by).agg(F.count("*").alias("cells"), F.avg(((q > 2) | (q < 0.5)).cast("int")).alias("factor2"))
    return with_percentiles(whole, rows, by, middles(q))


def class_measures(cells: DataFrame, c: Criteria = Criteria()) -> DataFrame:
    """Per brightness class of the reference; ``cells``: row, col, lat, ref, ref_has, cand, cand_has (region only)."""
    both = cells.where(both_valid()).withColumn("class", comparison_class(F.col("ref"), c))
    lit = F.col("class") != "dark"
    q = F.when(lit, F.try_divide("cand", "ref"))
    whole = both.groupBy("class").agg(
        F.count("*").alias("cells"), log_correlation(F.col("ref"), F.col("cand"), F.lit(True), c).alias("r_log"), F.avg(F.col("cand") - F.col("ref")).alias("mean_difference"),
        F.avg(((q > 2) | (q < 0.5)).cast("int")).alias("factor2"),
        F.avg(F.when(~lit, (F.col("cand") >= c.k4_false_from).cast("int"))).alias("false_light"),
    )
    return with_percentiles(whole, both, ["class"], middles(q))


def verdict(cells: DataFrame, sites: dict[str, tuple[float, float, bool]] | None = None, c: Criteria = Criteria(), step: float = 0.25) -> DataFrame:
    """One row: measures, criteria k1 .. k6 and the verdict.

    ``sites``: name to (lat, lon, is a desert); without sites k6 holds.
    """
    b = both_valid()
    lit = b & (F.col("ref") >= c.dark_to)
    q = F.try_divide("cand", "ref")

    def of(klass: str) -> Column:
        return b & (comparison_class(F.col("ref"), c) == klass)

    aggs = [F.count("*").alias("cells_region"), F.count_if(b).alias("cells_both"), log_correlation(F.col("ref"), F.col("cand"), lit, c).alias("r_log")]
    for k in ("medium", "bright"):
        aggs += [F.median(F.when(of(k), q)).alias(f"{k}_q"), F.median(F.when(of(k), F.abs(q - 1))).alias(f"{k}_dev"), F.avg(F.when(of(k), ((q > 2) | (q < 0.5)).cast("int"))).alias(f"{k}_factor2")]
    aggs += [
        F.avg(F.when(of("dark"), (F.col("cand") >= c.k4_false_from).cast("int"))).alias("false_light"),
        F.avg((F.col("ref_has") == F.col("cand_has")).cast("int")).alias("same_state"),
        F.avg(F.when(F.col("ref_has"), (~F.col("cand_has")).cast("int"))).alias("missing_in_candidate"),
        F.avg(F.when(~F.col("ref_has"), F.col("cand_has").cast("int"))).alias("only_in_candidate"),
    ]
    good = F.lit(True)
    for name, (lat, lon, desert) in (sites or {}).items():
        row, col = cell_of(F.lit(lat), F.lit(lon), step)
        here = (F.col("row") == row) & (F.col("col") == col)
        aggs += [F.max(F.when(here, F.col("ref"))).alias(f"ref_{name}"), F.max(F.when(here, F.col("cand"))).alias(f"cand_{name}")]
        r, d = F.col(f"ref_{name}"), F.col(f"cand_{name}")
        good &= F.coalesce((r < c.k6_desert) & (d < c.k6_desert) if desert else F.try_divide(d, r).between(*c.k6_city), F.lit(False))
    g = cells.agg(*aggs)

    def yes(x: Column) -> Column:
        return F.coalesce(x, F.lit(False))

    both = ("medium", "bright")
    g = g.withColumns(
        {
            "k1": yes(F.col("r_log") >= c.k1_r),
            "k2": yes(F.col("medium_q").between(*c.k2_median) & (F.col("medium_dev") <= c.k2_deviation)) & yes(F.col("bright_q").between(*c.k2_median) & (F.col("bright_dev") <= c.k2_deviation)),
            "k3": yes(F.col(f"{both[0]}_factor2") <= c.k3_factor2) & yes(F.col(f"{both[1]}_factor2") <= c.k3_factor2),
            "k4": yes(F.col("false_light") <= c.k4_share),
            "k5": yes(F.col("same_state") >= c.k5_same) & yes(F.col("missing_in_candidate") <= c.k5_missing),
            "k6": good,
        }
    )
    every = F.col("k1") & F.col("k2") & F.col("k3") & F.col("k4") & F.col("k5") & F.col("k6")
    return g.withColumn("verdict", F.when(every, "met").when(F.col("k1") & F.col("k6"), "partly").otherwise("not met"))


def classes_by_both(cells: DataFrame, c: Criteria = Criteria()) -> DataFrame:
    """Ratio measures in classes of the geometric mean of both sources, which favours neither."""
    g = F.sqrt(F.greatest("ref", F.lit(0.0)) * F.greatest("cand", F.lit(0.0)))
    rows = cells.where(both_valid()).withColumn("class", comparison_class(g, c)).where("class <> 'dark'")
    return ratio_measures(rows, ["class"])


def by_latitude(cells: DataFrame, bands: tuple = LATITUDE_BANDS, c: Criteria = Criteria()) -> DataFrame:
    """Measures per latitude band (lower end included)."""
    spark = cells.sparkSession
    table = spark.createDataFrame([(float(a), float(b)) for a, b in bands], "lat_from double, lat_to double")
    rows = cells.join(F.broadcast(table), (F.col("lat") >= F.col("lat_from")) & (F.col("lat") < F.col("lat_to")))
    b = both_valid()
    lit, q = b & (F.col("ref") >= c.dark_to), F.try_divide("cand", "ref")
    whole = rows.groupBy("lat_from", "lat_to").agg(
        F.count_if(lit).alias("cells"), F.avg(F.when(lit, ((q > 2) | (q < 0.5)).cast("int"))).alias("factor2"),
        F.count_if(b & (F.col("ref") < c.dark_to) & (F.col("cand") >= c.k4_false_from)).alias("false_light"), F.count_if(F.col("ref_has") & ~F.col("cand_has")).alias("only_ref"), F.count_if(F.col("cand_has") & ~F.col("ref_has")).alias("only_cand"),
    )
    return with_percentiles(whole, rows, ["lat_from", "lat_to"], middles(F.when(lit, q)))


def block_bootstrap(cells: DataFrame, replicates: int = 1000, seed: int = 0, per_block: int = 40, c: Criteria = Criteria()) -> DataFrame:
    """(measure, low, high): intervals of the correlation and the class medians, blocks drawn with replacement."""
    block = F.floor(F.col("row") / per_block) * 1000 + F.floor(F.col("col") / per_block)
    rows = cells.where(both_valid() & (F.col("ref") >= c.dark_to)).withColumn("block", block)
    met = rows.join(drawn(rows, "block", replicates, seed), "block").withColumn("one", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))))
    q, bright = F.col("cand") / F.col("ref"), F.col("ref") >= c.medium_to
    each = met.groupBy("replicate").agg(
        log_correlation(F.col("ref"), F.col("cand"), F.lit(True), c).alias("r_log"), F.median(F.when(bright, q)).alias("bright_q"), F.median(F.when(~bright, q)).alias("medium_q"), F.median(F.when(bright, F.abs(q - 1))).alias("bright_dev"), F.median(F.when(~bright, F.abs(q - 1))).alias("medium_dev"),
    )
    names = ["r_log", "bright_q", "medium_q", "bright_dev", "medium_dev"]
    long = each.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("v")) for n in names])).alias("m")).select("m.*")
    return long.groupBy("measure").agg(F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high"))
