"""Cross-section of countries: selection with all reasons, log-log regression, bootstrap, variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CrossSectionRules
from .components import written
from .resampling import drawn, drawn_by


def _pct(c: str) -> Column:
    return F.format_string("%.0f%%", F.col(c) * 100)


def select_countries(light: DataFrame, reference: DataFrame, r: CrossSectionRules = CrossSectionRules(), territory: DataFrame | None = None, purity_limit: float | None = None, region: DataFrame | None = None, regions: tuple = ()) -> DataFrame:
    """Every country of either table with all reasons against it and all remarks.

    ``light``: rows of one year of ``country_year``; ``reference``: country,
    gdp; ``territory``: country, territory ('deviating', 'unclear', ...);
    ``region``: country, region, of which only ``regions`` are wanted.
    """
    limit = r.purity_limit if purity_limit is None else purity_limit
    light = light.withColumn("present", F.lit(True))
    t = light.join(reference, "country", "full")
    t = t.join(territory, "country", "left") if territory is not None else t.withColumn("territory", F.lit(None).cast("string"))
    t = t.join(region, "country", "left") if region is not None else t.withColumn("region", F.lit(None).cast("string"))
    here, lit = F.coalesce("present", F.lit(False)), F.coalesce(F.col("light_sum") > 0, F.lit(False))
    outside = ~F.coalesce(F.col("region").isin(*regions), F.lit(False)) if region is not None else F.lit(False)
    reasons = F.array(
        F.when(F.col("gdp").isNull(), "no reference value for this year"),
        F.when(~here, "no cell in the bridge"),
        F.when(here & (F.col("area_not_loaded") > 0), "not completely loaded").when(here & outside, "outside the wanted regions"),
        F.when(here & (F.col("territory") == "deviating"), "territory of the reference deviates"),
        F.when(here & ~lit, "light sum is 0 or cannot be determined"),
        F.when(here & lit & ~F.coalesce(F.col("light_coverage") >= r.min_light_coverage, F.lit(False)), F.concat(F.lit("light coverage "), _pct("light_coverage"))),
        F.when(here & lit & ~F.coalesce(F.col("light_purity") >= limit, F.lit(False)), F.concat(F.lit("purity "), _pct("light_purity"))),
    )
    few = here & lit & (F.col("share_few_months") > r.few_months_share)
    remarks = F.array(
        F.when(few, F.concat(_pct("share_few_months"), F.lit(" of the light from cells with few good months"))),
        F.when(here & lit & (F.col("share_north") > 0), F.concat(_pct("share_north"), F.lit(" of the light in the far north"))),
        F.when(here & (F.col("territory") == "unclear"), "territory of the reference unclear"),
        F.when(here & (F.col("share_unmeasured") > 0.01), F.concat(_pct("share_unmeasured"), F.lit(" of the area without any measurement"))),
    )
    t = t.withColumns({"reasons": F.array_compact(reasons), "remarks": F.array_compact(remarks), "few_months": F.coalesce(few, F.lit(False))})
    t = t.withColumn("included", F.size("reasons") == 0)
    return t.select("country", "gdp", "light_sum", "light_pure", "light_coverage", "light_purity", "share_few_months", "share_north", F.coalesce("territory", F.lit("not stated")).alias("territory"), "few_months", "included", "reasons", "remarks")


def least_squares(points: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Per group: n, slope, intercept and r2 of y on x; null below three points or without spread in x."""
    g = points.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(F.col(x) * F.col(x)).alias("xx"), F.avg(F.col(x) * F.col(y)).alias("xy"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("cxy"))
    ok = (F.col("n") >= 3) & (F.col("vx") > 0)
    slope = F.when(ok, F.try_divide("cxy", "vx"))
    return g.select(*by, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), F.when(ok & (F.col("vy") > 0), F.col("cxy") * F.col("cxy") / (F.col("vx") * F.col("vy"))).alias("r2"))


def regression(points: DataFrame, key: str, r: CrossSectionRules = CrossSectionRules(), x: str = "x", y: str = "y", by: tuple = ()) -> DataFrame:
    """Least squares of all points, and the pairs-bootstrap interval of the slope; null below three points.

    One row, or one a group of ``by``; groups are worked out together and each as if it were alone.
    """
    whole = least_squares(points, list(by), x, y)
    draws = drawn_by(points, list(by), key, r.bootstrap, r.seed) if by else drawn(points, key, r.bootstrap, r.seed)
    again = points.join(draws, [*by, key])
    again = again.withColumn("one", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))))
    boot = least_squares(again, [*by, "replicate"], x, y)
    band = boot.groupBy(*by).agg(F.percentile("slope", 0.025).alias("low"), F.percentile("slope", 0.975).alias("high"))
    enough = F.col("n") >= 3
    both = whole.join(band, list(by), "left") if by else whole.crossJoin(band)
    return both.withColumns({c: F.when(enough, F.col(c)) for c in ("low", "high")})


def variant_points(light: DataFrame, reference: DataFrame, r: CrossSectionRules = CrossSectionRules(), **options) -> tuple[list[str], DataFrame]:
    """Names of the main regression and its counter-checks, and (country, x, variant, y): a country's point in each that it is in.

    Countries are selected once, without a limit of purity.
    """
    rows = select_countries(light, reference, r, purity_limit=float("-inf"), **options).where("included")

    def pure(limit: float) -> Column:
        return F.col("light_purity") >= limit

    main = pure(r.purity_limit)
    sets = {"main": (main, "light_sum"), "pure_cells_only": (main, "light_pure")}
    sets |= {f"purity_{int(limit * 100)}": (pure(limit), "light_sum") for limit in r.purity_variants}
    sets |= {"without_few_months": (main & ~F.col("few_months"), "light_sum"), "without_unclear_territory": (main & (F.col("territory") != "unclear"), "light_sum")}
    member = F.array_compact(F.array(*[F.when(wanted & (F.col(value) > 0), F.struct(F.lit(name).alias("variant"), F.log(value).alias("y"))) for name, (wanted, value) in sets.items()]))
    return list(sets), rows.select("country", F.log("gdp").alias("x"), F.inline(member))


def variants(light: DataFrame, reference: DataFrame, r: CrossSectionRules = CrossSectionRules(), **options) -> DataFrame:
    """The main regression and its counter-checks, one row each, in one grouped regression."""
    names, points = variant_points(light, reference, r, **options)
    got = regression(written(points), "country", r, by=("variant",))  # read by the line and by the draws
    names = light.sparkSession.createDataFrame([(name,) for name in names], "variant string")
    return names.join(got, "variant", "left").select("variant", F.coalesce("n", F.lit(0)).alias("n"), "slope", "intercept", "r2", "low", "high")


def residuals(points: DataFrame, k: int = 10, key: str = "country", x: str = "x", y: str = "y") -> DataFrame:
    """The k points farthest from the line."""
    line = least_squares(points, [], x, y)
    rest = F.col(y) - (F.col("intercept") + F.col("slope") * F.col(x))
    return points.crossJoin(F.broadcast(line)).select(key, rest.alias("residual")).orderBy(F.desc(F.abs("residual")), key).limit(k)
