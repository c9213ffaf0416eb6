"""Which tiles make up a region, and which are absent from a catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AbsenceRules
from ..functions.grid import CELLS_PER_TILE, tile_name, tile_position

TILE, OUTSIDE, MIXED, LOOSE = "tile", "outside reference", "mixed", "unit without region"
ABSENT_SCHEMA = "month date, tile string"


def region_parts(bridge: DataFrame, units: DataFrame, regions: tuple[str, ...], reference: DataFrame, per_tile: int = CELLS_PER_TILE) -> DataFrame:
    """(kind, name) of a region made of M49 regions: its tiles, and what is peculiar about them.

    ``bridge``: row, col, unit_id, share; ``units``: unit_id, name, m49_region;
    ``reference``: the tiles that the provider has. Kinds:

    * ``tile``: in the reference, with a cell of which a unit of the region has a share above zero;
    * ``outside reference``: such a tile that the reference lacks;
    * ``mixed``: a ``tile`` with cells of other regions' units too;
    * ``unit without region``: a unit with no M49 region (null or empty) that has a cell in a tile
      without any cell of the region.

    Shares of zero, below zero and null are no land. A bridge row whose unit is unknown is an
    error when the result is read. Repeated rows change nothing; an empty bridge gives no rows.
    The bridge is reduced to distinct (tile, unit) before it is shuffled any further.
    """
    pairs = bridge.where("share > 0").select(tile_name(F.col("row"), F.col("col"), per_tile).alias("tile"), "unit_id").distinct()
    known = units.select("unit_id", F.col("name").alias("unit"), F.nullif("m49_region", F.lit("")).alias("region"), F.lit(True).alias("known"))
    found = pairs.join(known, "unit_id", "left")
    unknown = F.raise_error(F.format_string("the bridge names unit %s, which the table of units lacks", F.col("unit_id").cast("string"))).cast("boolean")
    found = found.where(F.when(F.col("known").isNull(), unknown).otherwise(True))
    wanted = F.col("region").isin(*regions)
    tiles = found.groupBy("tile").agg(
        F.coalesce(F.bool_or(wanted), F.lit(False)).alias("inside"), F.coalesce(F.bool_or(~wanted), F.lit(False)).alias("other"),
        F.collect_set(F.when(F.col("region").isNull(), F.col("unit"))).alias("loose"),
    )
    listed = reference.select("tile", F.lit(True).alias("listed")).distinct()
    marked = tiles.join(listed, "tile", "left").withColumn("listed", F.col("listed").isNotNull())

    def row(kind: str, when):
        return F.when(F.col("inside") & when, F.struct(F.lit(kind).alias("kind"), F.col("tile").alias("name")))

    own = F.array_compact(F.array(row(TILE, F.col("listed")), row(OUTSIDE, ~F.col("listed")), row(MIXED, F.col("listed") & F.col("other"))))
    loose = F.transform("loose", lambda u: F.struct(F.lit(LOOSE).alias("kind"), u.alias("name")))
    return marked.select(F.inline(F.when(F.col("inside"), own).otherwise(loose))).distinct()


def region_list(parts: DataFrame, label: str, rule: str, sources: dict[str, str] | None = None) -> DataFrame:
    """(n, value): the lines of a region's list, the header with its origin first, then its tiles by name.

    Lists are as long as the grid has tiles at most, so one row holds them. A kind without a member
    reads 'none'. ``sources``: name and checksum or date of what the list was derived from.
    """

    def names(kind: str):
        return F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("name"))))

    def said(text: str, column: str):
        joined = F.array_join(column, ", ")
        return F.concat(F.lit(f"# {text}: "), F.when(joined == "", F.lit("none")).otherwise(joined))

    one = parts.agg(names(TILE).alias("tiles"), names(OUTSIDE).alias("outside"), names(MIXED).alias("mixed"), names(LOOSE).alias("loose"))
    fixed = [f"# region: {label}", f"# rule: {rule}"] + [f"# source {name}: {value}" for name, value in sorted((sources or {}).items())]
    head = [F.lit(line) for line in fixed] + [F.concat(F.lit("# tiles: "), F.size("tiles"))]
    head += [said("not in the reference list", "outside"), said("with cells of other regions", "mixed"), said("units without a region elsewhere", "loose")]
    return one.select(F.posexplode(F.concat(F.array(*head), F.col("tiles"))).alias("n", "value"))


def write_region_list(lines: DataFrame, path: str) -> None:
    """Write the lines as one text file, in their order."""
    lines.repartition(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)


def absent_tiles(reference: DataFrame, catalogue: DataFrame, first: str, last: str) -> DataFrame:
    """(month, tile) of reference tiles that the catalogue (month, tile) lacks in months 'YYYY-MM' from first to last.

    Months are first days. A month without any catalogue row lacks every tile. Rows of the
    catalogue outside the reference or the span are passed over.
    """
    span = F.sequence(F.to_date(F.lit(first + "-01")), F.to_date(F.lit(last + "-01")), F.expr("interval 1 month"))
    wanted = reference.select("tile").where("tile is not null").distinct().select(F.explode(span).alias("month"), "tile")
    return wanted.join(catalogue.select("month", "tile").distinct(), ["month", "tile"], "left_anti")


def absence_findings(absent: DataFrame, r: AbsenceRules = AbsenceRules()) -> DataFrame:
    """Per month with absent tiles: n_absent, the first tiles by name, reasons why that is no known pattern ('' if it is).

    Known are a few tiles in northern rows in bright months. Months hold as many tiles as the grid at most.
    """
    _, v = tile_position(F.col("tile"))
    south = F.when(v.isNull() | ~v.isin(*r.rows), F.col("tile"))
    g = absent.select("month", "tile").distinct().groupBy("month").agg(F.count("*").alias("n_absent"), F.array_sort(F.collect_set("tile")).alias("tiles"), F.array_sort(F.collect_set(south)).alias("south"))

    def some(column: str):
        return F.array_join(F.slice(column, 1, r.shown), ", ")

    reasons = F.array_compact(
        F.array(
            F.when(F.col("n_absent") > r.most, F.concat(F.col("n_absent").cast("string"), F.lit(f" tiles (at most {r.most})"))),
            F.when(~F.month("month").isin(*r.months), F.lit(f"outside months {min(r.months)} to {max(r.months)}")),
            F.when(F.size("south") > 0, F.concat(F.lit("south of the known rows: "), some("south"))),
        )
    )
    return g.select("month", "n_absent", some("tiles").alias("first_tiles"), F.array_join(reasons, "; ").alias("reasons"))


class UnexpectedAbsence(RuntimeError):
    """Absent tiles that fit no known pattern; the catalogue's answer has gaps."""


def check_absence(findings: DataFrame) -> None:
    """Error that names the first months whose absent tiles fit no known pattern."""
    bad = findings.where("reasons <> ''").orderBy("month").limit(3).collect()
    if bad:
        raise UnexpectedAbsence("; ".join(f"{b['month']:%Y-%m}: {b['n_absent']} tiles, e.g. {b['first_tiles']} ({b['reasons']})" for b in bad))
