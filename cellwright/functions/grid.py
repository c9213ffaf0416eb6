"""Regular latitude-longitude grids: row 0 is the northernmost, column 0 the westernmost."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EARTH_KM = 6371.0
CELLS_PER_TILE = 40


def cell_lat(row: Column, step: float = 0.25) -> Column:
    return 90.0 - step / 2 - row * step


def cell_lon(col: Column, step: float = 0.25) -> Column:
    return -180.0 + step / 2 + col * step


def grid(spark: SparkSession, rows: int = 720, cols: int = 1440, step: float = 0.25) -> DataFrame:
    """All cells with their centres."""
    cells = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    return cells.withColumns({"lat": cell_lat(F.col("row"), step), "lon": cell_lon(F.col("col"), step)})


def cell_of(lat: Column, lon: Column, step: float = 0.25) -> tuple[Column, Column]:
    """Row and column of the cell that holds a point."""
    return F.floor((90 - lat) / step).cast("int"), F.floor((lon + 180) / step).cast("int")


def cell_key(row: Column, col: Column, cols: int = 1440) -> Column:
    """Unique cell number, wide enough for any grid."""
    return row.cast("long") * cols + col


def tile_name(row: Column, col: Column, per_tile: int = CELLS_PER_TILE) -> Column:
    return F.format_string("h%02dv%02d", F.floor(col / per_tile).cast("int"), F.floor(row / per_tile).cast("int"))


def tile_number(row: Column, col: Column, per_tile: int = CELLS_PER_TILE) -> Column:
    return (F.floor(row / per_tile) * 100 + F.floor(col / per_tile)).cast("int")


def tile_position(name: Column) -> tuple[Column, Column]:
    """(h, v) of a tile name or a file name that holds one."""
    return F.regexp_extract(name, r"h(\d{2})v(\d{2})", 1).cast("int"), F.regexp_extract(name, r"h(\d{2})v(\d{2})", 2).cast("int")


def cell_area_km2(lat: Column, step: float = 0.25) -> Column:
    """Area of a cell on the sphere, clipped at the poles."""
    top = F.least(F.radians(lat + step / 2), F.lit(pi / 2))
    bottom = F.greatest(F.radians(lat - step / 2), F.lit(-pi / 2))
    return EARTH_KM**2 * (step * pi / 180) * (F.sin(top) - F.sin(bottom))


def area_share(df: DataFrame, mask: Column, reference: Column, lat: str = "lat", step: float = 0.25, by: tuple = ()) -> DataFrame:
    """Area-weighted share of a mask among the reference cells; null without any."""
    w = cell_area_km2(F.col(lat), step)
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.when(mask & reference, w).otherwise(0.0)), F.sum(F.when(reference, w))).alias("share"))


def ellipsoid_row_area_km2(lat: Column, step: float = 0.25) -> Column:
    """Area of a cell on the WGS84 ellipsoid by the authalic closed form."""
    a, e2 = 6378.137, 0.00669437999014
    e = e2**0.5

    def q(phi: Column) -> Column:
        s = F.sin(phi)
        return (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))

    top = F.least(F.radians(lat + step / 2), F.lit(pi / 2))
    bottom = F.greatest(F.radians(lat - step / 2), F.lit(-pi / 2))
    return a * a / 2 * (step * pi / 180) * (q(top) - q(bottom))
