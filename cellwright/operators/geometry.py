"""Geometry on WKB columns; needs shapely and pyproj, which are looked for only when used.

Cells are reached by an equi-join on blocks: a shape is exploded to the 5-degree
blocks its box covers, and only cells of those blocks are clipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DENSIFY = 0.05
PROJECTION = "EPSG:6933"


def _shapely():
    try:
        import shapely
        import shapely.ops
    except ModuleNotFoundError as e:
        raise RuntimeError("geometry operators need shapely and pyproj on driver and executors") from e
    return shapely


def project(wkb: bytes) -> bytes:
    """Densify edges, project to equal area."""
    import pyproj

    shapely = _shapely()
    to = pyproj.Transformer.from_crs("EPSG:4326", PROJECTION, always_xy=True).transform
    return shapely.to_wkb(shapely.ops.transform(to, shapely.segmentize(shapely.from_wkb(wkb), DENSIFY)))


def polygon_parts(shape):
    """The polygonal parts of a repaired shape."""
    shapely = _shapely()
    parts = [g for g in getattr(shape, "geoms", [shape]) if g.geom_type in ("Polygon", "MultiPolygon")]
    return shapely.union_all(parts)


def repaired(wkb: bytes, tolerance: float = 1e-9) -> bytes:
    """Valid shape of the same area; a change beyond the tolerance is an error."""
    shapely = _shapely()
    shape = shapely.from_wkb(wkb)
    if shape.is_valid:
        return wkb
    fixed = polygon_parts(shapely.make_valid(shape))
    if abs(fixed.area - abs(shape.area)) > tolerance * max(1.0, abs(shape.area)):
        raise ValueError("repair changes the area")
    return shapely.to_wkb(fixed)


def geodesic_area_km2(wkb: bytes) -> float:
    import pyproj

    area, _ = pyproj.Geod(ellps="WGS84").geometry_area_perimeter(_shapely().from_wkb(wkb))
    return abs(area) / 1e6


def map_shapes(df: DataFrame, function, source: str, out: str, kind: str = "binary") -> DataFrame:
    """Apply one of the functions above to a WKB column, in Arrow batches."""

    @F.pandas_udf(kind)
    def applied(col: pd.Series) -> pd.Series:
        return col.map(lambda w: None if w is None else function(bytes(w)))

    return df.withColumn(out, applied(F.col(source)))


def cell_shares(shapes: DataFrame, key: str, wkb: str = "wkb", step: float = 0.25) -> DataFrame:
    """(key, row, col, area_km2, share) of every cell that a shape touches, on the equal-area projection."""
    kind = dict(shapes.dtypes)[key]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapely = _shapely()
        for pdf in batches:
            for k, w in zip(pdf[key], pdf[wkb]):
                shape, out = shapely.from_wkb(bytes(w)), []
                west, south, east, north = shape.bounds
                shapely.prepare(shape)
                for row in range(max(0, int((90 - north) / step)), min(int(180 / step), int((90 - south) / step) + 1)):
                    for col in range(max(0, int((west + 180) / step)), min(int(360 / step), int((east + 180) / step) + 1)):
                        cell = shapely.box(-180 + col * step, 90 - (row + 1) * step, -180 + (col + 1) * step, 90 - row * step)
                        if shape.intersects(cell):
                            part = shapely.from_wkb(project(shapely.to_wkb(shapely.intersection(shape, cell)))).area / 1e6
                            whole = shapely.from_wkb(project(shapely.to_wkb(cell))).area / 1e6
                            if part > 0:
                                out.append((k, row, col, part, part / whole))
                yield pd.DataFrame(out, columns=[key, "row", "col", "area_km2", "share"])

    return shapes.select(key, wkb).mapInPandas(work, f"`{key}` {kind}, row int, col int, area_km2 double, share double")


def with_boxes(shapes: DataFrame, wkb: str = "wkb") -> DataFrame:
    @F.pandas_udf("west double, south double, east double, north double")
    def box(col: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_shapely().from_wkb(bytes(w)).bounds for w in col], columns=["west", "south", "east", "north"])

    return shapes.withColumn("box", box(F.col(wkb))).select("*", "box.*").drop("box")


def boxes_to_blocks(boxes: DataFrame, size: float = 5.0) -> DataFrame:
    """One row per block of ``size`` degrees that a box (west, south, east, north) covers."""
    x = F.sequence(F.floor(F.col("west") / size), F.floor(F.col("east") / size))
    y = F.sequence(F.floor(F.col("south") / size), F.floor(F.col("north") / size))
    return boxes.withColumn("bx", F.explode(x)).withColumn("by", F.explode(y))


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float = 5.0) -> DataFrame:
    """Candidate pairs of points (lat, lon) and boxes: equal block, then the box itself."""
    p = points.withColumn("bx", F.floor(F.col("lon") / size)).withColumn("by", F.floor(F.col("lat") / size))
    return p.join(boxes_to_blocks(boxes, size), ["bx", "by"]).where(F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))).drop("bx", "by")


def points_in_shapes(points: DataFrame, shapes: DataFrame, wkb: str = "wkb") -> DataFrame:
    """Pairs of points and shapes that hold them."""

    @F.pandas_udf("boolean")
    def holds(w: pd.Series, lon: pd.Series, lat: pd.Series) -> pd.Series:
        shapely = _shapely()
        return pd.Series([shapely.from_wkb(bytes(a)).covers(shapely.Point(x, y)) for a, x, y in zip(w, lon, lat)])

    return points_in_boxes(points, with_boxes(shapes, wkb)).where(holds(F.col(wkb), F.col("lon"), F.col("lat")))
