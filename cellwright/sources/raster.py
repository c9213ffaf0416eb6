"""Raster files as Spark data sources. The readers need h5py, looked for only when a file is read."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

POSITION = re.compile(r"h(\d{2})v(\d{2})")
DAY = re.compile(r"A(\d{4})(\d{3})")


def _h5py():
    try:
        import h5py
    except ModuleNotFoundError as e:
        raise RuntimeError("raster sources need h5py on the executors") from e
    return h5py


def check_axis(values, n: int, step: float, edge: float, name: str) -> None:
    """Error unless an axis has n equal steps of the given size from the given edge."""
    import numpy as np

    v = np.asarray(values, dtype=float)
    if len(v) != n or not np.allclose(np.diff(v), step, atol=1e-4) or abs(v[0] - step / 2 - edge) > 1e-3:
        raise ValueError(f"axis {name}: {len(v)} values from {v[0]}, expected {n} steps of {step} from {edge}")


def oriented(field, lat, lon):
    """Field with axes (lat, lon), south to north and west to east, whatever the order in the file."""
    import numpy as np

    field = np.squeeze(np.asarray(field))
    if field.shape == (len(lon), len(lat)) and len(lat) != len(lon):
        field = field.T
    if field.shape != (len(lat), len(lon)):
        raise ValueError(f"field {field.shape} fits neither axis order")
    if lat[0] > lat[-1]:
        field, lat = field[::-1], lat[::-1]
    if lon[0] > lon[-1]:
        field, lon = field[:, ::-1], lon[::-1]
    return field, lat, lon


class _Files(DataSourceReader):
    """One partition per file of the folder."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        path = self.options["path"]
        names = sorted(n for n in os.listdir(path) if n.endswith((".h5", ".hdf5", ".HDF5", ".nc4"))) if os.path.isdir(path) else [os.path.basename(path)]
        top = path if os.path.isdir(path) else os.path.dirname(path)
        return [InputPartition(os.path.join(top, n)) for n in names]


class TileReader(_Files):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import datetime

        file = partition.value
        position, day = POSITION.search(os.path.basename(file)), DAY.search(os.path.basename(file))
        if not position or not day:
            raise ValueError(f"no tile position and day in {file}")
        h, v = map(int, position.groups())
        date = datetime.date(int(day[1]), 1, 1) + datetime.timedelta(int(day[2]) - 1)
        prefix = self.options.get("field", "AllAngle_Composite_Snow_Free")
        with _h5py().File(file, "r") as f:
            group = f[self.options.get("group", "HDFEOS/GRIDS/VIIRS_Grid_DNB_2d/Data Fields")]
            lat = group["lat"][:]
            if abs(float(max(lat)) - (90 - 10 * v)) > 0.1:
                raise ValueError(f"{file} does not lie where its name says")
            value, num, quality = group[prefix][:], group[f"{prefix}_Num"][:], group[f"{prefix}_Quality"][:]
        month = date.replace(day=1)
        for y in range(value.shape[0]):
            for x in range(value.shape[1]):
                yield (month, h, v, y, x, float(value[y, x]), int(num[y, x]), int(quality[y, x]))


class TileSource(DataSource):
    """``spark.read.format("tiles").load(folder)``: one row per pixel of 10-degree tiles."""

    @classmethod
    def name(cls) -> str:
        return "tiles"

    def schema(self) -> str:
        return "month date, h int, v int, py int, px int, value float, num int, quality int"

    def reader(self, schema) -> DataSourceReader:
        return TileReader(self.options)


class GridReader(_Files):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with _h5py().File(partition.value, "r") as f:
            group = f[self.options.get("group", "Grid")]
            lat, lon = group["lat"][:], group["lon"][:]
            names = self.options.get("fields", "precipitation").split(",")
            fields = [oriented(group[n][:], lat, lon)[0] for n in names]
        for i in range(fields[0].shape[0]):
            for j in range(fields[0].shape[1]):
                yield (os.path.basename(partition.value), i, j, *[float(x[i, j]) for x in fields])


class GridSource(DataSource):
    """``spark.read.format("grids").option("fields", "a,b").load(folder)``: one row per pixel of global grids."""

    @classmethod
    def name(cls) -> str:
        return "grids"

    def schema(self) -> str:
        names = self.options.get("fields", "precipitation").split(",")
        return "file string, i int, j int, " + ", ".join(f"`{n}` double" for n in names)

    def reader(self, schema) -> DataSourceReader:
        return GridReader(self.options)


class ShapeReader(_Files):
    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.options["path"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import json

        try:
            import pyogrio
        except ModuleNotFoundError as e:
            raise RuntimeError("zipped shapefiles need pyogrio on the executors") from e
        meta, _, wkb, columns = pyogrio.raw.read(f"zip://{partition.value}")
        for k, w in enumerate(wkb):
            yield (json.dumps({n: str(c[k]) for n, c in zip(meta["fields"], columns)}), bytes(w))


class ShapeSource(DataSource):
    """``spark.read.format("shapes").load(zip)``: attributes as JSON and geometry as WKB."""

    @classmethod
    def name(cls) -> str:
        return "shapes"

    def schema(self) -> str:
        return "attributes string, wkb binary"

    def reader(self, schema) -> DataSourceReader:
        return ShapeReader(self.options)


def register(spark) -> None:
    for source in (TileSource, GridSource, ShapeSource):
        spark.dataSource.register(source)
