"""A scan that reads only what a manifest proves: months pruned by pushed filters, checksums before values.

The manifest has one row a file: month, file, state, sha256. Months outside the
pushed filters, and months that are not finished, are never opened. Every file of
a wanted month is hashed before it is parsed; one that is absent from the
manifest, has another hash, or is missing on disk is an error that names it.
"""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .places import opened

FORMAT = "cellwright_proven"
PROVEN = ("loaded", "region")


class Unproven(RuntimeError):
    """A file that the manifest does not prove."""


class Piece(InputPartition):
    def __init__(self, month: datetime.date, file: str, sha256: str):
        self.month, self.file, self.sha256 = month, file, sha256


def checksum(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


class ProvenReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names, self.filters = path, [f.name for f in schema.fields], []
        self.schema = schema

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of the month with a constant decide which files exist for this scan; the rest stays with Spark."""
        tests = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}
        for f in filters:
            test = tests.get(type(f))
            if test and f.attribute == ("month",):
                self.filters.append((type(f).__name__, f.value))
            else:
                yield f

    def _wanted(self, month: datetime.date) -> bool:
        tests = {"EqualTo": lambda b: month == b, "GreaterThan": lambda b: month > b, "GreaterThanOrEqual": lambda b: month >= b, "LessThan": lambda b: month < b, "LessThanOrEqual": lambda b: month <= b, "In": lambda b: month in b}
        return all(tests[kind](value) for kind, value in self.filters)

    def partitions(self) -> list[Piece]:
        """A partition a file; what lies in a wanted month's folder without a row in the manifest is an error."""
        from pyarrow import fs as afs
        from pyarrow import parquet

        fs, root = opened(self.path)
        rows = []
        for part in fs.get_file_info(afs.FileSelector(f"{root}/manifest")):
            if part.base_name.endswith(".parquet"):
                with fs.open_input_file(part.path) as f:
                    rows += parquet.read_table(f).to_pylist()
        named = {r["file"]: r for r in rows}
        pieces = [Piece(r["month"], r["file"], r["sha256"]) for r in rows if r["state"] in PROVEN and self._wanted(r["month"])]
        for month in sorted({p.month for p in pieces}):
            for found in fs.get_file_info(afs.FileSelector(f"{root}/cells/month={month}", allow_not_found=True)):
                name = f"cells/month={month}/{found.base_name}"
                if not found.base_name.startswith(("_", ".")) and name not in named:
                    raise Unproven(f"{name} is not in the manifest")
        return sorted(pieces, key=lambda p: p.file)

    def read(self, piece: Piece | None) -> Iterator:
        import pyarrow as pa
        from pyarrow import parquet
        from pyspark.sql.pandas.types import to_arrow_schema

        if piece is None:  # no file is wanted
            return
        fs, root = opened(self.path)
        try:
            with fs.open_input_stream(f"{root}/{piece.file}") as f:
                data = f.read()
        except FileNotFoundError:
            raise Unproven(f"{piece.file} is in the manifest and not on disk") from None
        if checksum(data) != piece.sha256:
            raise Unproven(f"{piece.file} differs from its checksum in the manifest")
        own = [n for n in self.names if n != "month"]
        table = parquet.read_table(pa.BufferReader(data), columns=own)
        table = table.append_column("month", pa.array([piece.month] * table.num_rows, pa.date32())).select(self.names)
        yield from table.cast(to_arrow_schema(self.schema)).to_batches()


class ProvenSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema: StructType) -> ProvenReader:
        return ProvenReader(self.options["path"], schema)


def write_proven(cube: DataFrame, path: str, states: DataFrame | None = None) -> None:
    """Write a cube as month folders and the manifest that proves its files; ``states``: (month, state) of months to mark otherwise."""
    spark = cube.sparkSession
    cube.repartition("month").withColumn("__month", F.col("month").cast("string")).drop("month").withColumnRenamed("__month", "month").write.partitionBy("month").parquet(f"{path}/cells")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{path}/cells")
    file = F.regexp_extract("path", r"(cells/month=[^/]+/[^/]+)$", 1)
    rows = files.select(F.to_date(F.regexp_extract("path", r"month=(\d{4}-\d{2}-\d{2})", 1)).alias("month"), file.alias("file"), F.sha2("content", 256).alias("sha256"))
    if states is not None:
        rows = rows.join(states, "month", "left")
    else:
        rows = rows.withColumn("state", F.lit("loaded"))
    rows.select("month", "file", F.coalesce("state", F.lit("loaded")).alias("state"), "sha256").coalesce(1).write.parquet(f"{path}/manifest")


def proven(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """The cube's proven months; ``columns``: their schema, with month.

    Spark remembers the filters pushed into a relation until others are pushed;
    the condition that always stands here keeps one use from inheriting another's.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ProvenSource)
    return spark.read.format(FORMAT).option("path", path).option("columns", columns).load().where("month is not null")
