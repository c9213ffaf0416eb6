"""Tables laid out so that a part of them can be read alone: clustered by several columns, or sorted by a key.

A reader needs nothing but its filter: files and row groups carry the least and
greatest value of each column, and Spark leaves out those that cannot match.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .places import opened
from .sinks import checked_write

GROUPS_SCHEMA = "file string, row_group int, column string, rows long, bytes long, low double, high double"


def interleaved(parts: list[Column], bits: int) -> Column:
    """Z-order number: the bits of whole numbers below 2**bits taken in turn, the first column's lowest."""
    if bits * len(parts) > 62:
        raise ValueError("too many bits for one number")
    out = F.lit(0).cast("long")
    for b in range(bits):
        for i, part in enumerate(parts):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(part.cast("long"), b).bitwiseAND(F.lit(1)), b * len(parts) + i))
    return out


def _number(c: str, df: DataFrame) -> Column:
    kind = dict(df.dtypes)[c]
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind.startswith("timestamp"):
        return F.col(c).cast("timestamp").cast("double")
    return F.col(c).cast("double")


def z_number(df: DataFrame, by: list[str], bits: int = 10) -> Column:
    """Each row's place on the Z-order curve through the span of the columns (numbers, dates or times).

    Spans come from one aggregate over the columns. Null and NaN count as the least value; a
    column with one value or none adds nothing.
    """
    def value(c: str) -> Column:
        return F.when(~F.isnan(_number(c, df)), _number(c, df))

    span = df.agg(*[f(value(c)).alias(f"{n}{i}") for i, c in enumerate(by) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    parts = []
    for i, c in enumerate(by):
        lo, hi = span[f"lo{i}"], span[f"hi{i}"]
        if lo is None or hi <= lo:
            parts.append(F.lit(0))
        else:
            parts.append(F.coalesce(F.floor((value(c) - lo) / (hi - lo) * (2**bits - 1)), F.lit(0)))
    return interleaved(parts, bits)


def _laid(df: DataFrame, order: list[Column], files: int | None) -> DataFrame:
    # the row's hash splits values that many rows share among several tasks
    hashed = F.xxhash64(*df.columns)
    ranged = df.repartitionByRange(files, *order, hashed) if files else df.repartitionByRange(*order, hashed)
    return ranged.sortWithinPartitions(*order, hashed)


def write_clustered(df: DataFrame, path: str, by: list[str], files: int | None = None, bits: int = 10, **options) -> DataFrame:
    """Write a table along the Z-order curve of some columns, so that a box in them lies in few files and row groups.

    One range shuffle; without ``files`` adaptive execution sets their number. Returns the table
    read back and compared. The rows must come out the same when worked out twice.
    """
    return checked_write(_laid(df, [z_number(df, by, bits)], files), path, **options)


def write_sorted(df: DataFrame, path: str, by: list[str], files: int | None = None, **options) -> DataFrame:
    """Write a table sorted by a key over all files, nulls first; rows with equal keys lie side by side in any order.

    Equal keys may be spread over neighbouring files. Returns the table read back and compared.
    """
    return checked_write(_laid(df, [F.col(c) for c in by], files), path, **options)


def with_place(table: DataFrame, name: str = "place") -> DataFrame:
    """Rows of a written table with their place, from 1, in the order of file names and rows inside.

    Files are counted, not rows: the running sum is over one row a file.
    """
    rows = table.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__index"))
    before = F.sum("__n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("__file").agg(F.count("*").alias("__n")).select("__file", F.coalesce(before, F.lit(0)).alias("__start"))
    return rows.join(starts, "__file").withColumn(name, F.col("__start") + F.col("__index") + 1).drop("__file", "__index", "__start")


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """Per file, row group and column: rows, bytes, least and greatest value where these are numbers or dates (days).

    Only footers are read, in tasks.
    """

    def footers(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import datetime

        from pyarrow import parquet

        def number(x):
            if isinstance(x, datetime.datetime):
                return x.timestamp()
            if isinstance(x, datetime.date):
                return float(x.toordinal() - datetime.date(1970, 1, 1).toordinal())
            return float(x) if isinstance(x, (int, float)) else None

        for part in parts:
            out = []
            for file in part["path"]:
                fs, place = opened(file)
                with fs.open_input_file(place) as f:
                    meta = parquet.ParquetFile(f).metadata
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in range(group.num_columns):
                        col = group.column(c)
                        s = col.statistics if col.is_stats_set else None
                        has = s is not None and s.has_min_max
                        out.append((file, g, col.path_in_schema, group.num_rows, col.total_compressed_size, number(s.min) if has else None, number(s.max) if has else None))
            yield pd.DataFrame(out, columns=["file", "row_group", "column", "rows", "bytes", "low", "high"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return files.select("path").mapInPandas(footers, GROUPS_SCHEMA)


def rows_to_read(groups: DataFrame, box: dict[str, tuple[float, float]]) -> DataFrame:
    """One row: all rows, and those of the row groups that a box (column: least, greatest) can meet."""
    tests = [F.col("column") == c for c in box]
    misses = F.lit(False)
    for test, (low, high) in zip(tests, box.values()):
        misses = misses | (test & ((F.col("high") < low) | (F.col("low") > high)))
    each = groups.groupBy("file", "row_group").agg(F.first("rows").alias("rows"), F.bool_or(F.coalesce(misses, F.lit(False))).alias("misses"))
    return each.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("all_rows"), F.coalesce(F.sum(F.when(~F.col("misses"), F.col("rows"))), F.lit(0)).alias("met_rows"))
