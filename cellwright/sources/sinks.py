"""Writing a cube month by month, and tables whole: staged, read back, then published.

A month is published in four steps: state 3 (being written), the month's own
folder, comparison of what was read back, final state. A crash between the
steps leaves state 3, which no reader accepts. Months are folders
``year=.../mon=...``; only the month's own folder is ever replaced. Whole tables
are versions under a folder; a pointer names the one that readers see.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import FINISHED, REGION
from ..functions.months import axis
from .places import create_once, handle, read_json

WRITING, INCOMPLETE, ABSENT = 3, 2, 5
STATE_SCHEMA = "month date, state int, version long"


class MonthExists(ValueError):
    """A finished month is never overwritten."""


class WriteMismatch(RuntimeError):
    """What was read back is not what was written."""


class Superseded(RuntimeError):
    """Another writer has published first."""


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, counted with repetitions; empty if both are equal."""
    return a.exceptAll(b).union(b.exceptAll(a))


def fingerprint(df: DataFrame) -> list[Column]:
    """Number of rows and sum of their 64-bit hashes: equal for equal rows in any order."""
    return [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(28,0)")).alias("hashes")]


def checked_write(df: DataFrame, place: str, mode: str = "error", **options) -> DataFrame:
    """Write a table and read it back; what is on disk must have the fingerprint taken while writing.

    The rows are worked out once. A difference is an error.
    """
    seen = Observation()
    df.observe(seen, *fingerprint(df)).write.mode(mode).parquet(place, **options)
    back = df.sparkSession.read.schema(df.schema).parquet(place)
    wrote, read = seen.get, back.agg(*fingerprint(back)).first()
    if (wrote["n"], wrote["hashes"]) != (read["n"], read["hashes"]):
        raise WriteMismatch(f"{place}: read back differs from what was written")
    return back


def publish_set(tables: dict[str, DataFrame], path: str, after: int | None = None, **options) -> dict[str, DataFrame]:
    """Write tables that belong together as the version after ``after``, then point readers to it.

    Every table is written and checked in the version's own folder; one small
    pointer file makes all of them visible at once. It is created only if nobody
    has: of two writers that began from the same version one publishes, the other
    gets ``Superseded`` and takes its files away. ``after`` is the version that the
    tables were worked out from, the newest at the call by default. A crash
    before leaves readers on the version before. Old versions stay until
    ``drop_versions``.
    """
    spark = next(iter(tables.values())).sparkSession
    number = ((newest(spark, path) or 0) if after is None else after) + 1
    # a name of its own: what a crashed run left under the number is not touched
    folder = f"{number}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        checked_write(df, f"{path}/versions/{folder}/{name}", **options)
    if not create_once(spark, _pointer(path, number), {"version": number, "folder": folder}):
        fs, place = handle(spark, f"{path}/versions/{folder}")
        fs.delete(place, True)
        raise Superseded(f"{path}: another writer has published version {number}")
    return {name: published(spark, path, name) for name in tables}


def publish(df: DataFrame, path: str, after: int | None = None, **options) -> DataFrame:
    """One table, published as a set of its own."""
    return publish_set({"table": df}, path, after, **options)["table"]


def _pointer(path: str, number: int) -> str:
    return f"{path}/pointer/{number:012d}.json"


def newest(spark: SparkSession, path: str) -> int | None:
    """Number of the version that readers see, none before the first."""
    fs, place = handle(spark, f"{path}/pointer")
    if not fs.exists(place):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return max((int(n[:12]) for n in names if n[:1].isdigit() and n.endswith(".json")), default=None)


def published(spark: SparkSession, path: str, name: str = "table") -> DataFrame:
    """A table of the newest published version."""
    number = newest(spark, path)
    if number is None:
        raise ValueError(f"{path}: nothing is published")
    return spark.read.parquet(f"{path}/versions/{read_json(spark, _pointer(path, number))['folder']}/{name}")


def drop_versions(spark: SparkSession, path: str) -> None:
    """Remove every version and pointer but the newest; for a time when nobody reads an older one or publishes."""
    number = newest(spark, path)
    keep = {read_json(spark, _pointer(path, number))["folder"], _pointer(path, number).rpartition("/")[2]}
    for part in ("versions", "pointer"):
        fs, root = handle(spark, f"{path}/{part}")
        for status in fs.listStatus(root):
            if status.getPath().getName() not in keep:
                fs.delete(status.getPath(), True)


class CubeWriter:
    """States and months of one cube under a folder.

    The state table is append-only: the newest version of a month counts, so a
    change of state is one small file and never touches the others.
    """

    def __init__(self, spark: SparkSession, path: str, first: str = "2013-01", last: str = "2025-12"):
        self.spark, self.path, self.first, self.last = spark, path, first, last

    @property
    def _states(self) -> str:
        return f"{self.path}/states"

    def create(self) -> None:
        """All months of the axis, not loaded."""
        rows = axis(self.spark, self.first, self.last).select("month", F.lit(0).alias("state"), F.lit(0).cast("long").alias("version"))
        rows.coalesce(1).write.parquet(self._states)

    def states(self) -> DataFrame:
        rows = self.spark.read.schema(STATE_SCHEMA).parquet(self._states)
        return rows.groupBy("month").agg(F.max_by("state", "version").alias("state"))

    def state(self, year: int, month: int) -> int:
        """State of a month of the axis; a month outside it is an error."""
        row = self.states().where(F.col("month") == F.make_date(F.lit(year), F.lit(month), F.lit(1))).first()
        if row is None:
            raise ValueError(f"{year:04d}-{month:02d} lies outside the axis {self.first} .. {self.last}")
        return row["state"]

    def set_state(self, year: int, month: int, state: int) -> None:
        known = self.spark.read.schema(STATE_SCHEMA).parquet(self._states).agg(F.max("version")).first()[0] or 0
        row = [(datetime.date(year, month, 1), state, known + 1)]
        self.spark.createDataFrame(row, STATE_SCHEMA).coalesce(1).write.mode("append").parquet(self._states)

    def month_path(self, year: int, month: int) -> str:
        return f"{self.path}/cells/year={year}/mon={month}"

    def cells(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/cells").parquet(f"{self.path}/cells")

    def write_month(self, rows: DataFrame, year: int, month: int, target: int = FINISHED) -> None:
        """Publish one month's cells; a finished month is never overwritten."""
        if self.state(year, month) == FINISHED:
            raise MonthExists(f"{year:04d}-{month:02d} is finished")
        self.set_state(year, month, WRITING)
        place = self.month_path(year, month)
        checked_write(rows, place, "overwrite")
        self.set_state(year, month, target)

    def merge_month(self, rest: DataFrame, region: DataFrame, year: int, month: int) -> None:
        """Complete a month whose region part is there: rest outside the region, the old part inside."""
        if self.state(year, month) != REGION:
            raise ValueError(f"{year:04d}-{month:02d} is not in the region state")
        old = self.spark.read.schema(rest.schema).parquet(self.month_path(year, month))
        merged = merge_region(old, rest, region)
        # written aside first: the month's folder is read by the merge
        stage = f"{self.path}/merge_{year}_{month}_{uuid.uuid4().hex[:8]}"
        merged.write.parquet(stage)
        self.write_month(self.spark.read.schema(rest.schema).parquet(stage), year, month)
        fs, place = handle(self.spark, stage)
        fs.delete(place, True)

    def mark_absent(self, year: int, month: int, listed: set[tuple[int, int]]) -> None:
        """State 'not at provider', for listed months that are not finished."""
        if (year, month) not in listed:
            raise ValueError(f"{year:04d}-{month:02d} is not listed as absent")
        if self.state(year, month) == FINISHED:
            raise MonthExists(f"{year:04d}-{month:02d} is finished")
        self.set_state(year, month, ABSENT)

    def demote(self, months: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Finished months of the list become incomplete; returns those changed."""
        changed = [m for m in months if self.state(*m) == FINISHED]
        for m in changed:
            self.set_state(*m, INCOMPLETE)
        return changed

    def months_by_state(self) -> DataFrame:
        return self.states().groupBy("state").agg(F.sort_array(F.collect_list("month")).alias("months"))


def merge_region(old: DataFrame, rest: DataFrame, region: DataFrame) -> DataFrame:
    """Old rows inside the region (row, col), rest outside; rest inside the region is an error."""
    overlap = rest.join(region.select("row", "col"), ["row", "col"], "left_semi")
    if not overlap.isEmpty():
        raise ValueError(f"both parts hold cells of the region, e.g. {overlap.select('row', 'col').limit(3).collect()}")
    return old.join(region.select("row", "col"), ["row", "col"], "left_semi").unionByName(rest)


def manifest_rows(spark: SparkSession, known: DataFrame, first: str, last: str) -> DataFrame:
    """(month, state, note): a row for every month of the axis, unlisted ones 'not loaded'."""
    months = axis(spark, first, last).select(F.date_format("month", "yyyy-MM").alias("month"))
    return months.join(known, "month", "left").select("month", F.coalesce("state", F.lit("not loaded")).alias("state"), F.coalesce("note", F.lit("")).alias("note")).orderBy("month")


def write_manifest(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_documents(df: DataFrame, path: str, columns: list[Column] | None = None) -> None:
    """One JSON document per row."""
    df.select(F.to_json(F.struct(*(columns or [F.col(c) for c in df.columns]))).alias("value")).write.mode("overwrite").text(path)


def missing_blocks(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Blocks still to fetch: a resumed run asks only for these, and a result exists when none is left."""
    return wanted.join(done, key, "left_anti")
