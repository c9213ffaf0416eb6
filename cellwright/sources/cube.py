"""The only way to a cube: month states are checked before any value is read.

A cube is a long table, one row per month and cell, stored by year and month; a
state table says which months are finished. Not loaded, no data and zero stay
three things.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FINISHED, HOLD_OUT_FROM, REGION, STATES, CubeFormatError, HoldOutLocked, MonthNotFinished
from ..functions.months import month_index
from ..functions.quality import observed_share_or_null

KEYS = ("month", "row", "col")


def state_text(code: int) -> str:
    return STATES.get(code, f"unknown state {code}")


def check_hold_out(months: Sequence[tuple[int, int]], released: bool = False) -> None:
    """Error for hold-out months, or a warning if they are released."""
    locked = sorted(m for m in months if tuple(m) >= HOLD_OUT_FROM)
    if locked and released:
        warnings.warn(f"hold-out period released: {len(locked)} months from {locked[0]}", stacklevel=2)
    elif locked:
        raise HoldOutLocked(f"{len(locked)} months from {locked[0][0]:04d}-{locked[0][1]:02d} on lie in the hold-out period")


class CubeReader:
    """Reads months of a cube (path or DataFrame) by the state table (month, state)."""

    def __init__(self, cube: DataFrame, states: DataFrame, keys: tuple = KEYS):
        missing = [c for c in keys if c not in cube.columns] + [c for c in ("month", "state") if c not in states.columns]
        if missing:
            raise CubeFormatError(f"columns missing: {', '.join(missing)}")
        self.cube, self.states, self.keys = cube, states, keys

    @classmethod
    def open(cls, spark, path: str, states_path: str, schema=None):
        """Cube and state table as Parquet."""
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return cls(reader.parquet(path), spark.read.parquet(states_path))

    def finished_months(self) -> DataFrame:
        return self.states.where(F.col("state") == FINISHED).select("month").orderBy("month")

    def months(self) -> DataFrame:
        """All months on the axis, finished or not."""
        return self.states.select("month").orderBy("month")

    def month_states(self) -> DataFrame:
        names = F.create_map(*[F.lit(x) for p in STATES.items() for x in p])
        text = F.coalesce(names[F.col("state").cast("int")], F.concat(F.lit("unknown state "), F.col("state")))
        return self.states.select("month", "state", text.alias("text")).orderBy("month")

    def grid(self) -> DataFrame:
        return self.cube.select("row", "col", "lat", "lon").distinct()

    def _states_of(self, months: Sequence[tuple[int, int]]) -> dict:
        """States of the asked months; at most as many rows as months asked for come to the driver."""
        want = [y * 12 + m - 1 for y, m in months]
        rows = self.states.where(month_index(F.col("month")).isin(want)).select(month_index(F.col("month")).alias("t"), "state").collect()
        return {(r["t"] // 12, r["t"] % 12 + 1): r["state"] for r in rows}

    def _named(self, months, values: list[str] | None, extra: tuple = ()) -> DataFrame:
        """Rows of the asked months with their ordinal; the literal list prunes partitions."""
        t = month_index(F.col("month"))
        order = F.create_map(*[F.lit(x) for i, (y, m) in enumerate(months) for x in (y * 12 + m - 1, i)])
        rows = self.cube.where(t.isin([y * 12 + m - 1 for y, m in months])).withColumn("ordinal", order[t])
        return rows.select("ordinal", *self.keys, *(values or [c for c in self.cube.columns if c not in self.keys]), *extra)

    def read_months(self, months: Sequence[tuple[int, int]], values: list[str] | None = None) -> DataFrame:
        """Finished months in the asked order; an unfinished one is an error that names all of them."""
        states = self._states_of(months)
        open_ = [f"{y:04d}-{m:02d} ({state_text(states.get((y, m), 0))})" for y, m in months if states.get((y, m), 0) != FINISHED]
        if open_:
            raise MonthNotFinished("not finished: " + ", ".join(open_))
        return self._named(months, values)

    def read_finished(self, values: list[str] | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
        """All finished months between two months ('YYYY-MM'); typed and empty if there is none."""
        ready = self.states.where(F.col("state") == FINISHED).select("month")
        rows = self.cube
        if first:
            rows = rows.where(F.col("month") >= F.lit(f"{first}-01").cast("date"))
        if last:
            rows = rows.where(F.col("month") <= F.lit(f"{last}-01").cast("date"))
        return rows.join(ready, "month", "left_semi").select(*self.keys, *(values or [c for c in self.cube.columns if c not in self.keys]))

    def read_with_region(self, values: list[str], region: DataFrame, months: Sequence[tuple[int, int]] | None = None, region_state: int = REGION) -> DataFrame:
        """Months that are finished, or finished in the region (row, col) only.

        In the latter, cells outside the region are null in every value and
        ``not_loaded`` is true.
        """
        if months is not None:
            states = self._states_of(months)
            open_ = [f"{y:04d}-{m:02d} ({state_text(states.get((y, m), 0))})" for y, m in months if states.get((y, m), 0) not in (FINISHED, region_state)]
            if open_:
                raise MonthNotFinished("not finished: " + ", ".join(open_))
            rows = self._named(months, values).drop("ordinal")
        else:
            rows = self.cube.select(*self.keys, *values)
        ready = self.states.where(F.col("state").isin(FINISHED, region_state)).select("month", "state")
        inside = region.select("row", "col").distinct().withColumn("in_region", F.lit(True))
        met = rows.join(ready, "month").join(inside, ["row", "col"], "left")
        out = (F.col("state") == region_state) & F.col("in_region").isNull()
        return met.select(*self.keys, *[F.when(~out, F.col(v)).alias(v) for v in values], out.alias("not_loaded"))

    def read_series(self, value: str, valid: str, filled: str, first: tuple[int, int], last: tuple[int, int], region: DataFrame | None = None, min_observed: float = 0.5, released: bool = False) -> DataFrame:
        """(row, col, t, month, x, share, state) for trends; months that are missing stay out.

        Values below the observed share are null; the label says finished or region only.
        """
        check_hold_out([last], released)
        span = F.col("month").between(F.make_date(F.lit(first[0]), F.lit(first[1]), F.lit(1)), F.make_date(F.lit(last[0]), F.lit(last[1]), F.lit(1)))
        view = CubeReader(self.cube.where(span), self.states, self.keys)
        if region is not None:
            rows = view.read_with_region([value, valid, filled], region)
        else:
            rows = view.read_finished([value, valid, filled]).withColumn("not_loaded", F.lit(False))
        share = observed_share_or_null(F.col(valid), F.col(filled))
        ok = (share >= min_observed) & ~F.col("not_loaded")
        label = self.states.select("month", F.when(F.col("state") == FINISHED, "finished").otherwise("region only").alias("state"))
        t = month_index(F.col("month")) - (first[0] * 12 + first[1] - 1)
        return rows.join(label, "month").select("row", "col", t.alias("t"), "month", F.when(ok, F.col(value)).alias("x"), share.alias("share"), "state")


def dense(series: DataFrame, axis: DataFrame, cells: list[str]) -> DataFrame:
    """Series with a row for every cell and month of the axis; missing values null."""
    every = series.select(*cells).distinct().crossJoin(F.broadcast(axis.select("t")))
    return every.join(series, [*cells, "t"], "left")


def region_mask(cells: DataFrame, tiles: DataFrame, per_tile: int = 40) -> DataFrame:
    """Cells (row, col) whose tile is in the list (tile)."""
    from ..functions.grid import tile_name

    return cells.withColumn("tile", tile_name(F.col("row"), F.col("col"), per_tile)).join(tiles, "tile", "left_semi")
