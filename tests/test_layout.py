"""Tile regions, absent tiles, clustered and sorted tables."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from cellwright.config import AbsenceRules
from cellwright.operators import tiles as TI
from cellwright.sources import layout, tables


def scanned(df):
    """Rows that the scan below a frame has put out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    out = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName().startswith("AdaptiveSparkPlan"):
            leaf = leaf.executedPlan().collectLeaves().apply(0)
        out += leaf.metrics().apply("numOutputRows").value()
    return out


def test_region_by_sets(spark):
    rng = random.Random(5)
    names = {k: (f"unit {k}", rng.choice(["Africa", "Europe", "Asia", "Oceania", "", None])) for k in range(12)}
    bridge = [(rng.randrange(12), rng.randrange(24), rng.randrange(12), rng.choice([0.0, 0.5, 1.0, None])) for _ in range(150)]
    reference = {f"h{h:02d}v{v:02d}" for h in range(6) for v in range(3) if (h + v) % 4}
    got = TI.region_parts(
        spark.createDataFrame(bridge, "row int, col int, unit_id int, share double"), spark.createDataFrame([(k, *v) for k, v in names.items()], "unit_id int, name string, m49_region string"),
        ("Africa", "Europe"), spark.createDataFrame([(t,) for t in reference], "tile string"), 4,
    )
    land = [(f"h{c // 4:02d}v{r // 4:02d}", *names[u]) for r, c, u, s in bridge if s]
    inside = {t for t, _, g in land if g in ("Africa", "Europe")}
    others = {t for t, _, g in land if g in ("Asia", "Oceania")}
    want = {("tile", t) for t in inside & reference} | {("outside reference", t) for t in inside - reference} | {("mixed", t) for t in inside & others & reference}
    want |= {("unit without region", n) for t, n, g in land if not g and t not in inside}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and {k for k, _ in want} == {"tile", "outside reference", "mixed", "unit without region"}


def test_region_edges(spark, tmp_path):
    bridge = spark.createDataFrame([(0, 0, 1, 0.5), (0, 0, 7, 0.0)], "row int, col int, unit_id int, share double")
    units = spark.createDataFrame([(1, "one", "Africa")], "unit_id int, name string, m49_region string")
    reference = spark.createDataFrame([("h00v00",)], "tile string")
    assert [tuple(r) for r in TI.region_parts(bridge, units, ("Africa",), reference).collect()] == [("tile", "h00v00")]
    with pytest.raises(Exception, match="unit 7"):
        TI.region_parts(bridge.withColumn("share", F.lit(1.0)), units, ("Africa",), reference).collect()
    empty = TI.region_parts(bridge.limit(0), units, ("Africa",), reference)
    assert empty.count() == 0
    TI.write_region_list(TI.region_list(empty, "none", "rule"), str(tmp_path / "list"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "list")).collect()]
    assert "# tiles: 0" in lines and "# with cells of other regions: none" in lines
    assert tables.tile_list(spark, str(tmp_path / "list")).count() == 0


def test_absence(spark):
    reference = spark.createDataFrame([("h00v00",), ("h01v02",), ("h02v09",)], "tile string")
    may, june, dec = datetime.date(2020, 5, 1), datetime.date(2020, 6, 1), datetime.date(2020, 12, 1)
    seen = [(may, "h02v09"), (may, "h01v02"), (june, "h00v00"), (june, "h01v02"), (dec, "h00v00"), (dec, "h02v09"), (dec, "h30v30")]
    found = TI.absence_findings(TI.absent_tiles(reference, spark.createDataFrame(seen, TI.ABSENT_SCHEMA), "2020-05", "2020-12"), AbsenceRules(most=2))
    got = {r["month"]: (r["n_absent"], r["reasons"]) for r in found.collect()}
    assert got[may] == (1, "") and got[june] == (1, "south of the known rows: h02v09") and got[dec] == (1, "outside months 4 to 8")
    assert got[datetime.date(2020, 7, 1)] == (3, "3 tiles (at most 2); south of the known rows: h02v09")
    TI.check_absence(found.where(F.col("month") == may))
    with pytest.raises(TI.UnexpectedAbsence, match="2020-06: 1 tiles"):
        TI.check_absence(found)


def test_clustered_reads_less(spark, tmp_path):
    rows = spark.range(40_000).select("id", (F.xxhash64("id") % 500).alias("row"), (F.xxhash64("id", F.lit(1)) % 500).alias("col"))
    box = "row between 100 and 150 and col between -50 and 0"
    want = {r[0] for r in rows.where(box).select("id").collect()}
    plain = layout.checked_write(rows.repartition(16), str(tmp_path / "plain"))
    laid = layout.write_clustered(rows, str(tmp_path / "laid"), ["row", "col"], 16)
    assert {r[0] for r in laid.where(box).select("id").collect()} == want
    assert scanned(plain.where(box)) == 40_000 and scanned(laid.where(box)) <= 10_000
    met = layout.rows_to_read(layout.row_groups(spark, str(tmp_path / "laid")), {"row": (100, 150), "col": (-50, 0)}).first()
    assert met["all_rows"] == 40_000 and len(want) <= met["met_rows"] <= 10_000


def test_hot_and_odd_values(spark, tmp_path):
    """A third of all rows in one value are split among files; null, NaN and constant columns do no harm."""
    v = F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 1000 == 1, None).when(F.col("id") % 1000 == 2, float("nan")).otherwise(F.col("id").cast("double"))
    rows = spark.range(12_000).select("id", v.alias("v"), F.lit(4).alias("same"))
    for name, laid in (("z", layout.write_clustered(rows, str(tmp_path / "z"), ["v", "same"], 8)), ("s", layout.write_sorted(rows, str(tmp_path / "s"), ["v"], 8))):
        sizes = [r["n"] for r in laid.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 12_000 and max(sizes) < 3000, name
    placed = layout.with_place(spark.read.parquet(str(tmp_path / "s"))).orderBy("place").select("v", "place").collect()
    assert [r["place"] for r in placed] == list(range(1, 12_001))
    key = [(0, 0.0) if r["v"] is None else (2, 0.0) if r["v"] != r["v"] else (1, r["v"]) for r in placed]
    assert key == sorted(key)
    assert layout.write_clustered(rows.limit(0), str(tmp_path / "e"), ["v"]).count() == 0


def test_interleaved(spark):
    got = spark.range(64).select("id", layout.interleaved([F.col("id") % 8, F.floor(F.col("id") / 8)], 3).alias("z")).collect()
    for r in got:
        x, y = r["id"] % 8, r["id"] // 8
        assert r["z"] == sum(((x >> b & 1) << 2 * b) | ((y >> b & 1) << 2 * b + 1) for b in range(3))
