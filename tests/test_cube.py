"""Reader rules, synthetic cubes with known truth, components, sinks."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from cellwright.config import CubeFormatError, HoldOutLocked, LinkSettings, MinLengths, MonthNotFinished, Thresholds
from cellwright.operators import anomaly as AN
from cellwright.operators.breaks import models
from cellwright.operators.components import label_components
from cellwright.operators.crosssection import draws
from cellwright.sources import sinks
from cellwright.sources.cube import CubeReader, check_hold_out
from cellwright.sources.fetch import FetchError, catalogue, fetch_file, fetch_json, open_links
from cellwright.sources.synthetic import Event, synthetic_cube


@pytest.fixture(scope="module")
def cube(spark):
    events = (Event("2020-07", (10, 16), (20, 26), factor=0.3), Event("2020-07", (25, 30), (50, 56), factor=3.0))
    c, s = synthetic_cube(spark, last="2021-12", seed=1, events=events, unfinished=("2015-03",), half_written=("2016-03",))
    return c.persist(), s.persist()


def test_unfinished_months_are_errors(cube):
    r = CubeReader(*cube)
    assert r.read_months([(2020, 7), (2014, 1)]).select("ordinal").distinct().count() == 2
    with pytest.raises(MonthNotFinished, match="2015-03.*not loaded"):
        r.read_months([(2020, 7), (2015, 3)])
    assert r.read_finished(first="2015-03", last="2015-03").count() == 0
    assert r.finished_months().count() == 9 * 12 - 2
    with pytest.raises(CubeFormatError):
        CubeReader(cube[0].drop("row"), cube[1])


def test_hold_out():
    with pytest.raises(HoldOutLocked):
        check_hold_out([(2022, 12), (2023, 1)])
    with pytest.warns(UserWarning):
        check_hold_out([(2023, 1)], released=True)


def test_planted_events_are_found_and_nothing_else(cube):
    found = AN.detect(*cube, cols=80, first=(2020, 6), last=(2020, 8))
    events = found["events"].orderBy("nr").collect()
    july = [e for e in events if e["month"] == datetime.date(2020, 7, 1)]
    assert [e["direction"] for e in july] == ["rise", "decline"] and len(events) == 2
    assert july[0]["n_cells"] == 30 and july[1]["n_cells"] == 36
    assert july[0]["id"] == "light-2020-07-001"
    months = {r["month"].month: r["status"] for r in found["months"].collect()}
    assert months == {6: "scored", 7: "scored", 8: "scored"}


def test_a_month_is_not_in_its_own_baseline_and_later_years_do_not_matter(cube):
    c, s = cube
    base = AN.score_cells(c, s).where("month = date'2019-07-01'").select("row", "col", F.round("z", 9)).collect()
    later = c.withColumn("mean_obs", F.when(F.col("month") > "2019-07-01", F.col("mean_obs") * 100).otherwise(F.col("mean_obs")).cast("float"))
    again = AN.score_cells(later, s).where("month = date'2019-07-01'").select("row", "col", F.round("z", 9)).collect()
    assert sorted(base) == sorted(again)


def test_minimum_duration(spark):
    c, s = synthetic_cube(spark, rows=20, cols=30, last="2021-06", seed=2, events=(Event("2020-07", (5, 9), (5, 9), factor=4.0, months=2),))
    from dataclasses import replace

    two = replace(Thresholds(), min_months=2, pool_min_cells=50)
    got = AN.detect(c, s, 30, two, first=(2020, 6), last=(2020, 10))["events"].collect()
    assert [e["month"] for e in got] == [datetime.date(2020, 8, 1)]


def test_settings_are_checked():
    for bad in (lambda: Thresholds(z_min=9), lambda: MinLengths(mann_kendall=5), lambda: LinkSettings(distribution="x"), lambda: Thresholds(q=0)):
        with pytest.raises(ValueError):
            bad()


def test_components_wrap_and_long_groups(spark):
    r = random.Random(4)
    cells = {(0, c) for c in range(40)} | {(3, 0), (3, 39), (2, 38), (5, 5)} | {(k, k) for k in range(10, 30)} | {(r.randrange(40), r.randrange(40)) for _ in range(300)}
    df = spark.createDataFrame(sorted(cells), "row int, col int")
    got = {(x["row"], x["col"]): x["root"] for x in label_components(df, 40).collect()}
    seen = {}
    for start in sorted(cells):
        if start in seen:
            continue
        todo, root = [start], start[0] * 40 + start[1]
        while todo:
            y, x = todo.pop()
            if (y, x) in seen:
                continue
            seen[y, x] = root
            todo += [(y + a, (x + b) % 40) for a in (-1, 0, 1) for b in (-1, 0, 1) if (y + a, (x + b) % 40) in cells]
    assert got == seen


def test_month_writing(spark, tmp_path):
    w = sinks.CubeWriter(spark, str(tmp_path / "cube"), "2020-01", "2020-06")
    w.create()
    rows = spark.createDataFrame([(r, c, float(r + c)) for r in range(3) for c in range(3)], "row int, col int, x double")
    w.write_month(rows, 2020, 2)
    assert w.state(2020, 2) == 1 and w.cells().count() == 9
    with pytest.raises(sinks.MonthExists):
        w.write_month(rows, 2020, 2)
    with pytest.raises(ValueError):
        w.state(2021, 1)
    region = rows.where("row = 0").select("row", "col")
    w.write_month(rows.where("row = 0"), 2020, 3, 4)
    with pytest.raises(ValueError):
        w.merge_month(rows, region, 2020, 3)
    w.merge_month(rows.where("row > 0"), region, 2020, 3)
    assert w.state(2020, 3) == 1 and sinks.difference(spark.read.parquet(w.month_path(2020, 3)), rows).isEmpty()
    assert w.demote([(2020, 2), (2020, 4)]) == [(2020, 2)] and w.state(2020, 2) == 2
    w.mark_absent(2020, 5, {(2020, 5)})
    with pytest.raises(ValueError):
        w.mark_absent(2020, 6, {(2020, 5)})
    with pytest.raises(sinks.MonthExists):
        w.mark_absent(2020, 3, {(2020, 3)})
    assert {r["state"]: len(r["months"]) for r in w.months_by_state().collect()} == {0: 3, 1: 1, 2: 1, 5: 1}


def test_publish(spark, tmp_path):
    df = spark.range(10)
    assert sinks.publish(df, str(tmp_path / "t")).count() == 10
    assert sinks.publish(spark.range(3), str(tmp_path / "t")).count() == 3
    assert sinks.publish(spark.range(0), str(tmp_path / "t")).count() == 0


def test_a_failed_set_leaves_readers_on_the_old_tables(spark, tmp_path, monkeypatch):
    place = str(tmp_path / "set")
    with pytest.raises(ValueError):
        sinks.published(spark, place, "a")
    sinks.publish_set({"a": spark.range(5), "b": spark.range(6)}, place)
    broken = spark.range(8).select(F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        sinks.publish_set({"a": spark.range(7), "b": broken}, place)
    assert [sinks.published(spark, place, n).count() for n in ("a", "b")] == [5, 6]
    kept = sinks.fingerprint
    with monkeypatch.context() as m:
        # every look at the rows counts differently, as if the disk had changed them
        calls = iter(range(100))
        m.setattr(sinks, "fingerprint", lambda df: [(F.count(F.lit(1)) + next(calls)).alias("n"), kept(df)[1]])
        with pytest.raises(sinks.WriteMismatch):
            sinks.publish_set({"a": spark.range(9)}, place)
    assert sinks.published(spark, place, "a").count() == 5
    sinks.publish_set({"a": spark.range(2), "b": spark.range(3)}, place)
    sinks.drop_versions(spark, place)
    assert [sinks.published(spark, place, n).count() for n in ("a", "b")] == [2, 3] and len(list((tmp_path / "set" / "versions").iterdir())) == 1


def test_break_models_find_a_step():
    import numpy as np

    t = np.arange(80)
    y = 0.01 * t + 2.0 * (t >= 47) + np.random.default_rng(5).normal(0, 0.1, 80)
    got = models(t, y).set_index("model")
    assert got.loc["step", "k"] == 47 and abs(got.loc["step", "coefficient"] - 2) < 0.2
    assert got.loc["step", "bic"] < got.loc["kink", "bic"] and got.loc["step", "bic"] < got.loc["none", "bic"]


def test_draws_are_repeatable(spark):
    a, b = (sorted(draws(spark, 7, 5, 3).collect()) for _ in range(2))
    assert a == b and len(a) == 35


def test_fetching(tmp_path):
    tries = []

    def flaky(url):
        tries.append(url)
        if len(tries) < 3:
            raise OSError("503")
        return b'{"a": 1}'

    waits = []
    assert fetch_json("u", flaky, sleep=waits.append) == {"a": 1} and waits == [1.0, 2.0]
    with pytest.raises(FetchError):
        fetch_file("u", str(tmp_path / "f"), lambda u: b"")
    assert not (tmp_path / "f").exists()
    with pytest.raises(FetchError):
        catalogue("u", lambda u: b'{"hits": 3, "entries": []}')
    with pytest.raises(FetchError) as e:
        open_links("10/x", "me@here", lambda u: b"no json")
    assert "me@here" not in str(e.value)
