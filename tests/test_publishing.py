"""Publishing races, resumable blocks, scans with proof."""

import datetime
import os
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellwright.sources import blocks as B
from cellwright.sources import places, proof, sinks


def test_create_once(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda k: places.create_once(spark, f"{tmp_path}/one.json", {"by": k}), range(16)))
    assert sum(made) == 1 and places.read_json(spark, f"{tmp_path}/one.json") == {"by": made.index(True)}
    assert [n for n in os.listdir(tmp_path) if not n.endswith(".crc")] == ["one.json"]


def test_of_two_writers_one_fails_cleanly(spark, tmp_path):
    place = str(tmp_path / "set")
    sinks.publish_set({"a": spark.range(5)}, place)

    def write(n):
        try:
            sinks.publish_set({"a": spark.range(n)}, place, after=1)
            return n
        except sinks.Superseded:
            return None

    with ThreadPoolExecutor(2) as pool:
        won = [n for n in pool.map(write, (7, 9)) if n]
    assert len(won) == 1 and sinks.published(spark, place, "a").count() == won[0] and sinks.newest(spark, place) == 2
    assert len(os.listdir(tmp_path / "set" / "versions")) == 2  # the loser's files are gone
    with pytest.raises(sinks.Superseded):
        sinks.publish_set({"a": spark.range(1)}, place, after=1)
    sinks.publish_set({"a": spark.range(3)}, place)
    sinks.drop_versions(spark, place)
    assert sinks.published(spark, place, "a").count() == 3 and [n for n in os.listdir(tmp_path / "set" / "pointer") if not n.endswith(".crc")] == ["000000000003.json"]


def test_blocks_resume_after_a_killed_task(spark, tmp_path):
    path, calls = str(tmp_path / "work"), tmp_path / "calls"
    calls.mkdir()
    wanted = spark.createDataFrame([(f"b{k}", k) for k in range(6)], "block string, first int")

    def fetch(asked):
        k = int(asked["first"])
        (calls / f"{asked['block']}-{os.getpid()}-{datetime.datetime.now().timestamp()}").touch()
        yield pd.DataFrame({"cell": [2 * k], "value": [k / 2]})
        if k == 3 and not (calls / "mended").exists():
            os._exit(1)  # the worker dies in the middle of a block
        if k != 4:  # a block of one row
            yield pd.DataFrame({"cell": [2 * k + 1], "value": [None]})

    with pytest.raises(B.MissingBlocks):
        B.result(spark, path)
    with pytest.raises(Exception):
        B.fetched(wanted, fetch, "cell long, value double", path)
    with pytest.raises(B.MissingBlocks):
        B.result(spark, path)
    with pytest.raises(B.MissingBlocks):
        B.finish(wanted, path)
    done = {r["block"] for r in B.ledger(spark, path).collect()}
    assert "b3" not in done
    (calls / "mended").touch()
    before = len(os.listdir(calls))
    got = B.fetched(wanted, fetch, "cell long, value double", path)
    asked = {n.split("-")[0] for n in os.listdir(calls) if n != "mended"}
    assert len(os.listdir(calls)) - before == 6 - len(done) and asked == {f"b{k}" for k in range(6)}
    assert sorted((r["cell"], r["value"]) for r in got.where("value is not null").collect()) == [(2 * k, k / 2) for k in range(6)]
    assert got.count() == 11 == got.select("cell").distinct().count()
    assert B.fetched(wanted, None, "cell long, value double", path).count() == 11  # nothing is fetched again


def test_blocks_that_nobody_wants(spark, tmp_path):
    path = str(tmp_path / "work")
    wanted = spark.createDataFrame([("a",), ("b",)], "block string")
    empty = B.fetched(wanted, lambda asked: [], "cell long", path)
    assert empty.count() == 0 and B.ledger(spark, path).count() == 2
    with pytest.raises(ValueError):
        B.finish(wanted.limit(0), path)


@pytest.fixture
def cube(spark, tmp_path):
    rows = spark.range(60).select(F.make_date(F.lit(2020), (F.col("id") % 6 + 1).cast("int"), F.lit(1)).alias("month"), (F.col("id") / 6).cast("int").alias("cell"), F.rand(1).alias("x"))
    proof.write_proven(rows, f"{tmp_path}/cube", spark.createDataFrame([(datetime.date(2020, 2, 1), "being written")], "month date, state string"))
    return f"{tmp_path}/cube"


SCHEMA = "month date, cell int, x double"


def test_scan_prunes_months_and_needs_proof(spark, cube):
    got = proof.proven(spark, cube, SCHEMA)
    assert got.count() == 50 and got.where("month = date '2020-02-01'").count() == 0
    some = got.where("month >= date '2020-03-01' and month < date '2020-05-01' and cell > 2")
    assert some.rdd.getNumPartitions() == 2 and some.count() == 14 and some.columns == ["month", "cell", "x"]
    assert got.where("month in (date '2020-01-01', date '2020-06-01')").rdd.getNumPartitions() == 2

    def file_of(month):
        folder = f"{cube}/cells/month={month}"
        return folder, next(n for n in sorted(os.listdir(folder)) if n.endswith(".parquet"))

    folder, name = file_of("2020-05-01")
    data = open(f"{folder}/{name}", "rb").read()
    with open(f"{folder}/{name}", "wb") as f:
        f.write(data[:-1] + bytes([data[-1] ^ 1]))
    assert some.count() == 14  # a broken month outside the filters is never opened
    with pytest.raises(Exception, match=name):
        got.count()
    os.remove(f"{folder}/{name}")
    with pytest.raises(Exception, match="not on disk"):
        got.count()
    folder, _ = file_of("2020-03-01")
    open(f"{folder}/stray.parquet", "wb").write(data)
    with pytest.raises(Exception, match="stray.parquet is not in the manifest"):
        some.count()
