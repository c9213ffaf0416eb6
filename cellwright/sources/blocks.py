"""Work in blocks that survives lost tasks: a writer with a ledger, no result while a block is missing.

``fetched`` asks only for blocks that the ledger lacks. Each block's rows become
one file; when it is complete its ledger entry appears under the block's name, so
a task that dies loses the block it was at and nothing else, and a block written
twice by speculative tasks counts once. ``commit`` publishes the list of files
only when every wanted block is in the ledger; readers see nothing before.

Defined cases: a block without rows is finished with an empty file; a block that
is not wanted is an error; a second run after the result is published changes
nothing; a null block is an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .places import create_once, handle, opened, read_json

FORMAT = "cellwright_blocks"
#: Marks the row that says a block is complete.
END = "__end"


class MissingBlocks(RuntimeError):
    """A result was asked for while blocks are missing."""


@dataclass
class Finished(WriterCommitMessage):
    blocks: list[str]


class BlockWriter(DataSourceWriter):
    """Writes runs of rows of one block; runs end with a row that has ``END`` set."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path, [f.name for f in schema.fields]

    def write(self, iterator: Iterator) -> Finished:
        import pyarrow as pa
        from pyarrow import parquet

        fs, root = opened(self.path)
        fields = [n for n in self.names if n not in ("block", END)]
        rows: list[tuple] = []
        blocks, at = [], None
        for row in iterator:
            if row["block"] is None or at is not None and row["block"] != at:
                raise ValueError(f"rows of block {row['block']!r} before the end of block {at!r}")
            at = row["block"]
            if not row[END]:
                rows.append(tuple(row[n] for n in fields))
                continue
            name = f"files/{at}-{uuid.uuid4().hex[:8]}.parquet"
            table = pa.table({"block": [at] * len(rows), **{n: [r[k] for r in rows] for k, n in enumerate(fields)}})
            with fs.open_output_stream(f"{root}/{name}") as out:
                parquet.write_table(table, out)
            self._enter(fs, f"{root}/ledger/{at}.json", {"block": at, "file": name, "rows": len(rows)})
            blocks.append(at)
            rows, at = [], None
        return Finished(blocks)

    @staticmethod
    def _enter(fs, path: str, entry: dict) -> None:
        """One entry a block: the last complete file is the one that counts."""
        aside = f"{path}.{uuid.uuid4().hex[:8]}"
        with fs.open_output_stream(aside) as out:
            out.write(json.dumps(entry).encode())
        fs.move(aside, path)

    def commit(self, messages: list) -> None:
        """The tasks are done; whether the result is whole is for ``finish`` to say."""

    def abort(self, messages: list) -> None:
        """Finished blocks stay in the ledger for the next run."""


class BlockSource(DataSource):
    """Python data source that only writes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "block string"

    def writer(self, schema: StructType, overwrite: bool) -> BlockWriter:
        return BlockWriter(self.options["path"], schema)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(block, file, rows) of the finished blocks."""
    fs, place = handle(spark, f"{path}/ledger")
    schema = "block string, file string, rows long"
    if not fs.exists(place) or not fs.listStatus(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{path}/ledger")


def missing(wanted: DataFrame, path: str) -> DataFrame:
    """Wanted blocks that no run has finished."""
    return wanted.join(ledger(wanted.sparkSession, path).select("block"), "block", "left_anti")


def fetched(wanted: DataFrame, fetch: Callable[[pd.Series], Iterable[pd.DataFrame]], schema: str, path: str) -> DataFrame:
    """Run ``fetch`` on each missing block (a row of ``wanted``), write what it yields, and return the whole result.

    A failing block fails the run after the others have been tried for as long as
    Spark retries; finished blocks are not asked for again.
    """
    spark = wanted.sparkSession
    if not _published(spark, path):
        for part in ("files", "ledger"):
            fs, place = handle(spark, f"{path}/{part}")
            fs.mkdirs(place)
        names = [f.name for f in StructType.fromDDL(schema).fields]
        todo = missing(wanted, path)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for _, asked in pdf.iterrows():
                    for got in fetch(asked):
                        yield got[names].assign(block=asked["block"]).assign(**{END: False})
                    yield pd.DataFrame({n: [None] for n in names}).assign(block=asked["block"]).assign(**{END: True})

        spark.dataSource.register(BlockSource)
        n = todo.count()
        if n:
            rows = todo.repartition(n, "block").mapInPandas(run, f"{schema}, block string, {END} boolean")
            rows.write.format(FORMAT).mode("append").option("path", path).save()
        finish(wanted, path)
    return result(spark, path)


def finish(wanted: DataFrame, path: str) -> None:
    """Publish the result; an error while a block is missing or one is there that nobody wanted."""
    spark = wanted.sparkSession
    left = missing(wanted, path).select("block").limit(5).collect()
    if left:
        raise MissingBlocks(f"{path}: no result yet, missing e.g. {[r[0] for r in left]}")
    extra = ledger(spark, path).join(wanted, "block", "left_anti").select("block").limit(5).collect()
    if extra:
        raise ValueError(f"{path}: blocks that nobody asked for, e.g. {[r[0] for r in extra]}")
    place = f"{path}/entries-{uuid.uuid4().hex[:8]}"
    ledger(spark, path).write.parquet(place)
    create_once(spark, f"{path}/result.json", {"entries": place.rpartition("/")[2]})


def _published(spark: SparkSession, path: str) -> bool:
    fs, place = handle(spark, f"{path}/result.json")
    return fs.exists(place)


def result(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all blocks, each from the one file that its ledger entry names."""
    if not _published(spark, path):
        raise MissingBlocks(f"{path}: no result is published")
    entries = spark.read.parquet(f"{path}/{read_json(spark, f'{path}/result.json')['entries']}")
    rows = spark.read.parquet(f"{path}/files")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"(files/[^/]+)$", 1)
    return rows.withColumn("__file", name).join(entries.select(F.col("file").alias("__file")), "__file", "left_semi").drop("__file")
