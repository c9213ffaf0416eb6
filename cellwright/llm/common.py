"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a lookup table is broadcast; beyond it a shuffle join is planned.
BROADCAST_ROWS = 100_000

_LOCAL: dict[str, str] = {}
#: Folders of the tables that ``staged`` has written and nobody has discarded, by the table.
_WRITTEN: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only on a local master without that setting (tests on one machine) a local
    folder is used, one for each application.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        root = _LOCAL.get(app) or _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="cellwright-shared-", dir="/tmp"))
    return f"{root.rstrip('/')}/tables"


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, in a folder for each value of ``by``, and read it again.

    The result no longer depends on the tasks that made it, so a lost executor
    costs a re-read, and row identifiers drawn before the write are fixed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def shared_path(table: DataFrame) -> str:
    """Where ``staged`` wrote a table, as a URI that tasks can open."""
    path = _WRITTEN[table]
    return path if "://" in path else f"file://{path.removeprefix('file:')}"


def passed_on(table: DataFrame, out: DataFrame) -> DataFrame:
    """``out``, which reads a table of ``staged`` and is discarded in its place."""
    if path := _WRITTEN.pop(table, None):
        _WRITTEN[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``staged`` returned, once nothing reads them any more."""
    for t in tables:
        if path := _WRITTEN.pop(t, None):
            place = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


#: Name of the key column that ``numbered`` adds.
ROW = "__cellwright_row"


def numbered(df: DataFrame, out: str = ROW) -> DataFrame:
    """Add a key of each row that is the same whenever the table is read: its file and place there.

    Rows that come from no Parquet file are written first.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return df.withColumn(out, place)
    except AnalysisException:
        return staged(df, "rows").withColumn(out, place)


def lookup(df: DataFrame, how_on, how: str = "left", rows: int | None = None, *, small: DataFrame) -> DataFrame:
    """Join a table of keys that is usually small.

    It is broadcast only when its counted rows stay within ``BROADCAST_ROWS``;
    otherwise Spark shuffles both sides and adaptive execution splits hot keys.
    """
    n = small.count() if rows is None else rows
    return df.join(F.broadcast(small) if n <= BROADCAST_ROWS else small, how_on, how)


def words(text) -> F.Column:
    """Array of the words of a text; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
