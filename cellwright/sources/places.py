"""Folders and files that driver and tasks share, on any of Spark's stores."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local master may name none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        root = _LOCAL.get(app) or _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="cellwright-places-", dir="/tmp"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def handle(spark: SparkSession, path: str):
    """File system and path object, through Spark's own configuration."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def opened(path: str):
    """(file system, root) that a task opens by itself."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def create_once(spark: SparkSession, path: str, content: dict) -> bool:
    """Make a JSON file whole and only if nobody has made it; whether it was this caller.

    The content is written aside and moved into place in one step that fails
    when the name is taken: a hard link on local disks, a rename elsewhere.
    """
    fs, place = handle(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if fs.getScheme() == "file":
        nio, paths = spark._jvm.java.nio.file.Files, spark._jvm.java.nio.file.Paths
        try:
            nio.createLink(paths.get(place.toUri().getPath(), spark._sc._gateway.new_array(spark._jvm.java.lang.String, 0)), paths.get(aside.toUri().getPath(), spark._sc._gateway.new_array(spark._jvm.java.lang.String, 0)))
            done = True
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            done = False
    else:
        done = not fs.exists(place) and bool(fs.rename(aside, place))
    if fs.exists(aside):
        fs.delete(aside, False)
    return done


def read_json(spark: SparkSession, path: str) -> dict:
    fs, place = handle(spark, path)
    stream = fs.open(place)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()
