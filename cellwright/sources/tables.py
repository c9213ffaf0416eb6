"""Text, JSON and HTML sources as DataFrames; checks are empty-result assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated manifest with a header; lines that begin with # are remarks."""
    return spark.read.csv(path, sep="\t", comment="#", header=True)


def tile_list(spark: SparkSession, path: str) -> DataFrame:
    """(tile) of a text list; remarks and empty lines left out."""
    return tiles_of(spark.read.text(path))


def tiles_of(lines: DataFrame) -> DataFrame:
    return lines.where(~F.col("value").startswith("#")).select(F.trim("value").alias("tile")).where(F.col("tile").rlike(r"^h\d{2}v\d{2}$"))


def check_tile_count(lines: DataFrame) -> None:
    """Error if a header line '# tiles: n' names another number than there are."""
    said = lines.where(F.col("value").rlike(r"^#\s*tiles:\s*\d+")).select(F.regexp_extract("value", r"(\d+)", 1).cast("int")).first()
    n = tiles_of(lines).count()
    if said and said[0] != n:
        raise ValueError(f"list names {said[0]} tiles and holds {n}")


def stage_complete(listed: DataFrame, wanted: DataFrame, ok: tuple = ("loaded", "not at provider")) -> DataFrame:
    """Wanted tiles that the manifest (tile, state) does not prove; empty if the stage is complete."""
    return wanted.join(listed.where(F.col("state").isin(*ok)), "tile", "left_anti")


def tile_states(parts: dict[str, DataFrame]) -> DataFrame:
    """(tile, state): union of tile sets, each tile in exactly one; conflicts get state 'conflict'."""
    out = None
    for state, tiles in parts.items():
        one = tiles.select("tile", F.lit(state).alias("state"))
        out = one if out is None else out.union(one)
    return out.groupBy("tile").agg(F.when(F.count_distinct("state") == 1, F.first("state")).otherwise("conflict").alias("state"))


def semicolon_series(spark: SparkSession, path: str) -> DataFrame:
    """(month, value) of lines year;month;decimal year;value;...; negative values are missing."""
    return series_of(spark.read.text(path))


def series_of(lines: DataFrame) -> DataFrame:
    p = F.split("value", ";")
    rows = lines.where(F.size(p) >= 4).select(F.trim(p[0]).cast("int").alias("y"), F.trim(p[1]).cast("int").alias("m"), F.trim(p[3]).cast("double").alias("v"))
    return rows.where("v >= 0").select(F.make_date("y", "m", F.lit(1)).alias("month"), F.col("v").alias("value"))


def html_table(pages: DataFrame, page: str = "value", key: tuple = ()) -> DataFrame:
    """(key..., row, cells): the rows of all tables of a page, cells stripped of markup."""
    rows = F.regexp_extract_all(F.col(page), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    each = pages.select(*key, F.posexplode(rows).alias("row", "html"))
    cells = F.regexp_extract_all("html", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))
    bare = F.transform(cells, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", ""), r"\s+", " ")))
    return each.select(*key, "row", bare.alias("cells"))


def links(pages: DataFrame, page: str = "html", key: tuple = ("page_id",)) -> DataFrame:
    """(key..., position, href, text) of the links of a page."""
    found = F.regexp_extract_all(F.col(page), F.lit(r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>'), F.lit(1))
    text = F.regexp_extract_all(F.col(page), F.lit(r'(?is)<a\s[^>]*href="[^"]*"[^>]*>(.*?)</a>'), F.lit(1))
    return pages.select(*key, F.posexplode(F.arrays_zip(found.alias("href"), text.alias("text"))).alias("position", "a")).select(*key, "position", "a.href", "a.text")


def json_counters(spark: SparkSession, path: str) -> DataFrame:
    """(day, counters) of a document {"days": {day: {name: n}}}."""
    raw = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "days map<string, map<string, bigint>>")
    return raw.select(F.explode(parsed["days"]).alias("day", "counters"))


def latest_complete(folders: DataFrame, name: str = "name", has_manifest: str = "has_manifest") -> DataFrame:
    """Newest folder 'YYYYMMDDTHHMMSSZ' that has a manifest, one row."""
    return folders.where(F.col(name).rlike(r"^\d{8}T\d{6}Z$") & F.col(has_manifest)).agg(F.max(name).alias(name))


def verified(files: DataFrame, listed: DataFrame, path: str = "path", algorithm: str = "sha256") -> DataFrame:
    """Binary files (path, content) whose checksum is the listed one (path, checksum)."""
    sum_ = F.sha2("content", 256) if algorithm == "sha256" else F.md5("content")
    return files.withColumn("checksum", sum_).join(listed.select(path, "checksum"), [path, "checksum"], "left_semi")


# --- run log: lines to state, last event wins

LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) UTC\s+(.*)$"
MONTH = r"^(\d{4}-\d{2}): "


def log_events(lines: DataFrame, line: str = "value", order: str = "n") -> DataFrame:
    """(n, at, month, kind, text) of log lines; lines without a time stamp belong to the one before and are left out."""
    rows = lines.where(F.col(line).rlike(LINE)).select(F.col(order).alias("n"), F.to_timestamp(F.regexp_extract(line, LINE, 1)).alias("at"), F.regexp_extract(line, LINE, 2).alias("text"))
    t = F.col("text")
    kind = (
        F.when(t.startswith("run started"), "run_started").when(t.startswith("run finished"), "run_finished").when(t.startswith("run ended with open months"), "run_open")
        .when(t.startswith("ERROR") | t.startswith("ABORT"), "error").when(t.rlike(MONTH + "start"), "start").when(t.rlike(MONTH + r"\d+ tiles reported"), "reported")
        .when(t.rlike(MONTH + "download finished"), "downloaded").when(t.rlike(MONTH + "deferred"), "deferred").when(t.rlike(MONTH + "finished"), "finished").when(t.rlike(MONTH + "waiting for login"), "waiting")
        .otherwise("other")
    )
    return rows.select("n", "at", F.nullif(F.regexp_extract("text", MONTH, 1), F.lit("")).alias("month"), kind.alias("kind"), "text")


def log_state(events: DataFrame) -> DataFrame:
    """Per month: its last state, when, and the reported tiles; the newest line wins."""
    m = events.where(F.col("month").isNotNull() & (F.col("kind") != "other"))
    reported = F.when(F.col("kind") == "reported", F.regexp_extract("text", r"(\d+) tiles", 1).cast("int"))
    return m.groupBy("month").agg(F.max_by("kind", "n").alias("state"), F.max_by("at", "n").alias("at"), F.max_by(reported, F.when(reported.isNotNull(), F.col("n"))).alias("tiles"), F.count_if(F.col("kind") == "deferred").alias("deferrals"))


def run_summary(events: DataFrame) -> DataFrame:
    """One row for the newest run: start, end state, errors since, months finished and still open."""
    started = events.where("kind = 'run_started'").agg(F.max("n").alias("n0"), F.max_by("at", "n").alias("started"))
    since = events.crossJoin(F.broadcast(started)).where(F.col("n0").isNull() | (F.col("n") >= F.col("n0")))
    return since.groupBy("started").agg(F.bool_or(F.col("kind") == "run_finished").alias("finished"), F.bool_or(F.col("kind") == "run_open").alias("open_months"), F.count_if(F.col("kind") == "error").alias("errors"), F.max("at").alias("last_line"))


def running_state(events: DataFrame) -> DataFrame:
    """Each line with the month that was being worked on, carried forward until it ends."""
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)  # a log is one short file
    begins = F.when(F.col("kind") == "start", F.col("month")).when(F.col("kind").isin("finished", "deferred", "run_started"), F.lit(""))
    return events.withColumn("current", F.nullif(F.last(begins, ignorenulls=True).over(w), F.lit("")))


def work_rank(first: str, priority: list[str]) -> list[Column]:
    """Sort key of months ('YYYY-MM'): the priority list, then from ``first`` on, then the earlier ones."""
    place: Column = F.array_position(F.array(*[F.lit(p) for p in priority]).cast("array<string>"), F.col("month"))
    return [F.when(place > 0, 0).when(F.col("month") >= first, 1).otherwise(2), place, F.col("month")]


def work_order(months: DataFrame, first: str, priority: list[str]) -> DataFrame:
    """Months in the order of work."""
    return months.orderBy(*work_rank(first, priority))


def projection(rows: DataFrame, open_months: int, raw_bytes: float) -> DataFrame:
    """(mb_s) of past months to the span of hours for the open ones."""
    return rows.agg((open_months * raw_bytes / 1e6 / F.max("mb_s") / 3600).alias("hours_best"), (open_months * raw_bytes / 1e6 / F.min("mb_s") / 3600).alias("hours_worst"))
