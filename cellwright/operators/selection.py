"""Exact percentiles of groups that no task could hold, by nested histograms.

A counting pass spreads each group over buckets that keep the order of its
values and finds the bucket of every wanted rank; the next pass spreads that
bucket's own range again. Each pass adds up in the tasks before its shuffle and
sends buckets, not values. When few values are left between the bounds of a rank,
they are counted by value, and a running count names the answer: a value that
holds a third of the group is one row there.

Groups of at most ``HELD`` values are left to Spark's own aggregate, which keeps
a group's distinct values in memory; the results are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import written

#: Values up to which a group's percentiles are taken in one aggregate.
HELD = 1_000_000
#: Buckets of a pass, values between two bounds that are counted one by one, passes at most.
BUCKETS, LISTED, PASSES = 4096, 100_000, 12
#: Rows up to which the table of bounds is broadcast to the values.
BROADCAST_ROWS = 100_000


def exact_percentiles(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]], held: int = HELD) -> DataFrame:
    """(keys..., one column for each name): percentiles with linear interpolation; null and NaN take no part.

    ``wanted``: name to (value, share). A group without values has null; groups
    are those of ``rows``. Null keys form a group.
    """
    values = [F.struct(F.lit(name).alias("name"), F.nanvl(x.cast("double"), F.lit(None)).alias("x")) for name, (x, _) in wanted.items()]
    plain = rows.select(*keys, *[v["x"].alias(f"__{n}") for v, n in zip(values, wanted)])
    # written once: the rows behind it are counted and read again by every pass
    plain = written(plain)
    largest = plain.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= held:
        return plain.groupBy(*keys).agg(*[F.percentile(f"__{n}", p).alias(n) for n, (_, p) in wanted.items()])
    pairs = F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"__{n}").alias("x")) for n in wanted]))
    long = plain.select(*keys, pairs).where(F.col("x").isNotNull())
    found = ranked_values(long, [*keys, "name"], {n: p for n, (_, p) in wanted.items()})
    wide = [F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in wanted]
    # groups without any value are there too
    return _same(plain.select(*keys).distinct(), found.groupBy(*keys).agg(*wide), keys, "left")


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null equal to null; the right keys go. Right is broadcast while it is small."""
    other = right.withColumnsRenamed({k: f"__{k}_" for k in keys})
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__{k}_"))
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        other = F.broadcast(other)
    return left.join(other, on, how).drop(*[f"__{k}_" for k in keys])


def _signed_octaves() -> Column:
    """Bucket that keeps the order of all doubles: sixteen to an octave, both signs."""
    size = F.floor(F.log2(F.abs("x")) * 16) + 17_600
    return F.when(F.col("x") == 0, F.lit(0)).otherwise(F.signum("x") * size).cast("long")


def _within_bounds() -> Column:
    """Bucket by equal parts of the range between the bounds."""
    return F.least(F.lit(BUCKETS - 1), F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * BUCKETS)).cast("long")


def ranked_values(long: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """(keys..., value) for rows (keys..., x); ``shares`` by the last key, which names the percentile."""
    totals = written(long.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")))
    share = F.create_map(*[F.lit(v) for item in shares.items() for v in item])[F.col(keys[-1])]
    totals = totals.withColumn("at", share * (F.col("n") - 1))
    ranks = F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank")
    bounds = written(totals.select(*keys, ranks, "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")))
    by, own = [*keys, "rank"], Window.partitionBy(*keys, "rank")
    for level in range(PASSES):
        wide = (F.col("inside") > LISTED) & (F.col("low") < F.col("high"))
        open_ = bounds.where(wide)
        if open_.isEmpty():
            break
        met = _same(long, open_, keys).where(F.col("x").between(F.col("low"), F.col("high")))
        part = _signed_octaves() if level == 0 else _within_bounds()
        counts = met.groupBy(*by, "below", part.alias("part")).agg(F.count("*").alias("c"), F.min("x").alias("low"), F.max("x").alias("high"))
        counts = counts.withColumn("upto", F.col("below") + F.sum("c").over(own.orderBy("part")))
        here = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c"))
        narrowed = counts.where(here).select(*by, "low", "high", (F.col("upto") - F.col("c")).alias("below"), F.col("c").alias("inside"))
        bounds = written(bounds.where(~wide).unionByName(narrowed))
    met = _same(long, bounds.where("low < high"), keys).where(F.col("x").between(F.col("low"), F.col("high")))
    each = met.groupBy(*by, "below", "x").agg(F.count("*").alias("c"))
    each = each.withColumn("upto", F.col("below") + F.sum("c").over(own.orderBy("x")))
    hit = each.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c"))).select(*by, "x")
    hit = hit.unionByName(bounds.where("low = high").select(*by, F.col("low").alias("x")))
    ends = hit.groupBy(*keys).agg(F.min_by("x", "rank").alias("a"), F.max_by("x", "rank").alias("b"))
    whole = _same(totals.select(*keys, "at"), ends, keys)
    part = F.col("at") - F.floor("at")
    # the form of the built-in aggregate: both ends weighed by their distance
    value = F.when((part == 0) | (F.col("a") == F.col("b")), F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b"))
    return whole.select(*keys, value.alias("value"))


def with_percentiles(agg: DataFrame, rows: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]], held: int = HELD) -> DataFrame:
    """Add exact percentiles of each group of ``rows`` to a table with one row a group."""
    return _same(agg, exact_percentiles(rows, keys, wanted, held), keys, "left")
