"""Bootstrap draws by counter: every draw is a hash of (seed, replicate, number of the draw).

Nothing is drawn on the driver and no table of draws is sent around: the counters
are a range that Spark splits, a task turns each into a place, and places meet the
units they stand for in a shuffle. Any task can repeat any draw by itself, so a
lost executor changes nothing, and results do not depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Draws of one replicate that a task expands at once.
RUN = 4096


def uniform(seed: int, *counters: Column | str) -> Column:
    """Uniform in [0, 1) of 53 bits from a seed and counters."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in counters]), 11) / float(1 << 53)


def drawn(units: DataFrame, unit: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, unit, times): in each replicate as many draws with replacement as there are different units.

    Units are numbered in their order; there is one row a unit, not a row of data.
    """
    names = units.select(unit).distinct()
    n = names.count()
    numbered = names.select(unit, (F.row_number().over(Window.orderBy(unit)) - 1).cast("long").alias("place"))
    draws = units.sparkSession.range(replicates * n)
    replicate, draw = (F.col("id") / max(n, 1)).cast("long"), F.col("id") % max(n, 1)
    draws = draws.select(replicate.cast("int").alias("replicate"), F.least(F.floor(uniform(seed, replicate, draw) * n), F.lit(max(n - 1, 0))).cast("long").alias("place"))
    return draws.groupBy("replicate", "place").agg(F.count("*").alias("times")).join(numbered, "place").select("replicate", unit, "times")


def drawn_by(units: DataFrame, by: list[str], unit: str, replicates: int, seed: int) -> DataFrame:
    """(by..., replicate, unit, times): the draws of ``drawn`` in every group of units, all groups at once.

    Each group has the draws that ``drawn`` gives for its units alone. Replicates and runs of
    ``RUN`` draws become rows before the draws do, so no row holds more than one run.
    """
    names = units.select(*by, unit).distinct()
    numbered = names.withColumn("place", (F.row_number().over(Window.partitionBy(*by).orderBy(unit)) - 1).cast("long"))
    runs = names.groupBy(*by).agg(F.count("*").alias("n"))
    runs = runs.select(*by, "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")) if replicates else runs.withColumn("replicate", F.lit(0)).where("false")
    runs = runs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN).cast("long"))).alias("run"))
    first, last = F.col("run") * RUN, F.least(F.col("run") * RUN + RUN, F.col("n")) - 1
    draws = runs.select(*by, "n", "replicate", F.explode(F.sequence(first, last)).alias("draw"))
    place = F.least(F.floor(uniform(seed, F.col("replicate").cast("long"), F.col("draw")) * F.col("n")), F.col("n") - 1).cast("long")
    times = draws.groupBy(*by, "replicate", place.alias("place")).agg(F.count("*").alias("times"))
    return times.join(numbered, [*by, "place"]).select(*by, "replicate", unit, "times")
