"""Spatial autocorrelation of cell values, from neighbour pairs as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import neighbour_pairs


def morans_i(values: DataFrame, cols: int, by: list[str], value: str = "x", wrap: bool = True) -> DataFrame:
    """Moran's I of each group: n, s0, i, expectation, variance and z under normality.

    Cells without neighbours count in n. All sums come from two joins of the
    edge table with the values; a constant group has no index.
    """
    rows = values.where(F.col(value).isNotNull())
    mean = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    cell = (F.col("row").cast("long") * cols + F.col("col")).alias("node")
    z = rows.join(mean, by).select(*by, "row", "col", cell, (F.col(value) - F.col("mean")).alias("z"))
    pairs = neighbour_pairs(z, cols, by, wrap)
    left = z.select(*by, F.col("node").alias("a"), F.col("z").alias("za"))
    right = z.select(*by, F.col("node").alias("b"), F.col("z").alias("zb"))
    cross = pairs.join(left, [*by, "a"]).join(right, [*by, "b"]).groupBy(*by).agg(F.sum(F.col("za") * F.col("zb")).alias("cross"), F.count("*").alias("edges"))
    degree = pairs.select(*by, F.explode(F.array("a", "b")).alias("node")).groupBy(*by, "node").agg(F.count("*").alias("d")).groupBy(*by).agg(F.sum(F.col("d") * F.col("d")).alias("d2"))
    square = z.groupBy(*by).agg(F.sum(F.col("z") * F.col("z")).alias("zz"))
    n, s0 = F.col("n").cast("double"), 2.0 * F.col("edges")
    e = -1 / (n - 1)
    # a symmetric 0/1 matrix: S1 = 2 S0, S2 = 4 sum of squared degrees
    var = (n * n * 2 * s0 - n * 4 * F.col("d2") + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - e * e
    met = mean.join(square, by).join(cross, by).join(degree, by).where((F.col("zz") > 0) & (F.col("n") > 2))
    i = (n / s0) * 2 * F.col("cross") / F.col("zz")
    out = met.select(*by, F.col("n"), s0.alias("s0"), i.alias("i"), e.alias("expectation"), var.alias("variance"))
    return out.withColumn("z", F.when(F.col("variance") > 0, (F.col("i") - F.col("expectation")) / F.sqrt("variance")))
