"""Connected groups of marked grid cells: eight neighbours, columns wrap, rows do not."""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OFFSETS = [(0, 1), (1, 0), (1, 1), (1, -1)]
#: Side of the blocks of cells that are labelled in one task.
BLOCK = 128


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder of the session; only a local master may name none."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="cellwright-", dir="/tmp"))
    return df.checkpoint()


def neighbour_pairs(cells: DataFrame, cols: int, by: list[str], wrap: bool = True) -> DataFrame:
    """(by..., a, b): pairs of neighbouring cells, each once; a and b are row * cols + col."""
    shifts = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in OFFSETS])).alias("s")
    moved = cells.select(*by, "row", "col", shifts)
    col = F.pmod(F.col("col") + F.col("s.dx"), F.lit(cols)) if wrap else F.col("col") + F.col("s.dx")
    here = moved.select(*by, (F.col("row").cast("long") * cols + F.col("col")).alias("a"), (F.col("row") + F.col("s.dy")).alias("r"), col.alias("c"))
    if not wrap:
        here = here.where(F.col("c").between(0, cols - 1))
    here = here.select(*by, "a", (F.col("r").cast("long") * cols + F.col("c")).alias("b"))
    there = cells.select(*by, (F.col("row").cast("long") * cols + F.col("col")).alias("b"))
    pairs = here.join(there, [*by, "b"]).where("a <> b")
    return pairs.select(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def local_labels(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Place of the first cell, in row-major order, of each cell's group; cells come in that order and do not wrap."""
    width = int(col.max()) + 2 if len(col) else 1
    at = row * width + col
    here, there = [], []
    for dy, dx in OFFSETS:
        wanted = at + dy * width + dx
        k = np.minimum(np.searchsorted(at, wanted), len(at) - 1)
        met = np.flatnonzero((at[k] == wanted) & (col + dx >= 0))
        here.append(met)
        there.append(k[met])
    a, b = np.concatenate(here), np.concatenate(there)
    label = np.arange(len(at))
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def label_blocks(cells: DataFrame, cols: int, by: list[str], size: int) -> DataFrame:
    """(by..., node, label): groups inside blocks of size x size cells, each block in one task; label is the smallest node."""
    nodes = cells.select(*by, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    keyed = nodes.distinct().withColumns({"__r": F.floor(F.col("row") / size), "__c": F.floor(F.col("col") / size)})
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema if f.name in by)

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"], ignore_index=True)
        row, col = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        node = row * cols + col
        own = local_labels(row - row.min(), col - col.min())
        return pdf[by].assign(node=node, label=node[own])

    return keyed.groupBy(*by, "__r", "__c").applyInPandas(label, f"{keys}{', ' if keys else ''}node long, label long")


def border_edges(cells: DataFrame, labels: DataFrame, cols: int, by: list[str], size: int, wrap: bool) -> DataFrame:
    """(by..., node, next), both ways: labels of neighbouring cells that lie in different blocks or meet across the wrap."""

    def last(c: str) -> Column:
        return F.col(c) % size

    rim = last("row").isin(0, size - 1) | last("col").isin(0, size - 1) | F.col("col").isin(0, cols - 1)
    pairs = neighbour_pairs(cells.select(*by, "row", "col").where(rim).distinct(), cols, by, wrap)

    def place(c: str) -> tuple[Column, Column]:
        return F.floor(F.col(c) / cols), F.col(c) % cols

    (ra, ca), (rb, cb) = place("a"), place("b")
    apart = (F.floor(ra / size) != F.floor(rb / size)) | (F.floor(ca / size) != F.floor(cb / size)) | (F.abs(ca - cb) > 1)
    pairs = pairs.where(apart)
    for end in ("a", "b"):
        pairs = pairs.join(labels.select(*by, F.col("node").alias(end), F.col("label").alias(f"l{end}")), [*by, end])
    met = pairs.where("la <> lb").select(*by, F.col("la").alias("node"), F.col("lb").alias("next"))
    return met.union(met.select(*by, "next", "node")).distinct()


def spread_labels(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by..., node, root): smallest node that edges reach, by alternating steps to the smallest neighbour and to the neighbour's own label."""
    labels = edges.select(*by, "node").distinct().withColumn("root", F.col("node"))
    while True:
        seen = labels.select(*by, F.col("node").alias("next"), F.col("root").alias("near"))
        low = edges.join(seen, [*by, "next"]).groupBy(*by, "node").agg(F.min("near").alias("near"))
        step = labels.join(low, [*by, "node"], "left").select(*by, "node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        up = step.select(*by, F.col("node").alias("root"), F.col("root").alias("top"))
        moved = written(step.join(up, [*by, "root"], "left").select(*by, "node", "old", F.least("root", F.coalesce("top", "root")).alias("root")))
        labels = moved.drop("old")
        if moved.where("root <> old").isEmpty():
            return labels


def label_components(cells: DataFrame, cols: int, by: list[str] = (), wrap: bool = True, size: int = BLOCK) -> DataFrame:
    """Add ``root``, the smallest row-major number in the cell's group, within each ``by``.

    Two levels: groups are labelled inside blocks of cells first, each block in
    one task; only labels that meet at the borders of blocks are then merged in
    rounds over the cluster, so rounds move some border labels and never cells.
    """
    by, cells = list(by), written(cells)
    labels = written(label_blocks(cells, cols, by, size))
    edges = written(border_edges(cells, labels, cols, by, size, wrap))
    if not edges.isEmpty():
        roots = spread_labels(edges, by).withColumnRenamed("node", "label")
        labels = labels.join(roots, [*by, "label"], "left").select(*by, "node", F.coalesce("root", "label").alias("label"))
    keyed = cells.withColumn("node", F.col("row").cast("long") * cols + F.col("col"))
    return keyed.join(labels.withColumnRenamed("label", "root"), [*by, "node"]).drop("node")


def number_groups(labelled: DataFrame, by: list[str], min_cells: int) -> DataFrame:
    """Add ``size`` and ``number``: 1, 2, ... over the groups of enough cells by smallest root; else 0."""
    sizes = labelled.groupBy(*by, "root").agg(F.count("*").alias("size"))
    order = Window.partitionBy(*by).orderBy("root") if by else Window.orderBy("root")
    big = sizes.where(F.col("size") >= min_cells).withColumn("number", F.row_number().over(order)).select(*by, "root", "number")
    return labelled.join(sizes, [*by, "root"]).join(big, [*by, "root"], "left").withColumn("number", F.coalesce("number", F.lit(0)))
