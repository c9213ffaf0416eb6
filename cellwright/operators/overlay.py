"""Overlay of polygons held as a table of edges: common areas, mutual duplicates, and who owns what where shapes overlap.

A shape is any number of closed rings of edges (shape, x1, y1, x2, y2), outer
rings one way round and holes the other. Nothing is a geometry object: candidate
pairs meet in blocks of their boxes, edges in vertical strips, and a common area
is a sum over pairs of edges of the signed area below both.

Edges without length in x add nothing. Rows with a null coordinate or shape are
left out; a shape without area meets nobody; repeated shapes are separate keys.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import written
from .geometry import boxes_to_blocks

EDGE = ("x1", "y1", "x2", "y2")


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that must not be broadcast.

    Rows per shape, edge and strip are many more than the file sizes that the
    planner goes by let it expect, and a broadcast is built in the driver.
    """
    return df.hint("merge")


def shapes_of(edges: DataFrame) -> DataFrame:
    """(shape, west, south, east, north, area, turn, cx, cy, blur): box, area, direction and centre of gravity of each shape.

    ``blur`` bounds the rounding error of the centre.
    """
    x1, y1, x2, y2 = (F.col(c) for c in EDGE)
    cross = x1 * y2 - x2 * y1
    reach = F.greatest(F.abs(x1 + x2), F.abs(y1 + y2)) * (F.abs(x1 * y2) + F.abs(x2 * y1))
    got = edges.dropna(subset=["shape", *EDGE]).groupBy("shape").agg(
        F.min(F.least("x1", "x2")).alias("west"), F.min(F.least("y1", "y2")).alias("south"), F.max(F.greatest("x1", "x2")).alias("east"), F.max(F.greatest("y1", "y2")).alias("north"), (F.sum(cross) / 2).alias("signed"),
        F.sum((x1 + x2) * cross).alias("mx"), F.sum((y1 + y2) * cross).alias("my"), ((F.count("*") + 8) * F.sum(reach) * 1e-15).alias("error"),
    )
    centre = [(F.col(m) / (6 * F.col("signed"))).alias(c) for m, c in (("mx", "cx"), ("my", "cy"))]
    return got.where("signed <> 0").select("shape", "west", "south", "east", "north", F.abs("signed").alias("area"), F.signum("signed").alias("turn"), *centre, (F.col("error") / F.abs("signed")).alias("blur"))


def cores(shapes: DataFrame, least_share: float) -> DataFrame:
    """Shapes with their boxes cut to where the centre of a part of at least that share can lie.

    A part's centre is off the whole one's by the share left out times the box's
    side at most. The centre of what two shapes have in common lies in the cores
    of both, so cores that do not meet belong to no mutual duplicates.
    """
    out = {}
    for low, high, c in (("west", "east", "cx"), ("south", "north", "cy")):
        off = (1 - least_share + 1e-9) * (F.col(high) - F.col(low)) + F.col("blur")
        out |= {low: F.greatest(F.col(low), F.col(c) - off), high: F.least(F.col(high), F.col(c) + off)}
    return shapes.withColumns(out)


def candidate_pairs(shapes: DataFrame, block: float, least_share: float = 0.0) -> DataFrame:
    """(a, b) with a < b whose boxes overlap; with a least share only those whose areas and centres allow it both ways.

    Areas are banded by the share, so shapes of very different size in one block
    are not even compared. A pair that shares several blocks is taken in the one
    that holds the lower left corner of what its boxes share.
    """
    sides = []
    if least_share > 0:
        band = F.floor(F.log("area") / -np.log(min(least_share, 1 - 1e-9)))
        shapes = cores(shapes, least_share).withColumn("band", band)
        block = block * max(2 * (1 - least_share), 1e-3)
    for end in ("a", "b"):
        cols = [F.col(c).alias(f"{c}_{end}") for c in ("shape", "west", "south", "east", "north", "area")]
        side = boxes_to_blocks(shapes, block)
        if least_share > 0:
            near = F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)) if end == "b" else F.col("band")
            side = side.withColumn("key", near)
        else:
            side = side.withColumn("key", F.lit(0))
        sides.append(side.select(F.col("bx"), F.col("by"), "key", *cols))
    met = shuffled(sides[0]).join(sides[1], ["bx", "by", "key"]).where("shape_a < shape_b")
    met = met.where(F.col("bx") == F.floor(F.greatest("west_a", "west_b") / block)).where(F.col("by") == F.floor(F.greatest("south_a", "south_b") / block))
    if least_share > 0:
        met = met.where("west_a <= east_b and west_b <= east_a and south_a <= north_b and south_b <= north_a")
        met = met.where((F.least("area_a", "area_b") >= least_share * F.greatest("area_a", "area_b") * (1 - 1e-9)))
    else:
        met = met.where("west_a < east_b and west_b < east_a and south_a < north_b and south_b < north_a")
    return met.select(F.col("shape_a").alias("a"), F.col("shape_b").alias("b"), "area_a", "area_b")


def edge_strips(edges: DataFrame, strip: float) -> DataFrame:
    """Edges as lines over x, a row for each vertical strip they cross: strip, from, to, slope, height at 0, way."""
    e = edges.dropna(subset=["shape", *EDGE]).where("x1 <> x2").withColumns({"lo": F.least("x1", "x2"), "hi": F.greatest("x1", "x2"), "way": F.signum(F.col("x1") - F.col("x2")), "m": (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))})
    e = e.withColumn("strip", F.explode(F.sequence(F.floor(F.col("lo") / strip), F.floor(F.col("hi") / strip))))
    e = e.withColumns({"lo": F.greatest("lo", F.col("strip") * strip), "hi": F.least("hi", (F.col("strip") + 1) * strip)})
    return e.where("lo < hi").select("shape", "strip", "lo", "hi", "m", (F.col("y1") - F.col("m") * F.col("x1")).alias("c"), "way")


def common_areas(edges: DataFrame, pairs: DataFrame, shapes: DataFrame, strip: float) -> DataFrame:
    """(a, b, common): area that both shapes of each pair cover.

    The sum over edge pairs of the area below both edges, over the x they share,
    with the edges' directions as signs; two edges that cross are integrated as
    the lower one on either side of the crossing.
    """
    lines = edge_strips(edges, strip)
    turns = shapes.select("shape", "turn", "south")
    pairs = pairs.select("a", "b")
    for end in ("a", "b"):
        pairs = pairs.join(shuffled(turns.select(F.col("shape").alias(end), F.col("turn").alias(f"turn_{end}"), F.col("south").alias(f"south_{end}"))), end)
    one, two = (lines.select(F.col("shape").alias(k), "strip", *[F.col(c).alias(f"{c}_{k}") for c in ("lo", "hi", "m", "c", "way")]) for k in ("a", "b"))
    met = pairs.join(shuffled(one), "a").join(shuffled(two), ["b", "strip"])
    met = met.withColumns({"lo": F.greatest("lo_a", "lo_b"), "hi": F.least("hi_a", "hi_b"), "ground": F.least("south_a", "south_b")}).where("lo < hi")

    def height(k: str, x: str) -> Column:
        return F.col(f"m_{k}") * F.col(x) + F.col(f"c_{k}") - F.col("ground")

    width = F.col("hi") - F.col("lo")
    da, db = height("a", "lo") - height("b", "lo"), height("a", "hi") - height("b", "hi")
    both = (height("a", "lo") + height("a", "hi") + height("b", "lo") + height("b", "hi")) / 2
    apart = F.when(da * db >= 0, (F.abs(da) + F.abs(db)) / 2).otherwise((da * da + db * db) / (2 * (F.abs(da) + F.abs(db))))
    signed = F.col("way_a") * F.col("way_b") * F.col("turn_a") * F.col("turn_b") * width * (both - apart) / 2
    return met.groupBy("a", "b").agg(F.sum(signed).alias("common"))


def mutual_duplicates(edges: DataFrame, share: float = 0.95, block: float = 5.0, strip: float = 1.0) -> DataFrame:
    """(a, b, area_a, area_b, common): pairs whose common area is at least ``share`` of either."""
    shapes = written(shapes_of(edges))
    pairs = written(candidate_pairs(shapes, block, share))
    common = common_areas(edges, pairs, shapes, strip)
    both = pairs.join(shuffled(common), ["a", "b"])
    return both.where((F.col("common") >= share * F.col("area_a")) & (F.col("common") >= share * F.col("area_b")))


def overlaps(edges: DataFrame, block: float = 5.0, strip: float = 1.0, least: float = 1e-9) -> DataFrame:
    """(low, high): pairs that share area; ``low`` comes first, by area, then by name."""
    shapes = written(shapes_of(edges))
    pairs = written(candidate_pairs(shapes, block))
    common = pairs.join(shuffled(common_areas(edges, pairs, shapes, strip)), ["a", "b"]).where(F.col("common") > least * F.least("area_a", "area_b"))
    first = (F.col("area_a") < F.col("area_b")) | ((F.col("area_a") == F.col("area_b")) & (F.col("a") < F.col("b")))
    return common.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("low"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("high"))


def priority_rounds(shapes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(shape, round): when each shape can be settled, all shapes of a round at once.

    In every round the shapes settle that have no unsettled smaller neighbour:
    local minima of the overlap graph. The order is that of the sequential rule,
    smallest area first, but shapes that do not touch never wait for each other.
    """
    left = written(shapes.select("shape"))
    edges = written(pairs)
    out, number = None, 0
    while not left.isEmpty():
        number += 1
        waiting = edges.select(F.col("high").alias("shape")).distinct()
        done = left.join(shuffled(waiting), "shape", "left_anti").withColumn("round", F.lit(number))
        done = written(done)
        out = done if out is None else out.union(done)
        left = written(left.join(shuffled(done), "shape", "left_anti"))
        edges = written(edges.join(shuffled(done.select(F.col("shape").alias("low"))), "low", "left_anti"))
    return out if out is not None else shapes.select("shape", F.lit(0).alias("round"))


def _owned(own: pd.DataFrame, others: pd.DataFrame) -> float:
    """Area of one shape in a strip less what the others cover there, by slabs between all vertices and crossings."""
    rows = pd.concat([own.assign(mine=True), others.assign(mine=False)], ignore_index=True)
    lo, hi, m, c = (rows[k].to_numpy() for k in ("lo", "hi", "m", "c"))
    i, j = np.triu_indices(len(rows), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (c[j] - c[i]) / (m[i] - m[j])
    x = x[(x > np.maximum(lo[i], lo[j])) & (x < np.minimum(hi[i], hi[j]))]
    at = np.unique(np.concatenate((lo, hi, x)))
    total = 0.0
    mine, shape = rows["mine"].to_numpy(), pd.factorize(rows["shape"])[0]
    for a, b in zip(at, at[1:]):
        middle = (a + b) / 2
        on = np.flatnonzero((lo <= a) & (hi >= b))
        y = m[on] * middle + c[on]
        order = np.lexsort((shape[on], y))
        inside: dict[int, bool] = {}
        start = None
        for k in order:
            s = shape[on[k]]
            before = inside.get(-1, False) and not any(v for q, v in inside.items() if q >= 0)
            if mine[on[k]]:
                inside[-1] = not inside.get(-1, False)
            else:
                inside[s] = not inside.get(s, False)
            now = inside.get(-1, False) and not any(v for q, v in inside.items() if q >= 0)
            if now and not before:
                start = y[k]
            elif before and not now:
                total += (y[k] - start) * (b - a)
    return total


def outlines(edges: DataFrame, shapes: DataFrame) -> DataFrame:
    """(shape, area, first): the first shape, by area, then by name, that has the same edges.

    Edges are compared as a set by their number and two sums of 64-bit hashes;
    which way round a shape is given and where it begins do not matter.
    """
    way = edges.dropna(subset=["shape", *EDGE]).join(shuffled(shapes.select("shape", "turn")), "shape")
    back = F.col("turn") < 0
    ends = [F.when(back, F.col(b)).otherwise(F.col(a)) + F.lit(0.0) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))]
    sums = [F.sum(F.xxhash64(F.lit(seed), *ends).cast("decimal(20,0)")).alias(f"sum{seed}") for seed in (1, 2)]
    marks = written(way.groupBy("shape").agg(F.count("*").alias("n"), *sums).join(shuffled(shapes.select("shape", "area")), "shape"))
    firsts = marks.groupBy("n", "sum1", "sum2").agg(F.min(F.struct("area", "shape"))["shape"].alias("first"))
    return marks.join(shuffled(firsts), ["n", "sum1", "sum2"]).select("shape", "area", "first")


def owned_areas(edges: DataFrame, block: float = 5.0, strip: float = 1.0) -> DataFrame:
    """(shape, area, owned, round): area that is left to each shape when every point goes to its smallest shape.

    The smaller neighbours of a shape are all that can take from it, whatever
    they lost themselves, so every shape is worked out in its own strips; no
    shape waits for another. Ties of area go to the smaller key. Of shapes with
    the same edges the first takes all that any of them could, so only it meets
    others; its copies keep nothing and are settled in its round.
    """
    every = written(outlines(edges, shapes_of(edges)))
    edges = written(edges.join(shuffled(every.where("shape = first").select("shape")), "shape", "left_semi"))
    shapes = written(shapes_of(edges))
    pairs = written(overlaps(edges, block, strip))
    lines = written(edge_strips(edges, strip))
    kind = lines.schema["shape"].dataType.simpleString()
    own = lines.withColumn("of", F.col("shape"))
    taking = pairs.join(shuffled(lines.withColumnRenamed("shape", "low")), "low").select(F.col("low").alias("shape"), "strip", "lo", "hi", "m", "c", "way", F.col("high").alias("of"))

    def left(key, pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf["shape"] == key[0]
        return pd.DataFrame({"of": [key[0]], "strip": [key[1]], "owned": [_owned(pdf[mine], pdf[~mine]) if mine.any() else 0.0]})

    got = own.unionByName(taking).groupBy("of", "strip").applyInPandas(left, f"of {kind}, strip long, owned double")
    sums = got.groupBy(F.col("of").alias("shape")).agg(F.sum("owned").alias("owned"))
    firsts = sums.join(shuffled(priority_rounds(shapes, pairs)), "shape").withColumnRenamed("shape", "first")
    own = F.when(F.col("shape") == F.col("first"), F.col("owned")).otherwise(F.lit(0.0))
    return every.join(shuffled(firsts), "first").select("shape", "area", own.alias("owned"), "round")
