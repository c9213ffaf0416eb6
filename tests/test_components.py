"""Connected groups against flood fill, for all block sizes."""

import random

import pytest

from cellwright.operators import components as C


def flood(cells, cols, wrap):
    left, root = set(cells), {}
    for start in sorted(cells):
        if start not in left:
            continue
        left.discard(start)
        todo, group = [start], [start]
        while todo:
            r, c = todo.pop()
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    n = (r + dr, (c + dc) % cols if wrap else c + dc)
                    if n in left:
                        left.discard(n)
                        todo.append(n)
                        group.append(n)
        for g in group:
            root[g] = start[0] * cols + start[1]
    return root


@pytest.mark.parametrize("size", [1, 3, 5, 128])
@pytest.mark.parametrize("wrap", [True, False])
def test_random_grids(spark, size, wrap):
    rng = random.Random(size)
    cols, rows = 13, []
    for k, share in (("a", 0.2), ("b", 0.4), (None, 0.55)):
        rows += [(k, 1 + (r + c) % 2, r, c, r * 0.5) for r in range(11) for c in range(cols) if rng.random() < share]
    df = spark.createDataFrame([r for r in rows if r[0]], "kind string, sign int, row int, col int, z double")
    got = C.label_components(df, cols, ["kind", "sign"], wrap, size).collect()
    assert len(got) == df.count() and {"z", "root"} <= set(got[0].asDict())
    for key in {(r["kind"], r["sign"]) for r in got}:
        own = {(r["row"], r["col"]): r["root"] for r in got if (r["kind"], r["sign"]) == key}
        assert own == flood(set(own), cols, wrap)


def test_snake_spiral_and_ring(spark):
    """Long groups that cross many blocks, and one that closes over the wrap."""
    cols = 24
    snake = {(r, c) for r in range(0, 24, 2) for c in range(cols - 1)} | {(r, 0 if r % 4 == 3 else cols - 2) for r in range(1, 24, 2)}
    ring = {(30, c) for c in range(cols)}
    cells = snake | ring
    got = {(r["row"], r["col"]): r["root"] for r in C.label_components(spark.createDataFrame(sorted(cells), "row int, col int"), cols, size=4).collect()}
    assert got == flood(cells, cols, True) and len(set(got.values())) == 2


def test_rounds_run_over_border_labels_only(spark):
    cells = spark.range(64 * 64).selectExpr("cast(id div 64 as int) as row", "cast(id % 64 as int) as col")
    labels = C.label_blocks(cells, 64, [], 16)
    edges = C.border_edges(cells, labels, 64, [], 16, True)
    assert labels.select("label").distinct().count() == 16 and edges.select("node").distinct().count() == 16 and edges.count() <= 16 * 8
    assert [r[0] for r in C.label_components(cells, 64, size=16).select("root").distinct().collect()] == [0]


def test_empty_and_repeated_cells(spark):
    df = spark.createDataFrame([], "row int, col int")
    assert C.label_components(df, 10).count() == 0
    twice = spark.createDataFrame([(1, 1, "x"), (1, 1, "y"), (2, 2, "z")], "row int, col int, name string")
    assert [(r["name"], r["root"]) for r in C.label_components(twice, 10).orderBy("name").collect()] == [("x", 11), ("y", 11), ("z", 11)]
