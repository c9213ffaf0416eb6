"""Polygon overlay against a fine grid, closed forms and the sequential rule."""

import math
import random

import pytest

from cellwright.operators import overlay as O


def ring(name, points):
    return [(name, *a, *b) for a, b in zip(points, points[1:] + points[:1])]


def circle(name, x, y, r, n, turn=1, wobble=0.0, rng=None):
    ps = []
    for k in range(n):
        q = r * (1 + (rng.uniform(-wobble, wobble) if rng else 0))
        ps.append((x + q * math.cos(2 * math.pi * k / n), y + turn * q * math.sin(2 * math.pi * k / n)))
    return ring(name, ps)


def table(spark, rows):
    return spark.createDataFrame([tuple(map(lambda v: float(v) if isinstance(v, int) else v, r)) for r in rows], "shape string, x1 double, y1 double, x2 double, y2 double")


def inside(rows, x, y):
    odd = False
    for _, x1, y1, x2, y2 in rows:
        if (x1 > x) != (x2 > x) and y < y1 + (x - x1) * (y2 - y1) / (x2 - x1):
            odd = not odd
    return odd


def test_common_areas(spark):
    square = ring("square", [(0, 0), (4, 0), (4, 4), (0, 4)])
    hole = square + ring("square", [(1, 1), (1, 3), (3, 3), (3, 1)])  # the other way round
    diamond = ring("diamond", [(2, 0), (4, 2), (2, 4), (0, 2)])
    far = ring("far", [(40, 0), (41, 0), (41, 1)])
    small = ring("small", [(1.5, 1.5), (1.5, 2.5), (2.5, 2.5), (2.5, 1.5)])
    df = table(spark, [*hole, *diamond, *far, *small])
    shapes = O.shapes_of(df)
    pairs = O.candidate_pairs(shapes, 1.0)
    got = {(r["a"], r["b"]): r["common"] for r in O.common_areas(df, pairs, shapes, 0.7).collect()}
    assert got["diamond", "square"] == pytest.approx(8 - 4) and got["small", "square"] == pytest.approx(0, abs=1e-12) and got["diamond", "small"] == pytest.approx(1)
    assert {"far"} & {x for k in got for x in k} == set()
    assert {r["shape"]: r["area"] for r in shapes.collect()} == pytest.approx({"square": 12, "diamond": 8, "far": 0.5, "small": 1})


def test_random_shapes_against_a_grid(spark):
    rng = random.Random(3)
    own = {f"s{k}": circle(f"s{k}", rng.uniform(0, 6), rng.uniform(-3, 3), rng.uniform(0.5, 2.5), rng.randrange(3, 14), rng.choice([1, -1]), 0.4, rng) for k in range(7)}
    df = table(spark, [r for e in own.values() for r in e])
    step = 0.02
    points = [(x * step + 0.0071, y * step + 0.0093) for x in range(-150, 450) for y in range(-300, 300)]
    cover = [{s for s, e in own.items() if inside(e, *p)} for p in points[::4]]
    unit = 4 * step * step
    shapes = O.shapes_of(df)
    got = {(r["a"], r["b"]): r["common"] for r in O.common_areas(df, O.candidate_pairs(shapes, 2.0), shapes, 0.5).collect()}
    for a in own:
        for b in own:
            if a < b:
                assert got.get((a, b), 0.0) == pytest.approx(unit * sum({a, b} <= c for c in cover), abs=0.12)
    area = {r["shape"]: r["area"] for r in shapes.collect()}
    owned = {r["shape"]: r for r in O.owned_areas(df, 2.0, 0.5).collect()}
    assert set(owned) == set(own)
    for s in own:
        sequential = unit * sum(s in c and s == min(c, key=lambda q: (area[q], q)) for c in cover)
        assert owned[s]["owned"] == pytest.approx(sequential, abs=0.12)
    assert sum(r["owned"] for r in owned.values()) == pytest.approx(unit * sum(bool(c) for c in cover), abs=0.3)


def sequential_rounds(order, pairs):
    """Round of each shape when it waits for its smaller neighbours only."""
    out = {}
    for s in order:
        out[s] = 1 + max((out[a] for a, b in pairs if b == s), default=0)
    return out


def test_rounds(spark):
    rng = random.Random(9)
    names = [f"n{k:02d}" for k in range(40)]
    pairs = sorted({(a, b) for a, b in ((min(p), max(p)) for p in (rng.sample(names, 2) for _ in range(90)))})
    got = {r["shape"]: r["round"] for r in O.priority_rounds(spark.createDataFrame([(n,) for n in names], "shape string"), spark.createDataFrame(pairs, "low string, high string")).collect()}
    assert got == sequential_rounds(names, pairs)


def test_mutual_duplicates(spark):
    rows = circle("a", 10, 5, 3, 40) + circle("b", 10.05, 5, 3, 37, -1) + circle("c", 10, 5, 2.0, 40) + circle("d", 10.9, 5, 3, 40) + circle("e", -20, 5, 3, 40)
    got = [(r["a"], r["b"]) for r in O.mutual_duplicates(table(spark, rows)).collect()]
    assert got == [("a", "b")]


def test_odd_rows(spark):
    empty = table(spark, [])
    assert O.mutual_duplicates(empty).count() == 0 and O.owned_areas(empty).count() == 0
    rows = ring("a", [(0, 0), (1, 0), (1, 1)]) + ring("line", [(0, 0), (5, 5)])
    df = table(spark, rows).union(spark.createDataFrame([(None, 1.0, 1.0, 2.0, 2.0), ("b", None, 1.0, 2.0, 2.0)], "shape string, x1 double, y1 double, x2 double, y2 double"))
    assert [(r["shape"], r["owned"], r["round"]) for r in O.owned_areas(df).collect()] == [("a", pytest.approx(0.5), 1)]


def blob(name, x, y, rng):
    """A square with a spike of little area on one side, so boxes say little about it."""
    reach = rng.choice([0, 0, 3, 9])
    return ring(name, [(x, y), (x + 2, y), (x + 2, y + 1 + 0.001), (x + 2 + reach, y + 1 + 0.002), (x + 2, y + 1 + 0.003), (x + 2, y + 2), (x, y + 2)][:: rng.choice([1, -1])])


@pytest.mark.parametrize("share", [0.7, 0.95, 1.0])
def test_candidates_lose_no_duplicates(spark, share):
    rng = random.Random(5)
    rows = [r for k in range(60) for r in blob(f"s{k:02d}", 1000 + rng.choice([0, 0.01, 0.05, 0.3, 1]), rng.choice([0, 0.02, 0.2]), rng)]
    df = table(spark, rows)
    shapes = O.shapes_of(df)
    common = {(r["a"], r["b"]): r["common"] for r in O.common_areas(df, O.candidate_pairs(shapes, 3.0), shapes, 1.0).collect()}
    area = {r["shape"]: r["area"] for r in shapes.collect()}
    tolerance = 1e-10
    wanted = {(a, b) for (a, b), c in common.items() if c >= share * (1 - tolerance) * max(area[a], area[b])}
    pairs = [(r["a"], r["b"]) for r in O.candidate_pairs(shapes, 3.0, share).collect()]
    assert len(pairs) == len(set(pairs)) and wanted <= set(pairs) and len(wanted) > 20


def test_neighbours_are_no_candidates(spark):
    rows = [r for k in range(100) for r in ring(f"s{k:02d}", [(k * 0.4, 0), (k * 0.4 + 4, 0), (k * 0.4 + 4, 4), (k * 0.4, 4)])]
    df = table(spark, rows)
    shapes = O.shapes_of(df)
    pairs = O.candidate_pairs(shapes, 6.0, 0.95)
    assert 0 < O.candidate_pairs(shapes, 6.0, 0.9).count() < 400 and pairs.count() < 200
    for got in (pairs, O.common_areas(df, O.candidate_pairs(shapes, 6.0), shapes, 2.0)):
        assert "Broadcast" not in got._jdf.queryExecution().toString()


def test_copies_wait_for_nobody(spark):
    big, small = [(0, 0), (6, 0), (6, 4), (0, 4)], [(4, 1), (9, 1), (9, 3), (4, 3)]
    rows = [r for k in range(12) for r in ring(f"b{k:02d}", big[k % 4 :] + big[: k % 4])]
    rows += [r for k in range(12) for r in ring(f"a{k:02d}", small[:: 1 if k % 2 else -1])]
    rows += ring("c", [(0, 0), (6, 0), (6, 4), (3, 4), (0, 4)])  # the same area, another outline
    got = {r["shape"]: r for r in O.owned_areas(table(spark, rows)).collect()}
    assert len(got) == 25 and {s: r["owned"] for s, r in got.items() if r["owned"] > 1e-9} == pytest.approx({"a00": 10, "b00": 20})
    assert {s: r["area"] for s, r in got.items()} == pytest.approx({s: 10 if s < "b" else 24 for s in got})
    assert {s: r["round"] for s, r in got.items()} == {s: 1 if s < "b" else 2 if s < "c" else 3 for s in got}
