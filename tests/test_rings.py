"""Rings of outlines, and coverages whose neighbours share no vertices."""

import random

import pytest
from pyspark.sql import functions as F

from almanaq.operators import geo, rings

EDGES = "parent string, x0 double, y0 double, x1 double, y1 double"


def loop(points):
    return list(zip(points, points[1:] + points[:1]))


def rows(parent, *loops):
    return [(parent, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for p in loops for a, b in loop(p)]


def found(spark, data):
    out = {}
    for r in rings.outline_rings(spark.createDataFrame(data, EDGES).repartition(3), "parent").collect():
        out.setdefault((r["parent"], r["ring"], r["hole"]), []).append((r["seq"], (r["lon"], r["lat"])))
    return {k: [p for _, p in sorted(v)] for k, v in out.items()}, {k: sorted(s for s, _ in v) for k, v in out.items()}


def test_rings_holes_and_several_parents(spark):
    outer, hole = [(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (1, 2), (2, 2), (2, 1)]
    island, other = [(10, 0), (11, 0), (10, 1)], [(0, 0), (0, 1), (1, 0)]
    data = rows("p", outer, hole, island) + rows("q", other)
    random.Random(1).shuffle(data)
    got, seqs = found(spark, data)
    assert got == {("p", 1, False): outer, ("p", 2, True): hole, ("p", 3, False): island, ("q", 1, False): other}
    assert all(s == list(range(1, len(s) + 1)) for s in seqs.values())


def test_rings_that_touch_stay_apart(spark):
    a, b = [(0, 0), (1, 0), (1, 1), (0, 1)], [(1, 1), (2, 1), (2, 2), (1, 2)]
    got, _ = found(spark, rows("p", a, b))
    assert sorted(got.values()) == [a, b]


def test_long_ring(spark):
    import math

    n = 1000
    points = [(math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)) for i in range(n)]
    (ring,), _ = (list(x.values()) if isinstance(x, dict) else x for x in found(spark, rows("p", points)))
    at = ring.index(points[0])
    assert ring[at:] + ring[:at] == points and ring[0] == min(points)


def test_open_lines_are_refused(spark):
    with pytest.raises(ValueError, match="close"):
        rings.outline_rings(spark.createDataFrame(rows("p", [(0, 0), (1, 0), (1, 1)])[:2], EDGES), "parent")


def test_rings_are_read_as_vertices(spark):
    outer, hole = [(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (1, 2), (2, 2), (2, 1)]
    outline = spark.createDataFrame(rows("p", outer, hole), EDGES)
    a, b = geo.outline_centroids(outline, "parent").first(), geo.centroids(rings.outline_rings(outline, "parent"), "parent").first()
    assert tuple(a) == pytest.approx(tuple(b))


def test_touching_neighbours_dissolve(spark):
    """A tall parcel beside two low ones, a long slanted border cut into thirds, and one parcel apart."""
    def polygon(unit, parent, points):
        return [(unit, parent, 1, i, float(x), float(y)) for i, (x, y) in enumerate(points)]

    data = polygon("a", "p", [(0, 0), (1, 0), (1, 2), (0, 2)]) + polygon("b", "p", [(1, 0), (2, 0), (2, 1), (1, 1)]) + polygon("c", "p", [(1, 1), (2, 1), (2, 2), (1, 2)])
    data += polygon("d", "q", [(0, 0), (9, 3), (0, 3)]) + polygon("e", "q", [(0, 0), (3, 0), (3, 1)]) + polygon("f", "q", [(3, 0), (9, 0), (9, 3), (3, 1)])
    df = spark.createDataFrame(data, "unit string, parent string, ring int, seq int, lon double, lat double")
    for cell in (None, 0.3, 50.0):
        outline = rings.dissolve_touching(df, "unit", "parent", cell=cell)
        area = {r["parent"]: r["area"] for r in geo.outline_centroids(outline, "parent").collect()}
        assert area == pytest.approx({"p": 4.0, "q": 27.0})
        lines = {(r["parent"], *sorted([(r["x0"], r["y0"]), (r["x1"], r["y1"])])) for r in outline.collect()}
        assert ("p", (1.0, 0.0), (1.0, 1.0)) not in lines and len([x for x in lines if x[0] == "p"]) == 7
        assert not any(x[0] == "q" and x[1:] in [((0.0, 0.0), (3.0, 1.0)), ((3.0, 1.0), (9.0, 3.0))] for x in lines)
    assert geo.dissolve_edges(df, "unit", "parent").where("parent = 'p'").count() > 7


def test_split_against_all_pairs(spark):
    rng = random.Random(7)
    data = [(rng.choice("pq"), *(float(rng.randint(0, 12)) for _ in range(4))) for _ in range(60)]
    data = [d for d in data if d[1:3] != d[3:5]]
    points = {(d[0], d[1], d[2]) for d in data}
    want = []
    for p, x0, y0, x1, y1 in data:
        on = sorted((((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)), x, y) for q, x, y in points
                    if q == p and (x - x0) * (y1 - y0) == (y - y0) * (x1 - x0) and 0 < (x - x0) * (x1 - x0) + (y - y0) * (y1 - y0) < (x1 - x0) ** 2 + (y1 - y0) ** 2)
        path = [(x0, y0), *[(x, y) for _, x, y in on], (x1, y1)]
        want += [(p, *a, *b) for a, b in zip(path, path[1:])]
    got = rings.split_edges(spark.createDataFrame(data, EDGES), "parent")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_edges_are_joined_in_counted_tasks(spark, monkeypatch):
    """More edges, more tasks, however many shuffle partitions there are; placed edges, whose keys are NULL, are in none of the joins."""
    plans, materialise = [], rings.materialise
    monkeypatch.setattr(rings, "EDGES", 10, raising=False)
    monkeypatch.setattr(rings, "materialise", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), materialise(df))[1])
    squares = [[(i, 0), (i + 1, 0), (i + 1, 1), (i, 1)] for i in range(0, 40, 2)]
    long = [(i, 5) for i in range(60)] + [(i, 6) for i in reversed(range(60))]
    got, seqs = found(spark, rows("p", *squares, long))
    assert sorted(got.values()) == sorted([*squares, long]) and all(s == list(range(1, len(s) + 1)) for s in seqs.values())
    assert sum(", 21), REPARTITION_BY_NUM" in p for p in plans) >= 8  # 200 edges
    placing = [p for p in plans if "LeftOuter" in p and "steps" in p]
    assert placing and all("isnotnull(to#" in p for p in placing)
