import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from almanaq.functions.student import quantiles
from almanaq.operators import density, geo, trend


def test_trend_band(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame([(m, y, rng.normal() + 0.1 * y) for m in (1, 2) for y in range(2000, 2010 + m)], columns=["month", "year", "d"])
    got = trend.trend_lm(spark.createDataFrame(pdf), "d", "year", ["month"], grid=5).toPandas().sort_values(["month", "x"])
    for m, part in pdf.groupby("month"):
        x = np.column_stack([np.ones(len(part)), part.year - 2000.0])
        b = np.linalg.solve(x.T @ x, x.T @ part.d)
        s2 = ((part.d - x @ b) ** 2).sum() / (len(part) - 2)
        at = np.linspace(part.year.min(), part.year.max(), 5)
        g = np.column_stack([np.ones(5), at - 2000.0])
        fit, se = g @ b, np.sqrt(s2 * np.einsum("ij,jk,ik->i", g, np.linalg.inv(x.T @ x), g))
        mine = got[got.month == m]
        np.testing.assert_allclose(mine.x, at)
        np.testing.assert_allclose(mine.fit, fit, rtol=1e-9)
        np.testing.assert_allclose(mine.upper - mine.lower, 2 * quantiles(0.975)[len(part) - 3] * se, rtol=1e-8)


def test_trend_small_groups(spark):
    df = spark.createDataFrame([(1, 2000, 1.0), (1, 2001, 2.0), (2, 2000, 5.0), (3, 2000, None)], "g int, x int, y double")
    lines = trend.trend_lines(df, "y", "x", ["g"]).collect()
    assert [(r["g"], r["slope"], r["s"]) for r in lines] == [(1, 1.0, None)]


def test_density_is_the_exact_sum_and_keeps_its_mass(spark):
    rng = np.random.default_rng(6)
    w = rng.random(12)
    df = spark.createDataFrame([("p", m, float(w[m - 1])) for m in range(1, 13)] + [("single", 3, 1.0)], "period string, month int, w double")
    got = density.weighted_kde(df, "month", "w", ["period"], adjust=0.6).toPandas().sort_values("x")
    assert set(got.period) == {"p"} and len(got) == 512
    sd, iqr = np.std(range(1, 13), ddof=1), 9.25 - 3.75
    bw = 0.9 * min(sd, iqr / 1.34) * 12 ** -0.2 * 0.6
    assert bw == pytest.approx(1.1845, abs=1e-4)
    x = np.linspace(1, 12, 512)
    want = sum(w[m - 1] / w.sum() * np.exp(-0.5 * ((x - m) / bw) ** 2) / (bw * math.sqrt(2 * math.pi)) for m in range(1, 13))
    np.testing.assert_allclose(got.density, want, rtol=1e-10)
    inside = sum(w[m - 1] / w.sum() * 0.5 * (math.erf((12 - m) / bw / 2 ** 0.5) - math.erf((1 - m) / bw / 2 ** 0.5)) for m in range(1, 13))
    assert np.trapezoid(got.density, x) == pytest.approx(inside, abs=1e-5)


def test_density_counts_repeated_rows(spark):
    rows = [(1, 2, 1.0), (1, 2, 3.0), (1, 5, 1.0), (1, 9, 1.0)]
    df = spark.createDataFrame(rows, "g int, x int, w double")
    got = density.weighted_kde(df, "x", "w", ["g"], n=3).toPandas().sort_values("x")
    xs = np.array([2, 2, 5, 9])
    q = np.percentile(xs, [25, 75])
    bw = 0.9 * min(xs.std(ddof=1), (q[1] - q[0]) / 1.34) * 4 ** -0.2
    want = [sum(v / 6 * math.exp(-0.5 * ((g - x) / bw) ** 2) / (bw * math.sqrt(2 * math.pi)) for _, x, v in rows) for g in (1, 6.5, 12)]
    np.testing.assert_allclose(got.density, want, rtol=1e-10)


def square(unit, parent, x, y, size=1.0, closed=True, ring=1, reverse=False):
    points = [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]
    points = points[::-1] if reverse else points
    points = points + points[:1] if closed else points
    return [(unit, parent, ring, i, float(a), float(b)) for i, (a, b) in enumerate(points)]


SCHEMA = "unit string, parent string, ring int, seq int, lon double, lat double"


@pytest.mark.parametrize("surface", ["plane", "sphere"])
@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("reverse", [True, False])
def test_centroids(spark, surface, closed, reverse):
    rows = square("a", "p", -0.5, -0.5, closed=closed, reverse=reverse) + square("b", "p", 10, -0.5, closed=closed, reverse=reverse)
    got = {r["unit"]: (r["lon"], r["lat"]) for r in geo.centroids(spark.createDataFrame(rows, SCHEMA), "unit", surface).collect()}
    assert got["a"] == pytest.approx((0.0, 0.0), abs=1e-9)
    assert got["b"] == pytest.approx((10.5, 0.0), abs=1e-9)


def test_hole_moves_the_centroid(spark):
    rows = square("a", "p", 0, 0, 4.0) + square("a", "p", 2, 1, 1.0, ring=2, reverse=True)
    got = geo.centroids(spark.createDataFrame(rows, SCHEMA), "unit").first()
    assert got["area"] == pytest.approx(15.0)
    assert (got["lon"], got["lat"]) == pytest.approx(((32 - 2.5) / 15, (32 - 1.5) / 15))


def test_gap_in_vertex_numbers_raises(spark):
    rows = [r for r in square("a", "p", 0, 0) if r[3] != 2]
    with pytest.raises(Exception, match="consecutive"):
        geo.centroids(spark.createDataFrame(rows, SCHEMA), "unit").collect()


def test_dissolve_two_squares(spark):
    df = spark.createDataFrame(square("a", "p", 0, 0) + square("b", "p", 1, 0) + square("c", "q", 2, 0), SCHEMA)
    outline = geo.dissolve_edges(df, "unit", "parent")
    assert {r["parent"]: r["count"] for r in outline.groupBy("parent").count().collect()} == {"p": 6, "q": 4}
    whole = {r["parent"]: (r["lon"], r["lat"], r["area"]) for r in geo.outline_centroids(outline, "parent").collect()}
    assert whole["p"] == pytest.approx((1.0, 0.5, 2.0))
    quality = geo.edge_multiplicity(df.unionByName(df.where("unit = 'a'").withColumn("unit", F.lit("d"))), "unit", "parent")
    assert tuple(quality.where("parent = 'p'").first()) == ("p", 5, 0 + 1 + 1, 1) or quality.where("parent = 'p'").first()["overlapping"] == 1


def test_map_table(spark):
    units = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "unit string, tag int")
    coefs = spark.createDataFrame([("b", -4.0, 1.0, 0.1)], "unit string, estimate double, std_error double, p_value double")
    got = sorted(tuple(r) for r in geo.map_table(units, coefs, "unit", ["tag"]).select("unit", "tag", "estimate", "estimate_sqrt").collect())
    assert got == [("a", 1, None, None), ("b", 2, -4.0, -2.0)]


def test_profile_map_keeps_or_drops_empty_polygons(spark):
    profile = spark.createDataFrame([("a", 1, 0.5), ("x", 1, 0.7)], "unit string, month int, v double")
    polygons = spark.createDataFrame([("a", "A"), ("b", "B")], "unit string, name string")
    kept = geo.profile_map(profile, polygons, "unit", keep_missing=True)
    assert sorted((r["unit"], r["month"], r["name"]) for r in kept.where("month is not null").collect()) == [("a", 1, "A"), ("x", 1, None)]
    assert kept.count() == 3 and geo.profile_map(profile, polygons, "unit").count() == 2


def exact_density(values, weights, grid, adjust=1.0):
    import numpy as np

    x, w = np.array(values, float), np.array(weights, float)
    q = np.percentile(x, [25, 75])
    bw = 0.9 * min(x.std(ddof=1), (q[1] - q[0]) / 1.34) * len(x) ** -0.2 * adjust
    z = (grid[:, None] - x[None, :]) / bw
    return (np.exp(-0.5 * z * z) / (bw * np.sqrt(2 * np.pi)) * (w / w.sum())[None, :]).sum(1)


@pytest.mark.parametrize("held", [100_000, 10])
def test_density_of_continuous_values(spark, monkeypatch, held):
    """Binned with moments, and quartiles by counting, against the exact sum."""
    import numpy as np

    from almanaq.operators import density

    monkeypatch.setattr(density, "HELD_VALUES", held)
    rng = np.random.default_rng(2)
    rows = [(g, float(x), float(w)) for g, scale in (("a", 1.0), ("b", 0.01), (None, 3.0)) for x, w in zip(6 + scale * rng.normal(size=700), rng.random(700) + 0.1)]
    df = spark.createDataFrame(rows, "g string, x double, w double").repartition(5)
    grid = np.linspace(1, 12, 512)
    got = {}
    for r in density.weighted_kde(df, "x", "w", ["g"]).orderBy("x").collect():
        got.setdefault(r["g"], []).append(r["density"])
    for g in ("a", "b", None):
        want = exact_density([x for h, x, _ in rows if h == g], [w for h, _, w in rows if h == g], grid)
        np.testing.assert_allclose(got[g], want, atol=1e-9 * want.max(), rtol=0)
    whole = [r["density"] for r in density.weighted_kde(df, "x", "w", []).orderBy("x").collect()]
    np.testing.assert_allclose(whole, exact_density([x for _, x, _ in rows], [w for *_, w in rows], grid), atol=1e-9, rtol=0)


def test_exact_quantiles(spark):
    import numpy as np

    from almanaq.operators.quantile import exact_quantiles

    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=3001), "b": np.repeat([1.0, 2.0, 1e6, -1e6], 5), "c": np.array([4.0]), None: 10.0 ** rng.uniform(-4, 4, 500)}
    rows = [(g, float(x), int(c)) for g, xs in groups.items() for x, c in zip(xs, rng.integers(1, 4, len(xs)))]
    got = {r["g"]: r["q"] for r in exact_quantiles(spark.createDataFrame(rows, "g string, x double, c long"), "x", "c", ["g"], (0.25, 0.5, 1.0)).collect()}
    for g in groups:
        x = np.sort(np.repeat([x for h, x, _ in rows if h == g], [c for h, _, c in rows if h == g]))
        at = np.array([0.25, 0.5, 1.0]) * (len(x) - 1)
        lo, hi, rest = x[np.floor(at).astype(int)], x[np.ceil(at).astype(int)], at - np.floor(at)
        assert got[g] == [float(a) if t == 0 else float((1 - t) * a + t * b) for a, b, t in zip(lo, hi, rest)]


def test_pairing_of_edges_sorts_nothing_where_it_reads(spark, tmp_path, monkeypatch):
    """One file is one task's: halves of edges leave it before they are added up, by hash, to more tasks for more vertices."""
    from workload.queries import QUERIES

    spark.range(1000).select(F.col("id").alias("c_custkey"), F.lit(0).alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(geo, "VERTICES", 100, raising=False)
    for name in ("planar_centroids", "dissolved_edges"):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "Aggregate" not in plan[plan.rindex(", 81), REPARTITION_BY_NUM"):], name


def test_edges_with_missing_coordinates_stay(spark):
    rows = [("u", 1, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (1.0, None), (1.0, 1.0)])]
    got = geo.edges(spark.createDataFrame(rows, "u string, ring int, seq int, lon double, lat double"), "u")
    assert sorted(tuple(r)[2:] for r in got.collect()) == [(0, 0.0, 0.0, 1.0, None), (1, 1.0, None, 1.0, 1.0), (2, 1.0, 1.0, 0.0, 0.0)]
