import datetime as dt

import numpy as np
import pandas as pd
import pytest

from almanaq.operators import aggregate, anomaly


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame([(u, y, m) for u in "ab" for y in range(2000, 2006) for m in range(1, 13)], columns=["unit", "year", "month"])
    pdf["x"] = rng.normal(10, 3, len(pdf))
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("by", [[], ["year"], ["month"], ["unit"], ["unit", "month"]])
def test_zscore_has_mean_zero_sd_one(cells, by):
    pdf, df = cells
    got = anomaly.zscore(df, {"z": "x"}, by).toPandas().sort_values(["unit", "year", "month"]).reset_index(drop=True)
    scale = lambda s: (s - s.mean()) / s.std(ddof=1)
    want = pdf.groupby(by)["x"].transform(scale) if by else scale(pdf["x"])
    np.testing.assert_allclose(got["z"], want, atol=1e-12)


def test_zscore_without_spread_is_null(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 7.0), (3, None), (3, 1.0), (3, 3.0)], "year int, x double")
    got = {(r["year"], r["x"]): r["z"] for r in anomaly.zscore(df, {"z": "x"}, ["year"]).collect()}
    assert got[1, 5.0] is None and got[2, 7.0] is None and got[3, None] is None
    assert got[3, 3.0] == pytest.approx(0.5 ** 0.5)


@pytest.mark.parametrize("by", [["month"], ["unit", "month"]])
def test_deviation_averages_zero(cells, by):
    _, df = cells
    got = anomaly.deviation(df, "x", by, flag="side").toPandas()
    assert got.groupby(by)["deviation"].mean().abs().max() < 1e-12
    assert set(got["side"]) == {"Above", "Below"}


def test_null_unit_is_a_group(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 1, 3.0), ("a", 1, 5.0)], "unit string, month int, x double")
    got = sorted((r["unit"] or "", r["deviation"]) for r in anomaly.deviation(df, "x", ["unit", "month"]).collect())
    assert got == [("", -1.0), ("", 1.0), ("a", 0.0)]
    null_month = spark.createDataFrame([(None, 1.0), (None, 3.0)], "month int, x double")
    assert sorted(r["deviation"] for r in anomaly.deviation(null_month, "x", ["month"]).collect()) == [-1.0, 1.0]


def test_standardised_deviation_composes(cells):
    pdf, df = cells
    got = anomaly.standardised_deviation(df, "x", ["year"], ["unit", "month"]).toPandas().sort_values(["unit", "year", "month"])
    z = pdf.groupby("year")["x"].transform(lambda s: (s - s.mean()) / s.std(ddof=1))
    want = z - z.groupby([pdf.unit, pdf.month]).transform("mean")
    np.testing.assert_allclose(got["deviation"], want, atol=1e-12)


def test_period_index_ranks_occurring_months(spark):
    df = spark.createDataFrame([(2001, 3), (2000, 12), (2001, 3), (2002, 1)], "year int, month int")
    got = sorted((r["date"], r["time"]) for r in anomaly.period_index(df).collect())
    assert got == [(dt.date(2000, 12, 1), 1), (dt.date(2001, 3, 1), 2), (dt.date(2001, 3, 1), 2), (dt.date(2002, 1, 1), 3)]


def test_levels_agree_with_direct_sums(spark):
    rows = [("a1", "a", 2000, 1, 1.0), ("a1", "a", 2000, 1, None), ("a2", "a", 2000, 1, 4.0), ("b1", "b", 2000, 1, 8.0), ("b1", "b", 2000, 2, 3.0)]
    df = spark.createDataFrame(rows, "unit string, parent string, year int, month int, v double")
    strict = {(r["level"], r["parent"], r["unit"], r["month"]): r["v"] for r in aggregate.levels(df, "v", "unit", "parent").collect()}
    assert strict == {
        ("unit", "a", "a1", 1): None, ("unit", "a", "a2", 1): 4.0, ("unit", "b", "b1", 1): 8.0, ("unit", "b", "b1", 2): 3.0,
        ("parent", "a", None, 1): None, ("parent", "b", None, 1): 8.0, ("parent", "b", None, 2): 3.0,
        ("total", None, None, 1): None, ("total", None, None, 2): 3.0}
    skip = {(r["level"], r["parent"], r["month"]): r["v"] for r in aggregate.levels(df, "v", "unit", "parent", "skip").where("level <> 'unit'").collect()}
    assert skip == {("parent", "a", 1): 5.0, ("parent", "b", 1): 8.0, ("parent", "b", 2): 3.0, ("total", None, 1): 13.0, ("total", None, 2): 3.0}


def test_through_lookup_equals_join_then_sum(spark):
    rng = np.random.default_rng(4)
    n = 3000
    # A third of all rows on one key, some NULL keys and values, one key the dimension lacks.
    pdf = pd.DataFrame({
        "k": np.where(rng.random(n) < 0.33, 7, rng.integers(0, 50, n)), "year": 2000 + rng.integers(0, 3, n),
        "month": rng.integers(1, 13, n), "v": rng.integers(0, 9, n).astype(float)})
    facts = spark.createDataFrame(pdf).selectExpr(
        "case when k = 3 then null else k end as k", "cast(year as int) year", "cast(month as int) month", "case when v = 0 and k < 5 then null else v end as v")
    dim = spark.createDataFrame([(i, f"u{i % 4}") for i in range(49)], "id long, unit string")
    got = aggregate.monthly_through_lookup(
        facts, dim, "k", "id", "unit", {"s": ("strict", "v"), "t": ("skip", "v"), "m": ("mean", "v"), "n": ("count", None)}).toPandas()
    raw = facts.toPandas().merge(dim.toPandas(), left_on="k", right_on="id", how="left")
    want = raw.groupby(["unit", "year", "month"], dropna=False).agg(
        t=("v", "sum"), m=("v", "mean"), n=("v", "size"), present=("v", "count")).reset_index()
    both = got.merge(want, on=["unit", "year", "month"], suffixes=("", "_w"))
    assert len(both) == len(got) == len(want)
    assert (both.t == both.t_w).all() and (both.n == both.n_w).all()
    np.testing.assert_allclose(both.m, both.m_w)
    assert (both.s.isna() == (both.present < both.n)).all()
