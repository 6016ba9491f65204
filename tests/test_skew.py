"""Hot keys and plans: results on skewed tables, one scan per fact table, no raw rows in few tasks."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from almanaq.operators import geo
from almanaq.operators.absorb import absorb_ols
from almanaq.operators.slopes import unit_slopes
from almanaq.operators.within import fe_within
from check import TABLES, compare, connect
from workload import queries as q

SOURCE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """The smallest tables with a third of the shipments on one supplier and in one month, a third of the orders on one
    customer, and some NULL keys."""
    out = tmp_path_factory.mktemp("skewed")
    rng = np.random.default_rng(9)
    for t in TABLES:
        pdf = pd.read_parquet(f"{SOURCE}/{t}.parquet")
        hot = rng.random(len(pdf)) < 1 / 3
        if t == "lineitem":
            pdf.loc[hot, "l_suppkey"] = 7
            pdf.loc[hot & (rng.random(len(pdf)) < 0.5), "l_shipdate"] = pd.Timestamp("1997-03-05")
            pdf["l_suppkey"] = pdf["l_suppkey"].astype("Int64").mask(rng.random(len(pdf)) < 0.02)
        if t == "orders":
            pdf.loc[hot, "o_custkey"] = 5
        if t == "customer":
            pdf.loc[hot, "c_mktsegment"] = "BUILDING"
        for c in pdf.select_dtypes("datetime"):
            pdf[c] = pdf[c].astype("datetime64[us]")
        pdf.to_parquet(f"{out}/{t}.parquet", index=False)
    return str(out)


@pytest.mark.parametrize("name", [
    "monthly_through_supplier", "unit_month_deviation", "zscore_by_year", "standardised_unit_deviation",
    "zero_filled_skeleton", "unmatched_lookup_keys", "period_profile_means", "weighted_density", "dissolved_edges", "national_panel",
    "fe_within_national",
])
def test_skewed_tables(spark, skewed, name):
    assert compare(entry.queries()[name](spark, skewed), connect(skewed), entry.oracle_sql()[name]) is None


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name, facts", [
    ("monthly_through_supplier", "lineitem"), ("agg_levels", "lineitem"), ("month_deviation", "lineitem"),
    ("unit_month_deviation", "lineitem"), ("zscore_by_year", "orders"), ("zscore_global", "lineitem"),
    ("standardised_month_deviation", "orders"), ("standardised_unit_deviation", "orders"), ("weighted_density", "orders"),
    ("zero_filled_skeleton", "lineitem"), ("planar_centroids", "customer"), ("unpivot_matching_columns", "lineitem"),
])
def test_facts_are_scanned_once(spark, name, facts):
    plan = executed(q.QUERIES[name](spark, SOURCE))
    # a table written on the way was the one scan of the facts
    assert len(re.findall(rf"FileScan parquet.*{facts}\.parquet", plan)) == (0 if name == "weighted_density" else 1)
    assert "CartesianProduct" not in plan and "Python" not in plan


def test_only_needed_columns_are_read(spark):
    plan = executed(q.nation_shipments(spark, SOURCE).select("nation", "rfh"))
    read = re.search(r"lineitem\.parquet.*?ReadSchema: struct<(.*?)>", plan).group(1)
    assert {c.split(":")[0] for c in read.split(",")} <= {
        "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_returnflag", "l_linenumber"}


def test_filter_reaches_the_scan(spark):
    plan = executed(q.nation_orders(spark, SOURCE, "1-URGENT"))
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan


def test_raw_rows_are_summed_before_the_first_shuffle(spark):
    plan = executed(q.nation_shipments(spark, SOURCE))
    # Read from the scan upwards: the aggregate comes before any exchange.
    lines = [line for line in reversed(plan.splitlines()) if "Exchange" in line or "HashAggregate" in line or "lineitem" in line]
    at = next(i for i, line in enumerate(lines) if "lineitem" in line)
    assert "HashAggregate" in lines[at + 1]


def test_models_on_a_hot_unit(spark):
    """A third of all raw rows in one unit, several rows per cell."""
    rng = np.random.default_rng(11)
    n = 4000
    pdf = pd.DataFrame({
        "unit": np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 40, n)), "year": rng.integers(2000, 2006, n), "month": rng.integers(1, 13, n),
        "x": rng.normal(size=n), "z": rng.normal(size=n)})
    pdf["y"] = pdf.x * (pdf.unit % 3) + pdf.z + rng.normal(size=n)
    df = spark.createDataFrame(pdf)

    def dense(x):
        return np.linalg.lstsq(x, pdf.y.to_numpy(), rcond=None)[0]

    d = lambda c, first: pd.get_dummies(pdf[c], drop_first=not first).to_numpy(float)
    xz = pdf[["x", "z"]].to_numpy()
    np.testing.assert_allclose(fe_within(df, "y", ["x", "z"], "year").toPandas().estimate, dense(np.hstack([xz, d("year", True)]))[:2], atol=1e-9)
    got = absorb_ols(df, "y", ["x", "z"], ["unit", "year", "month"]).toPandas()
    np.testing.assert_allclose(got.estimate, dense(np.hstack([xz, d("unit", True), d("year", False), d("month", False)]))[:2], atol=1e-9)
    got = unit_slopes(df, "y", "x", ["z"], "unit", "year").toPandas().sort_values("unit")
    u = d("unit", True)
    want = dense(np.hstack([u * pdf[["x"]].to_numpy(), u, pdf[["z"]].to_numpy(), d("year", False)]))
    np.testing.assert_allclose(got.slope, want[:u.shape[1]], atol=1e-9)


def test_long_ring_spreads_over_tasks(spark):
    """One ring with 20,000 vertices: edges are paired by vertex number, not inside one task."""
    n = 20_000
    ring = spark.range(n).select(
        F.lit("a").alias("unit"), F.lit(1).alias("ring"), F.col("id").cast("int").alias("seq"),
        (3 + F.cos(2 * np.pi * F.col("id") / n)).alias("lon"), (1 + F.sin(2 * np.pi * F.col("id") / n)).alias("lat"))
    edges = geo.edges(ring, "unit")
    assert edges.count() == n
    plan = executed(edges)
    assert "Window [" not in plan and re.search(r"hashpartitioning\([^)]*_groupingexpression", plan)
    got = geo.centroids(ring, "unit").first()
    assert (got["lon"], got["lat"], got["area"]) == (pytest.approx(3.0), pytest.approx(1.0), pytest.approx(np.pi, rel=1e-6))
