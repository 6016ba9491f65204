"""Empty tables, single groups, perfect fits."""

import pytest
from pyspark.sql import functions as F

from almanaq.operators.absorb import absorb_ols
from almanaq.operators.anomaly import deviation, period_index, zscore
from almanaq.operators.density import weighted_kde
from almanaq.operators.slopes import unit_slopes
from almanaq.operators.trend import trend_lm

SCHEMA = "unit string, year int, month int, x double, y double, z double"


@pytest.fixture(scope="module")
def one_unit(spark):
    return spark.createDataFrame([("a", 2000, m, float(m), float(m * m), 1.0 / m) for m in range(1, 13)], SCHEMA)


def test_empty_tables_stay_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for df in (
        zscore(empty, {"s": "x"}, []), zscore(empty, {"s": "x"}, ["year"]), deviation(empty, "x", ["unit", "month"]),
        period_index(empty), weighted_kde(empty, "month", "x", ["year"]), trend_lm(empty, "x", "year", ["month"]),
    ):
        assert df.count() == 0


def test_one_unit_and_year(one_unit):
    slope = unit_slopes(one_unit, "y", "x", ["z"], "unit", "year").first()
    coefs = absorb_ols(one_unit, "y", ["x", "z"], ["unit", "year"]).first()
    assert slope["slope"] == pytest.approx(coefs["estimate"]) and slope["std_error"] == pytest.approx(coefs["std_error"])
    assert slope["df_resid"] == coefs["df_resid"] == 9


def test_rows_without_a_unit_are_not_fitted(one_unit):
    with_null = one_unit.unionByName(one_unit.withColumn("unit", F.lit(None).cast("string")))
    assert absorb_ols(with_null, "y", ["x"], ["unit", "year"]).first()["n_obs"] == 12


def test_perfect_fit(one_unit):
    row = absorb_ols(one_unit.withColumn("y", F.col("x") * 2), "y", ["x"], ["unit", "year"]).first()
    assert row["estimate"] == pytest.approx(2.0) and row["std_error"] == pytest.approx(0.0, abs=1e-7)


def test_plans_do_not_depend_on_the_names_of_keys(spark, one_unit):
    import re

    plans = set()
    for key in ("month", "mesmo"):
        done = deviation(one_unit.withColumnRenamed("month", key), one_unit.columns[-1], [key])
        plan = done._jdf.queryExecution().sparkPlan().treeString()
        nodes = re.findall(r"^[\s:+\-*]*(?:\(\d+\) )?(\w+)", plan, re.M)
        plans.add(tuple(x for x in nodes if x != "Project"))
    assert len(plans) == 1 and "Window" not in plans.pop()
