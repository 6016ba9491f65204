"""Regressions against dense solves of the full dummy-variable form."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from almanaq.operators import gls
from almanaq.operators.absorb import absorb_ols
from almanaq.operators.coefficients import coef_interval, terms_matching
from almanaq.operators.slopes import interaction_table, unit_slopes
from almanaq.operators.within import fe_within


def unbalanced(seed=1, offset=0.0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame([(u, y, m) for u in range(7) for y in range(2000, 2006) for m in range(1, 13)], columns=["unit", "year", "month"])
    pdf["x"] = rng.normal(size=len(pdf)) + offset
    pdf["z"] = rng.normal(size=len(pdf)) + pdf.unit
    pdf["y"] = 0.3 * pdf.x * (1 + pdf.unit) + pdf.z + 0.1 * (pdf.year - 2000) + np.sin(pdf.month) + rng.normal(size=len(pdf)) + offset
    return pdf.sample(frac=0.85, random_state=seed).reset_index(drop=True)


@pytest.fixture(scope="module")
def panel(spark):
    pdf = unbalanced()
    return pdf, spark.createDataFrame(pdf)


def dummies(pdf, factors):
    return np.hstack([pd.get_dummies(pdf[f], drop_first=i > 0).to_numpy(float) for i, f in enumerate(factors)])


def dense(x, y):
    beta, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
    left = y - x @ beta
    dof = len(y) - rank
    return beta, np.sqrt(left @ left / dof * np.diag(np.linalg.pinv(x.T @ x))), dof


CASES = [
    (lambda df: fe_within(df, "y", ["x", "z"], "year"), ["year"]),
    (lambda df: absorb_ols(df, "y", ["x", "z"], ["year", "month"]), ["year", "month"]),
    (lambda df: absorb_ols(df, "y", ["x", "z"], ["unit", "year"]), ["unit", "year"]),
    (lambda df: absorb_ols(df, "y", ["x", "z"], ["unit", "year", "month"]), ["unit", "year", "month"]),
]


@pytest.mark.parametrize("fit, factors", CASES)
@pytest.mark.parametrize("offset", [0.0, 1e5])
def test_absorbed_factors(spark, fit, factors, offset):
    pdf = unbalanced(offset=offset)
    got = fit(spark.createDataFrame(pdf)).toPandas()
    centred = pdf[["x", "z"]].to_numpy() - pdf[["x", "z"]].to_numpy().mean(0)
    beta, se, dof = dense(np.hstack([centred, dummies(pdf, factors)]), pdf.y.to_numpy() - pdf.y.mean())
    np.testing.assert_allclose(got.estimate, beta[:2], rtol=1e-8)
    np.testing.assert_allclose(got.std_error, se[:2], rtol=1e-8)
    assert set(got.df_resid) == {dof} and set(got.n_obs) == {len(pdf)}


def test_incomplete_rows_are_dropped(spark, panel):
    pdf, df = panel
    holed = df.withColumn("z", F.when(F.col("month") != 5, F.col("z")))
    kept = spark.createDataFrame(pdf[pdf.month != 5])
    for fit, _ in CASES:
        a, b = fit(holed).toPandas(), fit(kept).toPandas()
        pd.testing.assert_frame_equal(a, b)


def test_covariate_absorbed_by_factors_is_null(spark, panel):
    _, df = panel
    got = absorb_ols(df.withColumn("w", F.col("year") * 2.0 + F.col("unit")), "y", ["x", "w"], ["unit", "year"]).collect()
    assert got[0]["estimate"] is not None and got[1]["estimate"] is None and got[1]["p_value"] is None


def test_covariate_constant_within_units_is_null(spark, panel):
    _, df = panel
    for value in (F.lit(1.1), F.col("unit") / 7 + 1e3):
        got = absorb_ols(df.withColumn("w", value), "y", ["x", "w"], ["unit", "year"]).collect()
        assert got[0]["estimate"] is not None and got[1]["estimate"] is None
    got = fe_within(df.withColumn("w", F.col("year") / 7), "y", ["x", "w"], "year").collect()
    assert got[1]["estimate"] is None


def test_empty_model_raises(spark, panel):
    _, df = panel
    for fit, _ in CASES:
        with pytest.raises(ValueError, match="no complete rows"):
            fit(df.withColumn("y", F.lit(None).cast("double")))


def test_interval(spark, panel):
    _, df = panel
    row = coef_interval(fe_within(df, "y", ["x", "z"], "year"), "x").collect()
    assert len(row) == 1
    assert terms_matching(fe_within(df, "y", ["x", "z"], "year"), "^z$").count() == 1
    assert row[0]["upper"] - row[0]["lower"] == pytest.approx(4 * row[0]["std_error"])


def slope_design(pdf, units, difference):
    u = pd.get_dummies(pdf.unit).to_numpy(float)
    x = pdf.x.to_numpy()[:, None] * u[:, units]
    if difference:
        x[:, 0] = pdf.x
    years = pd.get_dummies(pdf.year, drop_first=True).to_numpy(float)
    return np.hstack([x, u, pdf[["z"]].to_numpy(), years])


def test_unit_slopes(spark, panel):
    pdf, df = panel
    got = unit_slopes(df, "y", "x", ["z"], "unit", "year").toPandas().sort_values("unit")
    beta, se, dof = dense(slope_design(pdf, range(7), False), pdf.y.to_numpy())
    np.testing.assert_allclose(got.slope, beta[:7], rtol=1e-9)
    np.testing.assert_allclose(got.std_error, se[:7], rtol=1e-9)
    beta, se, _ = dense(slope_design(pdf, range(7), True), pdf.y.to_numpy())
    np.testing.assert_allclose(got.slope_minus_ref[1:], beta[1:7], rtol=1e-9)
    np.testing.assert_allclose(got.diff_std_error[1:], se[1:7], rtol=1e-9)
    assert pd.isna(got.slope_minus_ref.iloc[0]) and set(got.df_resid) == {dof}
    assert interaction_table(unit_slopes(df, "y", "x", ["z"], "unit", "year"), "unit").count() == 6


@pytest.mark.parametrize("flat", [0, 3])
def test_flat_unit_has_no_slope(spark, flat):
    pdf = unbalanced()
    pdf.loc[pdf.unit == flat, "x"] = 1.1
    got = unit_slopes(spark.createDataFrame(pdf), "y", "x", ["z"], "unit", "year").toPandas().sort_values("unit")
    others = [u for u in range(7) if u != flat]
    beta, se, dof = dense(slope_design(pdf, others, False), pdf.y.to_numpy())
    np.testing.assert_allclose(got.slope[got.unit != flat], beta[:6], rtol=1e-8)
    np.testing.assert_allclose(got.std_error[got.unit != flat], se[:6], rtol=1e-8)
    assert got.slope[got.unit == flat].isna().all() and set(got.df_resid) == {dof}
    if flat == 0:
        assert got.slope_minus_ref.isna().all()


def test_unit_slopes_without_covariates(spark, panel):
    pdf, df = panel
    got = unit_slopes(df, "y", "x", [], "unit", "year").toPandas().sort_values("unit")
    design = np.delete(slope_design(pdf, range(7), False), 14, axis=1)
    np.testing.assert_allclose(got.slope, dense(design, pdf.y.to_numpy())[0][:7], rtol=1e-9)


def series(seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for m in range(1, 13):
        e = 0.0
        for y in range(2000 + m % 3, 2018):
            e = 0.5 * e + rng.normal()
            x, z = rng.normal(size=2)
            out.append((y, m, x, z, 0.4 * x - 0.2 * z + e))
    return pd.DataFrame(out, columns=["year", "month", "x", "z", "y"])


def dense_restricted(pdf, partial):
    _, rho = gls.ar_from_partial(partial, 40)
    same = pdf.month.to_numpy()[:, None] == pdf.month.to_numpy()[None, :]
    gap = np.abs(np.subtract.outer(pdf.year.to_numpy(), pdf.year.to_numpy()))
    v = np.where(same, rho[np.minimum(gap, 39)], 0.0)
    x = np.column_stack([np.ones(len(pdf)), pdf.x, pdf.z])
    y = pdf.y.to_numpy()
    inv = np.linalg.inv(v)
    xx = x.T @ inv @ x
    beta = np.linalg.solve(xx, x.T @ inv @ y)
    left = y - x @ beta
    dof = len(y) - 3
    s2 = left @ inv @ left / dof
    loglik = -0.5 * (dof * (np.log(2 * np.pi * s2) + 1) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(xx)[1])
    return loglik, beta, np.sqrt(s2 * np.diag(np.linalg.inv(xx)))


def gaps(pdf, share):
    return pdf.sample(frac=1 - share, random_state=8) if share else pdf


@pytest.mark.parametrize("share", [0.0, 0.05, 0.2])
@pytest.mark.parametrize("partial", [[0.4], [-0.8], [0.5, -0.3], [0.2, 0.6, -0.4]])
def test_likelihood_from_sums_equals_dense(spark, partial, share):
    """Also with missing years, which count by their real distance."""
    pdf = gaps(series(), share)
    sums = gls.lag_sums(spark.createDataFrame(pdf), "y", ["x", "z"], "year", "month", len(partial))
    fit = gls.fit_at(sums, partial)
    loglik, beta, se = dense_restricted(pdf, partial)
    assert fit.loglik == pytest.approx(loglik, abs=1e-8)
    np.testing.assert_allclose(fit.beta, beta, rtol=1e-9)
    np.testing.assert_allclose(np.sqrt(np.diag(fit.covariance)), se, rtol=1e-9)
    if not share:
        assert sorted(sums.groups) == list(range(len(partial) + 1)) and sums.stretches is None


@pytest.mark.parametrize("p", [1, 2, 3])
def test_gls_finds_the_maximum(spark, p):
    pdf = series()
    df = spark.createDataFrame(pdf)
    got = gls.gls_ar(df, "y", ["x", "z"], "year", "month", p).toPandas()
    sums = gls.lag_sums(df, "y", ["x", "z"], "year", "month", p)
    best = got.log_lik[0]
    rng = np.random.default_rng(0)
    tried = [gls.fit_at(sums, q).loglik for q in rng.uniform(-0.95, 0.95, (600, p))]
    assert best >= max(tried)
    phi = np.array([got[f"phi_{i}"][0] for i in range(1, p + 1)])
    assert phi[0] == pytest.approx(0.5, abs=0.2)
    assert got.df_resid[0] == len(pdf) - 3


def test_gls_accepts_short_and_gapped_series_and_refuses_repeats(spark):
    pdf = series()
    short = pd.concat([pdf, pd.DataFrame([(2000, 13, 0.1, 0.2, 0.3), (2001, 13, 0.3, 0.1, 0.2)], columns=pdf.columns)])
    sums = gls.lag_sums(spark.createDataFrame(short), "y", ["x", "z"], "year", "month", 3)
    assert gls.fit_at(sums, [0.2, 0.1, 0.3]).loglik == pytest.approx(dense_restricted(short, [0.2, 0.1, 0.3])[0], abs=1e-8)
    with pytest.raises(ValueError, match="repeats"):
        gls.gls_ar(spark.createDataFrame(pd.concat([pdf, pdf.head(1)])), "y", ["x", "z"], "year", "month")
    # Gaps of any length: every second year, so that all earlier rows of a series matter.
    gapped = pdf.assign(year=pdf.year * 2)
    for partial in ([0.4], [0.4, -0.2]):
        sums = gls.lag_sums(spark.createDataFrame(gapped), "y", ["x", "z"], "year", "month", len(partial))
        assert gls.fit_at(sums, partial).loglik == pytest.approx(dense_restricted(gapped, partial)[0], abs=1e-8)


def irregular(seed=11, series_=4, n=60):
    """Times with gaps of any length, and stretches without."""
    rng = np.random.default_rng(seed)
    out = []
    for m in range(series_):
        at = np.cumsum(np.where(rng.random(n) < 0.5, 1, rng.integers(1, 40, n)))
        for t in at:
            x, z = rng.normal(size=2)
            out.append((int(t), m, x, z, 0.4 * x - 0.2 * z + rng.normal()))
    return pd.DataFrame(out, columns=["year", "month", "x", "z", "y"])


def test_likelihood_of_irregular_times_for_all_orders_from_one_set_of_sums(spark):
    pdf = irregular()
    gap = pdf.year.max() + 2
    sums = gls.lag_sums(spark.createDataFrame(pdf).repartition(5), "y", ["x", "z"], "year", "month", 3)
    for partial in ([0.4], [0.95], [0.4, -0.2], [-0.5, 0.7], [0.3, 0.2, -0.6]):
        _, rho = gls.ar_from_partial(partial, gap)
        same = pdf.month.to_numpy()[:, None] == pdf.month.to_numpy()[None, :]
        v = np.where(same, rho[np.abs(np.subtract.outer(pdf.year.to_numpy(), pdf.year.to_numpy())) % gap], 0.0)
        x, y = np.column_stack([np.ones(len(pdf)), pdf.x, pdf.z]), pdf.y.to_numpy()
        inv = np.linalg.inv(v)
        xx = x.T @ inv @ x
        beta = np.linalg.solve(xx, x.T @ inv @ y)
        s2 = (y - x @ beta) @ inv @ (y - x @ beta) / (len(y) - 3)
        want = -0.5 * ((len(y) - 3) * (np.log(2 * np.pi * s2) + 1) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(xx)[1])
        fit = gls.fit_at(sums, partial)
        assert fit.loglik == pytest.approx(want, abs=1e-7)
        np.testing.assert_allclose(fit.beta, beta, rtol=1e-8)


@pytest.mark.parametrize("p", [1, 2])
def test_gls_finds_the_maximum_of_irregular_times(spark, p):
    pdf = gaps(series(), 0.3)
    sums = gls.lag_sums(spark.createDataFrame(pdf), "y", ["x", "z"], "year", "month", p)
    assert sums.stretches is not None
    best = gls.maximum(sums, p)
    inner = gls._maximise(lambda q: dense_restricted(pdf, q)[0], 1)[None] if p == 1 else None
    rng = np.random.default_rng(0)
    tried = gls.fit_many(sums, rng.uniform(-0.95, 0.95, (400, p)))
    assert best.loglik >= max(f.loglik for f in tried)
    if inner is not None:
        assert best.phi[0] == pytest.approx(inner[0, 0], abs=1e-5)


def test_long_irregular_series_need_little_memory_on_the_driver(spark):
    """5,000 times a series: only sums per trial come back."""
    rng = np.random.default_rng(3)
    rows = [(m, int(t), float(x), float(0.5 * x + e)) for m in range(3)
            for t, x, e in zip(np.cumsum(rng.integers(1, 9, 5000)), rng.normal(size=5000), rng.normal(size=5000))]
    sums = gls.lag_sums(spark.createDataFrame(rows, "g long, t long, x double, y double"), "y", ["x"], "t", "g", 1)
    assert sum(p.nbytes for _, p in sums.groups.values()) < 10_000 and sums.rows == 15_000
    fit = gls.maximum(sums, 1)
    assert abs(fit.phi[0]) < 0.1 and fit.beta[1] == pytest.approx(0.5, abs=0.03)


def random_panel(seed, units, levels, n):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"u": rng.integers(0, units, n), "l": rng.integers(0, levels, n), "year": rng.integers(2000, 2004, n), "x": rng.normal(size=n), "z": rng.normal(size=n)})
    pdf["y"] = 0.3 * pdf.x - 0.7 * pdf.z + np.sin(pdf.u) * 5 + np.cos(pdf.l) * 3 + pdf.year % 3 + rng.normal(size=n)
    return pdf


@pytest.mark.parametrize("by", [["u", "l"], ["u", "l", "year"]])
def test_two_large_factors_by_rounds(spark, by):
    """By conjugate gradients, by the matrix, and by dummies; the level graph falls into several components."""
    a, b = random_panel(1, 12, 9, 150), random_panel(2, 7, 6, 60)
    b["u"], b["l"] = b.u + 50, b.l + 50
    pdf = pd.concat([a, b, pd.DataFrame([(99, 99, 2001, 0.3, 0.1, 4.0)], columns=["u", "l", "year", "x", "z", "y"])])
    df = spark.createDataFrame(pdf).repartition(4)
    by_rounds = absorb_ols(df, "y", ["x", "z"], by, dense_levels=5).toPandas()
    by_matrix = absorb_ols(df, "y", ["x", "z"], by).toPandas()
    pd.testing.assert_frame_equal(by_rounds, by_matrix, rtol=1e-9)
    dummies = [pd.get_dummies(pdf[f]).to_numpy(float) for f in by]
    design = np.hstack([pdf[["x", "z"]].to_numpy(), *dummies])
    beta, _, rank, _ = np.linalg.lstsq(design, pdf.y.to_numpy(), rcond=None)
    np.testing.assert_allclose(by_rounds.estimate, beta[:2], rtol=1e-9)
    assert by_rounds.df_resid[0] == len(pdf) - rank


def test_too_many_large_factors_are_refused(spark):
    df = spark.createDataFrame(random_panel(1, 12, 9, 150)).withColumn("m", F.col("l") + 1)
    with pytest.raises(ValueError, match="only two factors"):
        absorb_ols(df, "y", ["x"], ["u", "l", "m"], dense_levels=5)


def test_plans_do_not_grow_with_levels(spark):
    from almanaq.operators import blocks

    sizes = []
    for n in (10, 1000):
        df = spark.range(3000).select((F.col("id") % 7).alias("u"), (F.col("id") % n).alias("l"), F.rand(1).alias("y"))
        numbered = blocks.number_levels(df, ["l"], blocks.factor_levels(df, ["l"]))
        sizes.append(len(blocks.unit_blocks(numbered, "u", ["y"])._jdf.queryExecution().optimizedPlan().treeString()))
    assert sizes[1] < 1.2 * sizes[0]


def test_variables_without_effects_end_the_rounds(spark, monkeypatch):
    """Cells whose sums are rounding errors: no round makes such a residual smaller."""
    from almanaq.operators import demean

    rng = np.random.default_rng(9)
    pdf = pd.DataFrame([(u, l, i) for u in range(25) for l in range(7) for i in range(12)], columns=["u", "l", "i"])
    pdf["x"], pdf["y"] = rng.normal(size=(2, len(pdf))) * 1e3
    pdf["y"] -= pdf.groupby(["u", "l"]).y.transform("mean")
    df = spark.createDataFrame(pdf)
    monkeypatch.setattr(demean, "_PATIENCE", 6)
    rounds, dense = (absorb_ols(df, "y", ["x"], ["u", "l"], dense_levels=n).toPandas() for n in (0, 2500))
    np.testing.assert_allclose(rounds[["estimate", "std_error"]], dense[["estimate", "std_error"]], rtol=1e-9)


def test_components_are_looked_for_among_units(spark, monkeypatch):
    """30 units with 200 levels and 5 with 40 others: 6,200 cells, an edge per unit."""
    from almanaq.operators import demean

    cells = [(u, l) for u in range(30) for l in range(200)] + [(u, l) for u in range(40, 45) for l in range(300, 340)] + [(60, 400)]
    edges = []
    connected = demean.connected
    monkeypatch.setattr(demean, "connected", lambda e: edges.append(e.count()) or connected(e))
    assert demean.components_of(spark.createDataFrame(cells, "u long, l long"), "u", "l") == 3
    assert edges == [36]


def test_components(spark):
    from almanaq.operators.graph import connected

    rng = np.random.default_rng(4)
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(100)] + [(f"m{a}", f"m{b}") for a, b in rng.integers(0, 60, (40, 2))] + [("z", "z")]
    want = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == want


def test_query_with_two_large_factors(spark):
    """The registered query on the small table against dummies."""
    from workload.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").join(spark.read.parquet(f"{sf}/orders.parquet").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    pdf = lines.select("l_extendedprice", "l_quantity", "l_discount", "l_suppkey", "o_custkey").toPandas().astype(float)
    design = np.hstack([pdf[["l_quantity", "l_discount"]].to_numpy(), *[pd.get_dummies(pdf[f]).to_numpy(float) for f in ("l_suppkey", "o_custkey")]])
    beta, _, rank, _ = np.linalg.lstsq(design, pdf.l_extendedprice.to_numpy(), rcond=None)
    got = QUERIES["absorb_supplier_customer"](spark, sf).toPandas().set_index("term")
    np.testing.assert_allclose(got.loc[["l_quantity", "l_discount"], "estimate"], beta[:2], rtol=1e-6)
    assert set(got.df_resid) == {len(pdf) - rank}


def test_qr_keeps_digits_that_normal_equations_lose(spark):
    from almanaq.operators.qr import lm_qr

    rng = np.random.default_rng(6)
    n = 3000
    pdf = pd.DataFrame({"year": rng.integers(2000, 2006, n), "month": rng.integers(1, 13, n), "x": rng.normal(size=n) + 5})
    pdf["z"] = pdf.x + 1e-5 * rng.normal(size=n)
    pdf["y"] = 2 * pdf.x - 3 * pdf.z + pdf.year % 2 + rng.normal(size=n)
    design = np.hstack([pdf[["x", "z"]].to_numpy(), pd.get_dummies(pdf.year).to_numpy(float), pd.get_dummies(pdf.month, drop_first=True).to_numpy(float)])
    q, r = np.linalg.qr(design)
    beta = np.linalg.solve(r, q.T @ pdf.y.to_numpy())
    rss = ((pdf.y - design @ beta) ** 2).sum()
    se = np.sqrt(rss / (n - design.shape[1]) * (np.linalg.inv(r) ** 2).sum(1))
    df = spark.createDataFrame(pdf)
    got = lm_qr(df.repartition(40), "y", ["x", "z"], ["year", "month"]).toPandas()  # a tree of two levels
    np.testing.assert_allclose(got.estimate, beta[:2], rtol=1e-8)
    np.testing.assert_allclose(got.std_error, se[:2], rtol=1e-8)
    assert got.df_resid[0] == n - design.shape[1]
    one = lm_qr(df.withColumn("w", F.col("x") * 2 + 1).limit(50), "y", ["x", "w"]).toPandas()
    assert one.estimate.isna().tolist() == [False, True]
    with pytest.raises(ValueError, match="no complete rows"):
        lm_qr(df.where("x is null"), "y", ["x"], ["year"])
