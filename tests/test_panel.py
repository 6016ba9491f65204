import pytest

from almanaq.operators import panel, reshape


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_merge_matches_nulls_and_refuses_shared_names(spark):
    a = spark.createDataFrame([("x", 1, 1.0), (None, 1, 2.0)], "unit string, month int, p double")
    b = spark.createDataFrame([(None, 1, 5.0), ("y", 1, 6.0)], "unit string, month int, q double")
    assert rows(panel.merge(a, b, ["unit", "month"]), "unit", "p", "q") == [(None, 2.0, 5.0)]
    assert rows(panel.merge(a, b, ["unit", "month"], "full"), "unit", "p", "q") == [("x", 1.0, None), ("y", None, 6.0), (None, 2.0, 5.0)]
    with pytest.raises(ValueError, match="rename"):
        panel.merge(a, b.withColumnRenamed("q", "p"), ["unit", "month"])


def test_skeleton_fill_keeps_row_count(spark):
    skeleton = spark.createDataFrame([("a", 2003, 1), ("a", 2003, 2), (None, 2003, 1)], "unit string, year int, month int")
    facts = spark.createDataFrame([("a", 2003, 1, 4), (None, 2003, 1, 2), ("z", 2003, 1, 9)], "unit string, year int, month int, n int")
    got = panel.skeleton_fill(skeleton, facts, ["unit", "year", "month"], "n")
    assert rows(got, "unit", "month", "n") == [("a", 1, 4), ("a", 2, 0), (None, 1, 2)]


def test_complete_grid_keeps_outside_rows(spark):
    df = spark.createDataFrame([(1999, 5, 7), (2000, 1, 3), (2000, 2, None)], "year int, month int, n int")
    got = reshape.complete_grid(df, "n", (2000, 2001)).collect()
    assert len(got) == 25
    cell = {(r["year"], r["month"]): r["n"] for r in got}
    assert cell[1999, 5] == 7 and cell[2000, 1] == 3 and cell[2000, 2] == 0 and cell[2001, 12] == 0


def test_lookup_hole_gives_null_then_zero_and_is_audited(spark):
    facts = spark.createDataFrame([("México", 5), ("Puebla", 6), (None, 1)], "name string, total int")
    names = spark.createDataFrame([("MX15", "MEXICO"), ("Puebla", "PUEBLA")], "name string, state string")
    assert rows(panel.lookup_join(facts, names, "name", "name"), "name", "state", "total") == [
        ("México", None, 5), ("Puebla", "PUEBLA", 6), (None, None, 1)]
    assert rows(panel.unmatched_keys(facts, names, "name", "name"), "name", "rows") == [("México", 1), (None, 1)]


def test_lookup_fan_out(spark):
    units = spark.createDataFrame([("a", 1), ("b", 2)], "name string, code int")
    series = spark.createDataFrame([("a", 2000, 1.0), ("a", 2001, 2.0)], "name string, year int, t double")
    assert rows(panel.lookup_join(units, series, "name", "name"), "code", "year", "t") == [(1, 2000, 1.0), (1, 2001, 2.0), (2, None, None)]


def test_splice(spark):
    old = spark.createDataFrame([(2014, 1), (2015, 2)], "year int, n int")
    new = spark.createDataFrame([(3, 2015), (4, 2014)], "n int, year int")
    assert rows(panel.splice(old, new, 2015), "year", "n") == [(2014, 1), (2014, 4), (2015, 3)]


def test_overlapping_periods_and_profile(spark):
    df = spark.createDataFrame([("a", y, 1, float(y)) for y in range(2000, 2006)] + [("a", 2003, 1, None)], "unit string, year int, month int, v double")
    got = panel.period_profile(df, (("early", 2000, 2003), ("late–", 2003, 2005), ("never", 1900, 1950)), "v")
    assert rows(got, "period_ord", "period", "month", "mean_v") == [(1, "early", 1, 2001.5), (2, "late–", 1, 2004.0)]
    assert rows(panel.recent_profile(df, "unit", (2002, 2004), {"m": "v"}), "unit", "month", "m") == [("a", 1, 2002.5)]


def test_unpivot(spark):
    wide = spark.createDataFrame([("c", 1.0, None, "x")], "code string, `X1950.01` double, `X1950.12` double, X19501 string")
    assert rows(reshape.unpivot_matching(wide, ["code"]), "code", "year", "month", "value") == [("c", 1950, 1, 1.0), ("c", 1950, 12, None)]
    months = spark.createDataFrame([(2000, 1, 2, 3, 9)], "Ano int, Enero int, Febrero int, Marzo int, Total int")
    assert rows(reshape.unpivot_between(months, ["Ano"], "Enero", "Marzo"), "Ano", "month", "value") == [(2000, 1, 1), (2000, 2, 2), (2000, 3, 3)]
