import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanaq.fixed import SPANISH_MONTHS
from almanaq.functions import calendar as cal
from almanaq.functions import scalar, student, text


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expr).first()[0]


@pytest.mark.parametrize("raw, want", [
    ("05/03/2020", dt.date(2020, 3, 5)), ("5-3-2020", dt.date(2020, 3, 5)), ("5.3.2020", dt.date(2020, 3, 5)),
    ("31/02/2020", None), ("", None), (None, None), ("2020", None), ("1/2/68", dt.date(2068, 2, 1)), ("1/2/69", dt.date(1969, 2, 1)),
])
def test_parse_day_month_year(spark, raw, want):
    assert one(spark, cal.parse_dmy("s"), s=raw) == want


def test_parse_month_day_year_after_clock(spark):
    assert one(spark, cal.parse_mdy(cal.strip_clock("s")), s="11/05/2020 03:04:05 PM") == dt.date(2020, 11, 5)
    assert one(spark, cal.parse_mdy(cal.strip_clock("s")), s="13/05/2020 03:04:05 PM") is None


def test_month_names(spark):
    assert one(spark, cal.month_name("m"), m=9) == "September"
    assert one(spark, cal.month_name("m"), m=13) is None
    assert one(spark, cal.month_number("s", SPANISH_MONTHS), s=" Septiembre") == 9
    assert one(spark, cal.month_number("s", SPANISH_MONTHS), s="Total") is None
    assert one(spark, cal.month_start(F.lit(2020), F.lit(2)), s="x") == dt.date(2020, 2, 1)


def test_admin_codes_drop_one_zero_only(spark):
    df = spark.createDataFrame([("CO05001",), ("CO25001",), ("CO00123",), ("bad",), (None,)], "code string")
    got = [tuple(r) for r in text.admin_codes(df, "code", "dep", "muni").collect()]
    assert got == [
        ("CO05001", 5, 5001), ("CO25001", 25, 25001), ("CO00123", 0, 123), ("bad", None, None), (None, None, None)]
    assert one(spark, text.drop_one_zero("s"), s="007") == "07"


def test_term_filters(spark):
    df = spark.createDataFrame(
        [("Battery",), ("Battery - Domestic",), ("battery",), ("Theft",), (None,), ("Battery (x.y)",)], "kind string")
    kept = text.keep_any(df, "kind", ["Battery", "a.b"])
    assert [r[0] for r in kept.collect()] == ["Battery", "Battery - Domestic", "Battery (x.y)"]
    assert [r[0] for r in text.drop_any(kept, "kind", ["Domestic", "(x.z)"]).collect()] == ["Battery", "Battery (x.y)"]
    # NULL text goes in both directions.
    assert text.drop_any(df, "kind", ["Domestic"]).where("kind is null").count() == 0


def test_codepage_and_folding(spark):
    assert one(spark, text.decode_codepage("s", "cp850"), s="M\x82xico Le\xa2n Michoac\xa0n") == "México León Michoacán"
    folded = {one(spark, text.fold_key("s"), s=s) for s in ("Michoacán", "Michoac n", "Michoac\xa0n", "MICHOAC N")}
    assert folded == {"michoac_n"}


def test_sums_and_missing_values(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, None), (3, 2.0), (3, 3.0)], "k int, x double")
    got = {r["k"]: (r["strict"], r["skip"]) for r in df.groupBy("k").agg(
        scalar.strict_sum("x").alias("strict"), scalar.skip_sum("x").alias("skip")).collect()}
    assert got == {1: (None, 1.0), 2: (None, 0.0), 3: (5.0, 5.0)}


def test_direction_flag(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (-1.0,), (None,)], "d double")
    assert [r[0] for r in df.select(scalar.above_below("d")).collect()] == ["Above", "Below", "Below", None]


def test_signed_sqrt(spark):
    df = spark.createDataFrame([(4.0,), (-9.0,), (0.0,), (None,)], "d double")
    assert [r[0] for r in df.select(scalar.signed_sqrt("d")).collect()] == [2.0, -3.0, 0.0, None]


def test_student_against_printed_values(spark):
    q = student.quantiles(0.975)
    for df, want in ((1, 12.706204736), (2, 4.302652730), (5, 2.570581836), (30, 2.042272456), (120, 1.979930405)):
        assert q[df - 1] == pytest.approx(want, abs=2e-9)
    assert student.two_sided_p(2.228138852, 10)[0] == pytest.approx(0.05, abs=1e-9)
    assert student.two_sided_p([0.0, 40.0], 5)[0] == 1.0
    assert np.isnan(student.two_sided_p(1.0, 0)[0])
    rows = spark.createDataFrame([(0,), (5,), (200,), (201,), (100000,)], "df int").select(
        student.quantile_column(0.975, F.col("df"))).collect()
    assert rows[0][0] is None
    assert rows[1][0] == pytest.approx(2.570581836, abs=2e-9)
    assert rows[2][0] - rows[3][0] == pytest.approx(0.0000592, abs=2e-6)
    assert rows[4][0] == pytest.approx(1.959988, abs=1e-6)


def test_p_column_matches_driver(spark):
    df = spark.createDataFrame([(0.5,), (-2.0,), (None,)], "t double")
    got = [r[0] for r in df.select(student.two_sided_p_column(F.col("t"), 17)).collect()]
    assert got[2] is None
    assert got[:2] == pytest.approx(list(student.two_sided_p([0.5, 2.0], 17)))
