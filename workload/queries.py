"""One Spark query per operator and per composed analysis, over the driver's tables.

Stand-ins: shipments (``lineitem``) are the dense measure, their mean price the third covariate, ``orders`` the
incidents, ``nation`` the unit and ``region`` its parent; 2001 is the partial last year.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanaq.fixed import SPANISH_MONTHS
from almanaq.functions.calendar import month_name, parse_dmy, parse_mdy, strip_clock, with_year_month
from almanaq.functions.scalar import prefer
from almanaq.functions.text import admin_codes, decode_codepage, drop_any, fold_key, keep_any
from almanaq.operators import geo, rings
from almanaq.operators.absorb import absorb_ols
from almanaq.operators.aggregate import levels, monthly, monthly_through_lookup
from almanaq.operators.anomaly import deviation, period_index, standardised_deviation, zscore
from almanaq.operators.coefficients import coef_interval, terms_matching
from almanaq.operators.density import weighted_kde
from almanaq.operators.gls import gls_ar, gls_ar_profile
from almanaq.operators.panel import (
    lookup_join, merge, period_profile, recent_profile, skeleton_fill, splice, unmatched_keys,
)
from almanaq.operators.qr import lm_qr
from almanaq.operators.ranges import range_join, skewed_lookup_join
from almanaq.operators.reshape import complete_grid, unpivot_between, unpivot_matching
from almanaq.operators.slopes import interaction_table, unit_slopes
from almanaq.operators.trend import trend_lines, trend_lm
from almanaq.operators.within import fe_within
from almanaq.plans import national, places, units
from almanaq.sources.files import bad_cells, make_names, read_csv, read_named, read_wide_series
from almanaq.sources.lookups import lookup
from almanaq.sources.tables import materialise, materialise_all, read_polygons, read_table, shared_dir, write_results, write_table

PARTIAL_YEAR = 2001
CITY_SHIFT = 24  # to the city's partial year
SKELETON_FROM = 1996
PERIODS = (("1995–1996", 1995, 1996), ("1996–1998", 1996, 1998), ("1999-2001", 1999, 2001))
KEEP_TERMS, DROP_TERMS = ("widget", "bolt", "anvil"), ("red", "small")
PRIORITIES = (("1-URGENT", "U"), ("2-HIGH", "H"), ("4-NOT SPECIFIED", "N"), ("5-LOW", "L"))
# Partial autocorrelations at which the likelihood of each order is compared.
PARTIALS = {
    1: tuple((i / 10,) for i in range(-9, 10)),
    2: tuple((i / 4, j / 4) for i in range(-3, 4) for j in range(-3, 4)),
    3: tuple((i / 2, j / 2, k / 2) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)),
}
GAPPED_PARTIALS = {
    1: ((-0.5,), (0.3,), (0.9,)),
    2: ((0.4, -0.2), (-0.3, 0.6), (0.8, 0.5)),
    3: ((0.4, -0.2, 0.3), (-0.6, 0.2, -0.5), (0.9, 0.3, 0.1)),
}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Registers a query; its doubles are rounded to six digits, without negative zeros."""

    def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(fn(spark, sf_dir))

    QUERIES[fn.__name__] = rounded
    return fn


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    unit = 10.0 ** digits

    def shape(f: T.StructField) -> Column:
        c = F.col(f.name)
        return (F.round(c * unit) / unit + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else c

    return df.select(*[shape(f) for f in df.schema.fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return with_year_month(table(spark, sf_dir, "lineitem"), "l_shipdate").withColumn("price_cents", cents)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_year_month(table(spark, sf_dir, "orders"), "o_orderdate")


def in_thousands(df: DataFrame) -> DataFrame:
    """Cents to about thousands; the prime keeps quotients off the rounding ties of the comparison."""
    return df.withColumn("temperature", F.col("temperature") / 99991)


def national_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year, month, rfh, temperature) of all shipments."""
    return in_thousands(shipments(spark, sf_dir).groupBy("year", "month").agg(
        F.sum("l_quantity").alias("rfh"), (F.sum("price_cents") / F.count("price_cents")).alias("temperature")))


def national_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly(orders(spark, sf_dir), None, na="count", out="incidents")


def nation_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nation, year, month, rfh, temperature) of all shipments."""
    cells = monthly_through_lookup(
        shipments(spark, sf_dir), table(spark, sf_dir, "supplier"), "l_suppkey", "s_suppkey", "s_nationkey",
        {"rfh": ("strict", "l_quantity"), "temperature": ("mean", "price_cents")})
    return in_thousands(cells).withColumnRenamed("s_nationkey", "nation")


def nation_orders(spark: SparkSession, sf_dir: str, priority: str | None = None) -> DataFrame:
    facts = orders(spark, sf_dir)
    if priority is not None:
        facts = facts.where(F.col("o_orderpriority") == priority)
    cells = monthly_through_lookup(
        facts, table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", "c_nationkey", {"incidents": ("count", None)})
    return cells.withColumnRenamed("c_nationkey", "nation")


# --- aggregates -----------------------------------------------------------------------------------------------------

@query
def monthly_strict_sum(spark, sf_dir):
    hole = (F.col("l_quantity") == 50) & (F.col("l_tax") == 0.08) & (F.col("l_linenumber") == 7)
    facts = shipments(spark, sf_dir).withColumn("rfh", F.when(~hole, F.col("l_quantity")))
    return monthly(facts, "rfh", na="strict")


@query
def monthly_skip_sum(spark, sf_dir):
    facts = shipments(spark, sf_dir).withColumn("rfh", F.when(F.col("l_quantity") > 45, F.col("l_quantity")))
    return monthly(facts, "rfh", ["l_suppkey", "year", "month"], na="skip")


@query
def monthly_mean(spark, sf_dir):
    facts = shipments(spark, sf_dir).withColumn("rfh", F.when(F.col("l_quantity") > 45, F.col("l_quantity")))
    return monthly(facts, "rfh", ["l_suppkey", "month"], na="mean", out="mean_rfh")


@query
def monthly_count(spark, sf_dir):
    return national_orders(spark, sf_dir)


@query
def monthly_through_supplier(spark, sf_dir):
    return nation_shipments(spark, sf_dir)


@query
def agg_levels(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("region"))
    cells = nation_shipments(spark, sf_dir).select("nation", "year", "month", "rfh")
    return levels(lookup_join(cells, nations, "nation", "n_nationkey"), "rfh", "nation", "region")


# --- anomalies ------------------------------------------------------------------------------------------------------

@query
def month_deviation(spark, sf_dir):
    return national.rainfall_anomaly(national_shipments(spark, sf_dir).select("year", "month", "rfh"))


@query
def unit_month_deviation(spark, sf_dir):
    cells = nation_shipments(spark, sf_dir).select("nation", "year", "month", "rfh")
    return deviation(cells, "rfh", ["month", "nation"], flag="above_below_avg")


@query
def zscore_by_year(spark, sf_dir):
    return zscore(nation_orders(spark, sf_dir), {"standardized_incidents": "incidents"}, ["year"])


@query
def zscore_by_month(spark, sf_dir):
    return zscore(national_orders(spark, sf_dir), {"standardized_incidents": "incidents"}, ["month"])


@query
def zscore_global(spark, sf_dir):
    cells = national_shipments(spark, sf_dir)
    return zscore(cells, {"scaled_rfh": "rfh", "scaled_temperature": "temperature"}, [])


@query
def standardised_month_deviation(spark, sf_dir):
    return national.incident_anomaly(national_orders(spark, sf_dir))


@query
def standardised_unit_deviation(spark, sf_dir):
    return standardised_deviation(nation_orders(spark, sf_dir), "incidents", ["year"], ["month", "nation"])


@query
def period_index_by_month(spark, sf_dir):
    return period_index(materialise(nation_orders(spark, sf_dir))).select("nation", "year", "month", "date", "time", month_name("month").alias("month_name"))


# --- reshaping ------------------------------------------------------------------------------------------------------

def _labels(cells, label):
    """Month labels that occur, in order: at most twelve a year."""
    return sorted(row[0] for row in cells.select(label).distinct().collect())


@query
def unpivot_matching_columns(spark, sf_dir):
    cells = nation_shipments(spark, sf_dir)
    label = F.concat_ws("-", F.col("year").cast("string"), F.lpad(F.col("month").cast("string"), 2, "0"))
    wide = cells.withColumn("_label", label).groupBy("nation").pivot("_label", _labels(cells, label)).agg(F.max("temperature"))
    return unpivot_matching(make_names(wide), ["nation"], value="temperature")


@query
def unpivot_between_columns(spark, sf_dir):
    spanish = F.get(F.array(*[F.lit(m) for m in SPANISH_MONTHS]), F.col("month") - 1)
    counts = nation_orders(spark, sf_dir).withColumn("_name", spanish)
    wide = counts.groupBy("nation", "year").pivot("_name", list(SPANISH_MONTHS)).agg(F.sum("incidents"))
    return unpivot_between(wide, ["nation", "year"], "ENERO", "DICIEMBRE", value="incidents")


@query
def complete_month_grid(spark, sf_dir):
    return complete_grid(national_orders(spark, sf_dir), "incidents", (1996, 2002))


# --- panels ---------------------------------------------------------------------------------------------------------

@query
def zero_filled_skeleton(spark, sf_dir):
    skeleton = nation_shipments(spark, sf_dir).where(F.col("year") >= SKELETON_FROM)
    return skeleton_fill(skeleton, nation_orders(spark, sf_dir), ["nation", "year", "month"], "incidents")


@query
def spliced_series(spark, sf_dir):
    old = monthly(orders(spark, sf_dir), None, na="count", out="total")
    new = monthly(shipments(spark, sf_dir), None, na="count", out="total")
    return splice(old, new, 1998)


@query
def merged_panel(spark, sf_dir):
    rain = nation_shipments(spark, sf_dir).select("nation", "year", "month", "rfh")
    urgent = nation_orders(spark, sf_dir, "1-URGENT").withColumnRenamed("incidents", "urgent")
    both = merge(rain, nation_orders(spark, sf_dir), ["year", "month", "nation"])
    return merge(both, urgent, ["year", "month", "nation"], "left")


@query
def inline_lookup(spark, sf_dir):
    codes = lookup(spark, PRIORITIES, ["priority", "code"])
    counted = monthly(orders(spark, sf_dir), None, ["o_orderpriority", "year", "month"], na="count", out="total")
    named = lookup_join(counted, codes, "o_orderpriority", "priority")
    return monthly(named, "total", ["code", "year", "month"], na="skip")


@query
def table_lookup(spark, sf_dir):
    """Customers without an order and orders of all customers: the lookup holds more than the facts, and the reverse."""
    counted = monthly(orders(spark, sf_dir), None, ["o_orderkey", "year"], na="count", out="orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return lookup_join(counted, customers, "o_orderkey", "c_custkey")


@query
def folded_lookup(spark, sf_dir):
    """Keys that lost a letter to a space on one side still meet after folding."""
    nations = table(spark, sf_dir, "nation").select(F.replace("n_name", F.lit("_"), F.lit(" ")).alias("name"), "n_regionkey")
    customers = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    keyed = customers.select(F.concat(F.lit("Nationé"), F.col("c_nationkey").cast("string")).alias("key"), "customers")
    return lookup_join(keyed, nations, "key", "name", fold=True)


@query
def lookup_fan_out(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_name", "n_nationkey")
    series = nation_shipments(spark, sf_dir).select("nation", "year", "month", "rfh")
    return lookup_join(nations, series, "n_nationkey", "nation")


@query
def unmatched_lookup_keys(spark, sf_dir):
    codes = lookup(spark, PRIORITIES, ["priority", "code"])
    return unmatched_keys(orders(spark, sf_dir), codes, "o_orderpriority", "priority")


@query
def period_profile_means(spark, sf_dir):
    return period_profile(national_shipments(spark, sf_dir), PERIODS, "rfh")


@query
def recent_profile_means(spark, sf_dir):
    means = {"mean_rfh": "rfh", "mean_temperature": "temperature"}
    return recent_profile(nation_shipments(spark, sf_dir), "nation", (1999, 2001), means)


# --- text and dates -------------------------------------------------------------------------------------------------

@query
def text_keep_drop(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return drop_any(keep_any(parts, "p_name", KEEP_TERMS), "p_name", DROP_TERMS)


@query
def legacy_text(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select("p_partkey", F.translate("p_name", "ae", "\xa0\x82").alias("raw"))
    return raw.select("p_partkey", decode_codepage("raw", "cp850").alias("text"), fold_key("raw").alias("folded"))


@query
def date_parsing(spark, sf_dir):
    low = F.col("o_orderpriority") == "5-LOW"
    texts = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(low, F.concat(F.lit("31/02/"), F.year("o_orderdate"))).otherwise(F.date_format("o_orderdate", "d/M/yyyy")).alias("dmy"),
        F.concat(F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit(" 11:05:09 PM")).alias("mdy"))
    dates = texts.select("o_orderkey", parse_dmy("dmy").alias("date_dmy"), parse_mdy(strip_clock("mdy")).alias("date_mdy"))
    return with_year_month(dates, "date_dmy")


@query
def administrative_codes(spark, sf_dir):
    code = F.concat(
        F.lit("CO"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0"), F.lpad(F.col("s_suppkey").cast("string"), 7, "0"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", code.alias("code"))
    return admin_codes(suppliers, "code", "parent_code", "unit_code")


@query
def range_profile(spark, sf_dir):
    """As many overlapping ranges as orders, each of 0 to 9 days from the order on: the shipments of its days."""
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    spans = table(spark, sf_dir, "orders").select("o_orderkey", day("o_orderdate").alias("lo"), (day("o_orderdate") + F.col("o_custkey") % 10).alias("hi"))
    lines = table(spark, sf_dir, "lineitem").select(day("l_shipdate").alias("day"), "l_quantity")
    # Shipments of one day lie in the same ranges: they meet them as one row.
    daily = lines.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))
    return range_join(daily, spans, "day", "lo", "hi").groupBy("o_orderkey").agg(F.sum("n").alias("shipments"), F.sum("quantity").alias("rfh"))


@query
def range_profile_by_supplier(spark, sf_dir):
    """Overlapping ranges of each supplier's own: months of its shipments, spread by as many months as its number says."""
    month = (F.col("year") * 12 + F.col("month")).cast("long")
    cells = monthly(shipments(spark, sf_dir), "l_quantity", ["l_suppkey", "year", "month"], na="strict", out="rfh").select("l_suppkey", month.alias("at"), "rfh")
    spans = cells.select("l_suppkey", F.col("at").alias("lo"), (F.col("at") + F.col("l_suppkey") % 14 - 1).alias("hi"))
    joined = range_join(cells, spans, "at", "lo", "hi", on=["l_suppkey"])
    return joined.groupBy("l_suppkey", "lo").agg(F.avg("rfh").alias("mean_rfh"), F.count(F.lit(1)).alias("months"))


@query
def skewed_lookup(spark, sf_dir):
    """Most shipments share a few return flags and many keys are NULL; the lookup has a NULL row of its own."""
    lines = shipments(spark, sf_dir).select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", F.lit(None)).otherwise(
        F.concat(F.col("l_returnflag"), (F.col("l_suppkey") * F.when(F.col("l_returnflag") == "A", 1).otherwise(0)).cast("string"))).alias("key"))
    dim = table(spark, sf_dir, "supplier").select(F.concat(F.lit("A"), F.col("s_suppkey").cast("string")).alias("name"), "s_nationkey").union(
        table(spark, sf_dir, "nation").select(F.when(F.col("n_regionkey") > 0, F.lit(None).cast("string")).otherwise(F.lit("R0")).alias("name"), "n_nationkey"))
    joined = skewed_lookup_join(lines, dim, "key", "name")
    return joined.groupBy("key", "s_nationkey").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_orderkey").alias("sum_orderkey"))


# --- models ---------------------------------------------------------------------------------------------------------

def national_cells(spark, sf_dir) -> list[DataFrame]:
    return materialise_all(national_shipments(spark, sf_dir), national_orders(spark, sf_dir))


def nation_cells(spark, sf_dir) -> list[DataFrame]:
    return materialise_all(nation_shipments(spark, sf_dir), nation_orders(spark, sf_dir))


def scaled_national_panel(spark, sf_dir, scale_by=("month",)) -> DataFrame:
    ship, order = national_cells(spark, sf_dir)
    return national.national_panel(
        ship.select("year", "month", "rfh"), order, ship.select("year", "month", "temperature"), scale_by)


def scaled_unit_panel(spark, sf_dir) -> DataFrame:
    ship, order = nation_cells(spark, sf_dir)
    keys = ["nation", "year", "month"]
    return units.unit_panel(
        ship.select(*keys, "rfh"), order, ship.select(*keys, "temperature"), "nation", SKELETON_FROM)


def complete_years(panel: DataFrame) -> DataFrame:
    return panel.where(F.col("year") != PARTIAL_YEAR)


def readable(coefs: DataFrame) -> DataFrame:
    return coef_interval(coefs)


@query
def fe_within_national(spark, sf_dir):
    rows = complete_years(scaled_national_panel(spark, sf_dir))
    return readable(fe_within(rows, national.OUTCOME, national.COVARIATES, "year"))


@query
def fe_within_units(spark, sf_dir):
    rows = complete_years(scaled_unit_panel(spark, sf_dir))
    return readable(fe_within(rows, national.OUTCOME, national.COVARIATES, "year"))


@query
def absorb_year_month(spark, sf_dir):
    rows = materialise(complete_years(scaled_national_panel(spark, sf_dir, scale_by=())))
    return readable(absorb_ols(rows, national.OUTCOME, national.COVARIATES, ["year", "month"]))


@query
def absorb_unit_year(spark, sf_dir):
    rows = materialise(complete_years(scaled_unit_panel(spark, sf_dir)))
    return readable(absorb_ols(rows, national.OUTCOME, national.COVARIATES, ["nation", "year"]))


@query
def absorb_unit_year_month(spark, sf_dir):
    rows = materialise(complete_years(scaled_unit_panel(spark, sf_dir)))
    return readable(absorb_ols(rows, national.OUTCOME, national.COVARIATES, ["nation", "year", "month"]))


@query
def absorb_unit_year_rounds(spark, sf_dir):
    """As if nations and years were too many for a matrix."""
    rows = materialise(complete_years(scaled_unit_panel(spark, sf_dir)))
    return readable(absorb_ols(rows, national.OUTCOME, national.COVARIATES, ["nation", "year"], dense_levels=0))


@query
def absorb_unit_year_month_rounds(spark, sf_dir):
    """As if nations and months were too many; the years stay few."""
    rows = materialise(complete_years(scaled_unit_panel(spark, sf_dir)))
    return readable(absorb_ols(rows, national.OUTCOME, national.COVARIATES, ["nation", "month", "year"], dense_levels=8))


@query
def absorb_supplier_customer(spark, sf_dir):
    """Two factors with many levels: price on quantity and discount, without the supplier's and the customer's effect."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    lines = materialise(lines.select("l_suppkey", "o_custkey", "l_extendedprice", "l_quantity", "l_discount"))  # several passes, one join
    return readable(absorb_ols(lines, "l_extendedprice", ["l_quantity", "l_discount"], ["l_suppkey", "o_custkey"], dense_levels=8))


@query
def lm_year_month(spark, sf_dir):
    """Year and month absorbed, by orthogonal factorisation of the dummy design."""
    rows = materialise(complete_years(scaled_national_panel(spark, sf_dir, scale_by=())))
    return readable(lm_qr(rows, national.OUTCOME, national.COVARIATES, ["year", "month"]))


@query
def lm_nearly_collinear(spark, sf_dir):
    """The second covariate is the first one and a ten-thousandth of another: normal equations lose half the digits."""
    rows = complete_years(scaled_unit_panel(spark, sf_dir))
    x, z = national.COVARIATES
    rows = materialise(rows.withColumn("near", F.col(x) + F.col(z) / 10000))
    fitted = readable(lm_qr(rows, national.OUTCOME, [x, "near"], ["year", "month"]))
    return fitted.select("term", "df_resid", "n_obs", *[(F.col(c) / 100).alias(c) for c in ("estimate", "std_error")], "t_value", "p_value")


def nation_slopes(spark, sf_dir) -> DataFrame:
    rows = materialise(complete_years(scaled_unit_panel(spark, sf_dir)))
    return unit_slopes(rows, national.OUTCOME, national.COVARIATES[0], national.COVARIATES[1:], "nation", "year")


@query
def unit_slope_table(spark, sf_dir):
    return nation_slopes(spark, sf_dir)


def _gls_profile(spark, sf_dir, partials) -> DataFrame:
    rows = complete_years(scaled_national_panel(spark, sf_dir))
    return gls_ar_profile(rows, national.OUTCOME, national.COVARIATES, "year", "month", partials)


@query
def gls_ar1_profile(spark, sf_dir):
    return _gls_profile(spark, sf_dir, PARTIALS[1])


@query
def gls_ar2_profile(spark, sf_dir):
    return _gls_profile(spark, sf_dir, PARTIALS[2])


@query
def gls_ar3_profile(spark, sf_dir):
    return _gls_profile(spark, sf_dir, PARTIALS[3])


def _gls(spark, sf_dir, p: int) -> DataFrame:
    """Rounded to four digits: a maximum is flat, its place is known to half the digits of its height."""
    rows = complete_years(scaled_national_panel(spark, sf_dir))
    return round_doubles(readable(gls_ar(rows, national.OUTCOME, national.COVARIATES, "year", "month", p)), 4)


@query
def gls_ar1(spark, sf_dir):
    return _gls(spark, sf_dir, 1)


@query
def gls_ar2(spark, sf_dir):
    return _gls(spark, sf_dir, 2)


@query
def gls_ar3(spark, sf_dir):
    return _gls(spark, sf_dir, 3)


def customer_months(spark, sf_dir) -> DataFrame:
    """A customer's orders month by month: most months of a series have none, so its times are irregular."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    cells = orders(spark, sf_dir).groupBy("o_custkey", (F.col("year") * 12 + F.col("month")).alias("time")).agg(
        (F.sum(cents) / F.count(F.lit(1)) / 9999991).alias("price"), F.count(F.lit(1)).cast("double").alias("orders"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("double").alias("urgent"))
    return cells


def _gapped(spark, sf_dir, p: int) -> DataFrame:
    return gls_ar_profile(customer_months(spark, sf_dir), "price", ["orders", "urgent"], "time", "o_custkey", GAPPED_PARTIALS[p])


@query
def gls_ar1_gapped(spark, sf_dir):
    return _gapped(spark, sf_dir, 1)


@query
def gls_ar2_gapped(spark, sf_dir):
    return _gapped(spark, sf_dir, 2)


@query
def gls_ar3_gapped(spark, sf_dir):
    return _gapped(spark, sf_dir, 3)


@query
def trend_line_fit(spark, sf_dir):
    cells = deviation(nation_shipments(spark, sf_dir).select("nation", "year", "month", "rfh"), "rfh", ["month", "nation"])
    return trend_lines(cells, "deviation", "year", ["nation", "month"])


@query
def trend_band(spark, sf_dir):
    series = national.temperature_anomaly(materialise(national_shipments(spark, sf_dir).select("year", "month", "temperature")))
    return trend_lm(series, "temperature_deviation", "year", ["month"])


@query
def weighted_density(spark, sf_dir):
    return weighted_kde(national_orders(spark, sf_dir), "month", "incidents", ["year"], adjust=0.6)


# --- geometry -------------------------------------------------------------------------------------------------------

def parcels(spark, sf_dir) -> DataFrame:
    """Vertices of one square parcel per customer on a grid of 200 columns; the BUILDING parcels have a hole."""
    # Dealt out before they are unfolded: a small file is one task's.
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").repartition("c_custkey")

    def corner(ring: int, seq: int, dx: float, dy: float) -> Column:
        return F.struct(
            F.lit(ring).alias("ring"), F.lit(seq).alias("seq"), F.lit(float(dx)).alias("dx"), F.lit(float(dy)).alias("dy"))

    outer = [corner(1, s, *p) for s, p in enumerate([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], 1)]
    hole = [corner(2, s, *p) for s, p in enumerate([(0.25, 0.25), (0.25, 0.5), (0.75, 0.5)], 1)]
    corners = F.when(F.col("c_mktsegment") == "BUILDING", F.array(*outer, *hole)).otherwise(F.array(*outer))
    column, row = F.col("c_custkey") % 200, F.floor(F.col("c_custkey") / 200)
    return customers.withColumn("_c", F.explode(corners)).select(
        F.col("c_custkey").alias("unit"), F.col("c_mktsegment").alias("parent"), F.col("_c.ring").alias("ring"),
        F.col("_c.seq").alias("seq"),
        (F.lit(-75.0) + (column + F.col("_c.dx")) / 61.0).alias("lon"), (F.lit(4.0) + (row + F.col("_c.dy")) / 61.0).alias("lat"))


@query
def planar_centroids(spark, sf_dir):
    return geo.centroids(parcels(spark, sf_dir), "unit").withColumn("area", F.col("area") * 3721)


@query
def spherical_centroids(spark, sf_dir):
    return geo.centroids(parcels(spark, sf_dir), "unit", "sphere")


@query
def dissolved_edges(spark, sf_dir):
    return geo.dissolve_edges(parcels(spark, sf_dir), "unit", "parent")


@query
def edge_multiplicities(spark, sf_dir):
    return geo.edge_multiplicity(parcels(spark, sf_dir), "unit", "parent")


@query
def dissolved_centroids(spark, sf_dir):
    return geo.outline_centroids(geo.dissolve_edges(parcels(spark, sf_dir), "unit", "parent"), "parent")


@query
def outline_rings(spark, sf_dir):
    """The dissolved segments as polygons: rings with their holes."""
    return rings.outline_rings(geo.dissolve_edges(parcels(spark, sf_dir), "unit", "parent"), "parent")


def split_parcels(spark, sf_dir) -> DataFrame:
    """Parcels of every second column are two low ones, so their neighbours' long borders touch vertices they don't have."""
    plots = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").repartition("c_custkey")
    column, row = F.col("c_custkey") % 200, F.floor(F.col("c_custkey") / 200)
    parts = F.when(column % 2 == 0, F.array(F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")))).otherwise(
        F.array(F.struct(F.lit(0.0).alias("lo"), F.lit(0.5).alias("hi")), F.struct(F.lit(0.5).alias("lo"), F.lit(1.0).alias("hi"))))
    plots = plots.select("*", column.alias("column"), row.alias("row"), F.posexplode(parts).alias("part", "span"))
    corners = F.array(*[F.struct(F.lit(dx).alias("dx"), F.col(f"span.{end}").alias("dy")) for dx, end in ((0.0, "lo"), (1.0, "lo"), (1.0, "hi"), (0.0, "hi"))])
    return plots.select("*", F.posexplode(corners).alias("seq", "corner")).select(
        (F.col("c_custkey") * 2 + F.col("part")).alias("unit"), F.col("c_mktsegment").alias("parent"), F.lit(1).alias("ring"), "seq",
        (F.lit(-75.0) + (F.col("column") + F.col("corner.dx")) / 61.0).alias("lon"), (F.lit(4.0) + (F.col("row") + F.col("corner.dy")) / 61.0).alias("lat"))


@query
def touching_outline(spark, sf_dir):
    return rings.dissolve_touching(split_parcels(spark, sf_dir), "unit", "parent")


@query
def slope_map(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    coefs = interaction_table(nation_slopes(spark, sf_dir), "nation")
    return geo.map_table(nations, coefs, "nation", ["n_name"])


def _supplier_profile(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    cells = monthly(shipments(spark, sf_dir), "l_quantity", ["l_suppkey", "year", "month"], na="strict", out="rfh").withColumnRenamed("l_suppkey", "unit")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit"), "p_name")
    return recent_profile(cells, "unit", (1999, 2001), {"mean_rfh": "rfh"}), parts


@query
def profile_on_map(spark, sf_dir):
    """Suppliers' profile beside the parts' names under the same numbers: some parts have no profile."""
    return geo.profile_map(*_supplier_profile(spark, sf_dir), "unit", keep_missing=True)


@query
def profile_with_months(spark, sf_dir):
    return geo.profile_map(*_supplier_profile(spark, sf_dir), "unit")


@query
def preferred_names(spark, sf_dir):
    """A customer's latest clerk wins where there is one; customers without orders keep their own name."""
    latest = orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    named = merge(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), latest, ["c_custkey"], "left")
    return named.select("c_custkey", prefer("latest", "c_name").alias("shown"))


@query
def sorted_figure_rows(spark, sf_dir):
    """Months in order, each with the cell before it in the sorted table."""
    saved = national.incident_anomaly(national_orders(spark, sf_dir)).orderBy("year", "month")
    path = scratch(spark)
    write_table(saved.coalesce(1), path)
    placed = read_table(spark, path).withColumn("_at", F.monotonically_increasing_id())
    before = placed.select((F.col("_at") + 1).alias("_at"), F.col("incident_deviation").alias("before"))
    return placed.join(before, "_at", "left").select("year", "month", "incident_deviation", "before")


# --- composed analyses ----------------------------------------------------------------------------------------------

@query
def national_panel(spark, sf_dir):
    return scaled_national_panel(spark, sf_dir)


@query
def city_panel(spark, sf_dir):
    """Incident text to monthly counts on a full grid, merged and rescaled over the whole table."""
    ship = materialise(national_shipments(spark, sf_dir))
    parts = drop_any(keep_any(table(spark, sf_dir, "part"), "p_name", KEEP_TERMS), "p_name", DROP_TERMS)
    # The filtered parts first: shipments of other parts never reach the count.
    events = shipments(spark, sf_dir).join(parts.select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    counted = monthly(events, None, na="count", out="incidents")
    counted = materialise(complete_grid(counted, "incidents", (1996, 2000)))
    return national.national_panel(
        ship.select("year", "month", "rfh"), counted, ship.select("year", "month", "temperature"), scale_by=())


@query
def unit_panel(spark, sf_dir):
    return scaled_unit_panel(spark, sf_dir)


@query
def region_panel(spark, sf_dir):
    """The panel one level up, without models."""
    ship, order = nation_cells(spark, sf_dir)
    regions = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("region"))

    def upper(cells: DataFrame, value: str, na: str) -> DataFrame:
        return monthly(lookup_join(cells, regions, "nation", "n_nationkey"), value, ["region", "year", "month"], na=na)

    rain, incidents = materialise_all(upper(ship, "rfh", "strict"), upper(order, "incidents", "skip"))
    return units.anomaly_panel(rain, incidents, "region", SKELETON_FROM)


@query
def unit_recent_profile(spark, sf_dir):
    return units.profile(scaled_unit_panel(spark, sf_dir), "nation", (1999, 2001))


@query
def period_densities(spark, sf_dir):
    return national.period_densities(national_shipments(spark, sf_dir), PERIODS, "rfh")


@query
def incident_trends(spark, sf_dir):
    anomaly = national.incident_anomaly(materialise(national_orders(spark, sf_dir)))
    return national.deviation_trends(anomaly, "incident_deviation", 1996)


# --- files ----------------------------------------------------------------------------------------------------------

def scratch(spark) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_dir(spark)}/almanaq-{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> str:
    (df.write.option("header", True).option("nullValue", "NA").option("escape", '"').option("encoding", encoding)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


@query
def csv_bad_cells(spark, sf_dir):
    """Orders in folders whose columns come in another order; urgent ones have text where the price belongs, and low ones
    no date. What doesn't parse is counted by column."""
    priority, folder = F.col("o_orderpriority"), scratch(spark)
    price = F.when(priority == "1-URGENT", priority).otherwise(F.col("o_totalprice").cast("string"))
    day = F.when(priority == "5-LOW", F.concat(F.lit("?"), priority)).when(priority != "2-HIGH", F.substring(F.col("o_orderdate").cast("string"), 1, 10))
    facts = table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), price.alias("price"))
    even = F.col("o_orderkey") % 2 == 0
    paths = [write_csv(facts.where(even), f"{folder}/even"), write_csv(facts.where(~even).select("price", "o_orderkey", "day"), f"{folder}/odd")]
    types = {"o_orderkey": T.LongType(), "day": T.DateType(), "price": T.DoubleType()}
    counted = bad_cells(spark, paths, types, multiline=False)
    return counted.groupBy("column").agg(F.sum("cells").alias("cells"), F.sum("bad").alias("bad"), F.min("example").alias("example"))


@query
def city_models(spark, sf_dir):
    """The city's whole analysis from files: incident text with clock dates, daily dates, months as columns; filtered, dated,
    counted, put on the grid, merged, rescaled and fitted. Years are moved so that the last one is the partial one."""
    folder, name = scratch(spark), F.col("p_name")
    kind = (F.when(name.contains("widget"), 'Battery, simple').when(name.contains("anvil"), 'Aggravated "Assault"').when(name.contains("ring"), "Homicide")
            .when(name.contains("bolt"), "Robbery Domestic").when(name.contains("plate"), "Fraud with Assault").otherwise(name))
    moved = F.add_months(F.col("l_shipdate").cast("date"), 12 * CITY_SHIFT)
    # Parts are hashed, so that the many lines need not be sorted.
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name").hint("shuffle_hash")
    lines = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    events = lines.select(kind.alias("Incident Type"), F.concat(F.date_format(moved, "MM/dd/yyyy"), F.lit(" 11:05:00 PM")).alias("Report Date"))
    ship = materialise(national_shipments(spark, sf_dir).withColumn("year", F.col("year") + CITY_SHIFT))
    rain = ship.select(F.date_format(F.make_date("year", "month", F.lit(1)), "dd/MM/yyyy").alias("date"), F.col("rfh").cast("double").alias("value"))
    label = F.concat_ws("-", F.col("year").cast("string"), F.lpad(F.col("month").cast("string"), 2, "0"))
    warm = ship.withColumn("_label", label).groupBy(F.lit("C").alias("code")).pivot("_label", _labels(ship, label)).agg(F.max("temperature"))
    cells = places.city_cells(spark, write_csv(rain, f"{folder}/rain"), write_csv(events, f"{folder}/events"), write_csv(warm, f"{folder}/warm"))["national"]
    rows = materialise(national.national_panel(*cells, scale_by=()))
    fits = {"fe": fe_within(rows, national.OUTCOME, national.COVARIATES, "year"), "fe_check": absorb_ols(rows, national.OUTCOME, national.COVARIATES, ["year", "month"])}
    shown = ["term", "estimate", "std_error", "t_value", "p_value", "df_resid", "n_obs", "lower", "upper"]
    fe, check = (readable(fit).select(F.lit(model).alias("model"), *shown) for model, fit in fits.items())
    return fe.unionByName(check)


@query
def csv_parts(spark, sf_dir):
    """Orders in two folders of CSV files whose columns come in another order, read as one table."""
    columns = ["o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority"]
    facts, folder = table(spark, sf_dir, "orders").select(*columns), scratch(spark)
    even = F.col("o_orderkey") % 2 == 0
    paths = [write_csv(facts.where(even), f"{folder}/even"), write_csv(facts.where(~even).select(*reversed(columns)), f"{folder}/odd")]
    types = {"o_orderkey": T.LongType(), "o_orderdate": T.StringType(), "o_totalprice": T.DoubleType()}
    named = read_named(spark, paths, types, multiline=False)
    rows = with_year_month(named.withColumn("date", F.to_date(F.substring("o_orderdate", 1, 10))), "date")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return rows.groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("o_orderkey").alias("keys"), F.sum(cents).alias("cents"))


@query
def csv_texts(spark, sf_dir):
    """Texts with quotes, commas and line breaks, written to CSV and read back unchanged."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    read = read_csv(spark, write_csv(docs, scratch(spark)), schema)
    return read.select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query
def csv_wide_series(spark, sf_dir):
    cells = nation_shipments(spark, sf_dir)
    label = F.concat_ws("-", F.col("year").cast("string"), F.lpad(F.col("month").cast("string"), 2, "0"))
    wide = cells.withColumn("_label", label).groupBy("nation").pivot("_label", _labels(cells, label)).agg(F.max("temperature"))
    series = read_wide_series(spark, write_csv(wide, scratch(spark)), ["nation"], value="temperature")
    return series.withColumn("nation", F.col("nation").cast("int"))


@query
def csv_legacy_text(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select("p_partkey", F.translate("p_name", "ae", "\xa0\x82").alias("raw"))
    schema = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("raw", T.StringType())])
    read = read_csv(spark, write_csv(raw, scratch(spark), "ISO-8859-1"), schema, "ISO-8859-1")
    return read.select("p_partkey", decode_codepage("raw", "cp850").alias("text"), fold_key("raw").alias("folded"))


@query
def csv_lookup(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    schema = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType())])
    named = lookup_join(nation_orders(spark, sf_dir), read_csv(spark, write_csv(nations, scratch(spark)), schema), "nation", "n_nationkey")
    return named.select("n_name", "year", "month", "incidents")


@query
def saved_coefficients(spark, sf_dir):
    path = scratch(spark)
    rows = complete_years(scaled_national_panel(spark, sf_dir))
    write_table(readable(fe_within(rows, national.OUTCOME, national.COVARIATES, "year")), path)
    return terms_matching(read_table(spark, path), "rainfall")


@query
def saved_rings(spark, sf_dir):
    """Outlines saved as polygons and read back as vertices of their centroids."""
    path = scratch(spark)
    write_table(rings.outline_rings(geo.dissolve_edges(parcels(spark, sf_dir), "unit", "parent"), "parent"), path)
    return geo.centroids(read_polygons(spark, path), "parent")


@query
def saved_polygons(spark, sf_dir):
    """Vertices saved and read, dissolved, and the outlines saved and read."""
    folder = scratch(spark)
    write_table(parcels(spark, sf_dir), f"{folder}/parcels")
    write_table(geo.dissolve_edges(read_polygons(spark, f"{folder}/parcels"), "unit", "parent"), f"{folder}/outlines")
    return read_table(spark, f"{folder}/outlines")


@query
def saved_figure_rows(spark, sf_dir):
    folder = scratch(spark)
    cells = national_orders(spark, sf_dir)
    write_results({"counts": cells, "anomaly": national.incident_anomaly(cells)}, folder)
    return read_table(spark, f"{folder}/anomaly")


@query
def merged_null_keys(spark, sf_dir):
    """A unit without a name is a unit: NULL keys meet."""
    named = F.nullif(F.col("nation"), F.lit(3))
    rain = nation_shipments(spark, sf_dir).select(named.alias("nation"), "year", "month", "rfh")
    return merge(rain, nation_orders(spark, sf_dir).withColumn("nation", named), ["year", "month", "nation"])
