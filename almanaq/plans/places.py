"""The three places: from their input files to monthly cells, and from cells to result tables.

Files are scanned once each; cells are written to the shared folder and everything later reads those. Column names are
the legal forms of the file headers.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanaq import fixed
from almanaq.functions.calendar import parse_dmy, parse_mdy, strip_clock, with_year_month
from almanaq.functions.scalar import prefer
from almanaq.functions.text import admin_codes, drop_any, keep_any, to_int
from almanaq.operators import geo
from almanaq.operators.aggregate import levels, monthly
from almanaq.operators.panel import lookup_join, merge, splice
from almanaq.operators.reshape import complete_grid, unpivot_between
from almanaq.operators.slopes import interaction_table
from almanaq.plans import national, units
from almanaq.sources.files import read_named, read_wide_series
from almanaq.sources.lookups import lookup
from almanaq.sources.tables import materialise_all

TEXT, INT, DOUBLE, DATE = T.StringType(), T.IntegerType(), T.DoubleType(), T.DateType()
MONTH_KEYS = ("year", "month")


class Cells(NamedTuple):
    """Monthly cells of one geographic level: keys plus ``rfh``, ``incidents``, ``temperature``."""

    rainfall: DataFrame
    incidents: DataFrame
    temperature: DataFrame | None


def _level(table: DataFrame, level: str, *columns: str) -> DataFrame:
    return table.where(F.col("level") == level).select(*columns)


def colombia_cells(
    spark: SparkSession, rainfall: Sequence[str], incidents: str, temperature: str, geo_lookup: str,
) -> dict[str, Cells]:
    """Cells of the country (``national``), the departments (``COD_DEPTO``) and the municipalities (``COD_MUNI``)."""
    rain = read_named(spark, rainfall, {"date": DATE, "ADM2_PCODE": TEXT, "rfh": DOUBLE}, multiline=False)
    rain = admin_codes(with_year_month(rain, "date"), "ADM2_PCODE", "COD_DEPTO", "COD_MUNI")
    events = read_named(spark, [incidents], {"FECHA.HECHO": TEXT, "CANTIDAD": INT, "COD_DEPTO": INT, "COD_MUNI": INT})
    events = with_year_month(events, parse_dmy(F.col("`FECHA.HECHO`"))).withColumnRenamed("CANTIDAD", "incidents")
    warm = read_wide_series(spark, temperature, ["code", "name"], value="temperature")
    places = read_named(spark, [geo_lookup], {"name": TEXT, "MPIO_CCDGO": INT}).withColumnRenamed("MPIO_CCDGO", "COD_MUNI")
    r, i, t = materialise_all(
        levels(rain, "rfh", "COD_MUNI", "COD_DEPTO", na="strict"), levels(events, "incidents", "COD_MUNI", "COD_DEPTO", na="skip"),
        warm.drop("code"))
    name = fixed.COUNTRY_NAMES["colombia"]
    towns = lookup_join(places, t.where(F.col("name") != name), "name", "name").select("COD_MUNI", *MONTH_KEYS, "temperature")
    return {
        "national": Cells(
            _level(r, "total", *MONTH_KEYS, "rfh"), _level(i, "total", *MONTH_KEYS, "incidents"),
            t.where(F.col("name") == name).select(*MONTH_KEYS, "temperature")),
        "COD_DEPTO": Cells(
            _level(r, "parent", "COD_DEPTO", *MONTH_KEYS, "rfh"), _level(i, "parent", "COD_DEPTO", *MONTH_KEYS, "incidents"), None),
        "COD_MUNI": Cells(
            _level(r, "unit", "COD_MUNI", *MONTH_KEYS, "rfh"), _level(i, "unit", "COD_MUNI", *MONTH_KEYS, "incidents"), towns),
    }


def _mexico_incidents(spark: SparkSession, path: str, year: str, kind: str, state: str, wanted: str, months: tuple[str, str]) -> DataFrame:
    """(year, month, name, total) of one wide incident file, one kind only."""
    names = [m if months[0].isupper() else m.capitalize() for m in fixed.SPANISH_MONTHS]
    columns = {year: INT, state: TEXT, kind: TEXT, **{m: INT for m in names}}
    wide = read_named(spark, [path], columns, encoding="ISO-8859-1", multiline=False).where(F.col(f"`{kind}`") == wanted)
    wide = wide.select(F.col(year).alias("year"), F.col(state).alias("name"), *names)
    return monthly(unpivot_between(wide, ["year", "name"], *months, value="total"), "total", ["year", "month", "name"], na="skip")


def mexico_cells(
    spark: SparkSession, rainfall: Sequence[str], incidents_old: str, incidents_new: str, temperature: str,
) -> dict[str, Cells]:
    """Cells of the country (``national``) and the states (``ENTIDAD``).

    One state is left out of the national incident totals but stays in the state panel.
    """
    rain = read_named(spark, rainfall, {
        "X.date": DATE, "X.adm.level.level": TEXT, "X.adm.code": TEXT, "X.indicator.rfh.num": DOUBLE}, multiline=False)
    rain = rain.toDF("date", "level", "code", "rfh").where(F.col("level") == fixed.STATE_LEVEL)
    rain = levels(with_year_month(rain, "date").withColumn("country", F.lit(True)), "rfh", "code", "country")
    old = _mexico_incidents(
        spark, incidents_old, "ANO", "MODALIDAD", "ENTIDAD", fixed.OLD_INCIDENT_KIND, ("ENERO", "DICIEMBRE"))
    new = _mexico_incidents(
        spark, incidents_new, "Ano", "Tipo.de.delito", "Entidad", fixed.NEW_INCIDENT_KIND, ("Enero", "Diciembre"))
    warm = read_wide_series(spark, temperature, ["code", "name"], value="temperature", encoding="ISO-8859-1").drop("code")
    r, old, new, t = materialise_all(rain, old, new, warm)

    states = lookup_join(
        _level(r, "unit", "code", *MONTH_KEYS, "rfh"), lookup(spark, fixed.STATE_BY_CODE, ["code", "ENTIDAD"]), "code", "code")
    # Codes without a state form one unit of their own.
    states = monthly(states, "rfh", ["ENTIDAD", *MONTH_KEYS], na="strict")
    named_new = lookup_join(new, lookup(spark, fixed.STATE_BY_INCIDENT_NAME, ["name", "ENTIDAD"]), "name", "name")
    by_state = splice(
        old.withColumnRenamed("name", "ENTIDAD"), named_new.select("year", "month", "ENTIDAD", "total"), fixed.SPLICE_YEAR)
    whole = splice(
        old.where(F.col("name") != fixed.OLD_DROPPED_STATE), new.where(F.col("name") != fixed.NEW_DROPPED_STATE), fixed.SPLICE_YEAR)
    country = fixed.COUNTRY_NAMES["mexico"]
    warm_states = lookup_join(
        t.where(F.col("name") != country), lookup(spark, fixed.STATE_BY_TEMPERATURE_NAME, ["name", "ENTIDAD"]), "name", "name")
    return {
        "national": Cells(
            _level(r, "total", *MONTH_KEYS, "rfh"), monthly(whole, "total", na="skip", out="incidents"),
            t.where(F.col("name") == country).select(*MONTH_KEYS, "temperature")),
        "ENTIDAD": Cells(
            states, monthly(by_state, "total", ["ENTIDAD", *MONTH_KEYS], na="skip", out="incidents"),
            warm_states.select("ENTIDAD", *MONTH_KEYS, "temperature")),
    }


def city_cells(spark: SparkSession, rainfall: str, incidents: str, temperature: str) -> dict[str, Cells]:
    """Cells of the city (``national``): incident text is filtered, dated, counted and put on the full grid."""
    complete = F.col("year") != fixed.PARTIAL_YEAR
    rain = read_named(spark, [rainfall], {"date": TEXT, "value": DOUBLE}, multiline=False)
    rain = with_year_month(rain, parse_dmy("date")).where(complete).select(*MONTH_KEYS, F.col("value").alias("rfh"))
    events = read_named(spark, [incidents], {"Incident.Type": TEXT, "Report.Date": TEXT}).toDF("kind", "reported")
    events = keep_any(events, "kind", fixed.SERIOUS_VIOLENCE_TERMS)
    events = drop_any(drop_any(events, "kind", fixed.CYBER_TERMS), "kind", fixed.DOMESTIC_TERMS)
    events = with_year_month(events, parse_mdy(strip_clock("reported"))).where(complete)
    counted = complete_grid(monthly(events, None, na="count", out="incidents"), "incidents", fixed.CITY_YEARS)
    warm = read_wide_series(spark, temperature, ["code"], value="temperature").where(F.col("year") >= fixed.CITY_TEMPERATURE_FROM)
    return {"national": Cells(*materialise_all(rain, counted, warm.drop("code")))}


class Settings(NamedTuple):
    trend_from: int
    rainfall_periods: tuple
    incident_periods: tuple
    scale_by: tuple[str, ...]


COLOMBIA = Settings(fixed.COLOMBIA_TREND_FROM, fixed.MEASURE_PERIODS, fixed.COLOMBIA_COUNT_PERIODS, ("month",))
MEXICO = Settings(fixed.MEXICO_TREND_FROM, fixed.MEASURE_PERIODS, fixed.MEXICO_COUNT_PERIODS, ("month",))
CITY = Settings(fixed.CITY_TREND_FROM, fixed.CITY_MEASURE_PERIODS, fixed.CITY_COUNT_PERIODS, ())


def national_tables(cells: Cells, settings: Settings) -> dict[str, DataFrame]:
    """All tables of the one-series analysis: panel, rows behind the figures, coefficients of the five models."""
    rain, incidents = national.rainfall_anomaly(cells.rainfall), national.incident_anomaly(cells.incidents)
    panel = national.national_panel(cells.rainfall, cells.incidents, cells.temperature, settings.scale_by)
    return {
        "panel": panel.orderBy(*MONTH_KEYS),
        "rainfall_anomaly": rain.where(F.col("year") >= settings.trend_from).orderBy(*MONTH_KEYS),
        "incident_anomaly": incidents.orderBy(*MONTH_KEYS),
        "rainfall_trends": national.deviation_trends(rain, "rainfall_deviation", settings.trend_from),
        "incident_trends": national.deviation_trends(incidents, "incident_deviation"),
        "rainfall_densities": national.period_densities(cells.rainfall, settings.rainfall_periods, "rfh"),
        "incident_densities": national.period_densities(cells.incidents, settings.incident_periods, "incidents"),
        **national.national_models(panel),
    }


def unit_tables(cells: Cells, unit: str) -> dict[str, DataFrame]:
    """All tables of the panel analysis of one level: panel, recent profile, and with a temperature the models."""
    if cells.temperature is None:
        panel = units.anomaly_panel(cells.rainfall, cells.incidents, unit)
        return {"panel": panel, "profile": units.profile(panel, unit)}
    panel = units.unit_panel(cells.rainfall, cells.incidents, cells.temperature, unit)
    return {"panel": panel, "profile": units.profile(panel, unit), **units.unit_models(panel, unit)}


def colombia_unit_map(profile: DataFrame, polygons: DataFrame, slopes: DataFrame) -> DataFrame:
    """One row per municipality with a recent profile: name, centroid, coefficient.

    ``polygons`` are vertices ``(MPIO_CCDGO, MPIO_CNMBR, ring, seq, lon, lat)``.
    """
    vertices = polygons.withColumn("COD_MUNI", to_int("MPIO_CCDGO"))
    names = vertices.select("COD_MUNI", "MPIO_CNMBR").dropDuplicates()
    places = merge(names, geo.centroids(vertices, "COD_MUNI", "sphere"), ["COD_MUNI"], "left")
    monthly_map = geo.profile_map(profile, places, "COD_MUNI")
    return geo.map_table(monthly_map, interaction_table(slopes, "COD_MUNI"), "COD_MUNI", ["MPIO_CNMBR", "lon", "lat"])


def colombia_parent_map(profile: DataFrame, polygons: DataFrame) -> DataFrame:
    """Monthly profile of each department with its outline attributes; departments without a profile stay."""
    attributes = polygons.select(to_int("DPTO_CCDGO").alias("COD_DEPTO"), "DPTO_CCDGO").dropDuplicates()
    return geo.profile_map(profile, attributes, "COD_DEPTO", keep_missing=True)


def mexico_map(states: DataFrame, slopes: DataFrame) -> DataFrame:
    """One row per state polygon ``(ADM1_ES, ADM1_REF)`` with its coefficient; the plain name wins where given."""
    known = lookup(states.sparkSession, fixed.STATE_BY_POLYGON_NAME, ["polygon", "ENTIDAD"])
    named = states.select(prefer("ADM1_REF", "ADM1_ES").alias("ADM1_ES"))
    return geo.map_table(lookup_join(named, known, "ADM1_ES", "polygon"), interaction_table(slopes, "ENTIDAD"), "ENTIDAD", ["ADM1_ES"])
