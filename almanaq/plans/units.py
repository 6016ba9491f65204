"""Panels of many units: zero-filled anomaly panel, models, unit slopes, profiles, map tables (Q2, Q4, Q7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanaq.fixed import PARTIAL_YEAR, PROFILE_YEARS, SKELETON_FROM
from almanaq.operators.absorb import absorb_ols
from almanaq.operators.anomaly import deviation, period_index, standardised_deviation, zscore
from almanaq.operators.coefficients import coef_interval
from almanaq.operators.panel import merge, recent_profile, skeleton_fill
from almanaq.operators.slopes import unit_slopes
from almanaq.operators.within import fe_within
from almanaq.plans.national import COVARIATES, DEVIATIONS, OUTCOME
from almanaq.sources.tables import materialise

PROFILE_MEANS = {
    "mean_rainfall_deviation": "rainfall_deviation",
    "mean_rainfall": "rfh",
    "monthly_mean_rainfall_all": "mean_rfh",
    "mean_incident_deviation": "incident_deviation",
    "mean_incidents": "standardized_incidents",
    "monthly_mean_incidents_all": "mean_standardized_incidents",
}


def anomaly_panel(rainfall: DataFrame, incidents: DataFrame, unit: str, skeleton_from: int = SKELETON_FROM) -> DataFrame:
    """Panel without covariate: one row per (unit, year, month) of the rainfall from ``skeleton_from`` on.

    Incidents are 0 where no row exists for a month that the rainfall has. Both inputs are used several times; pass
    monthly cells that were materialised, so the facts behind them are read once.
    """
    keys = ["year", "month", unit]
    rain = deviation(rainfall, "rfh", ["month", unit], out="rainfall_deviation")
    filled = skeleton_fill(rainfall.where(F.col("year") >= skeleton_from), incidents, keys, "incidents")
    counts = standardised_deviation(filled, "incidents", ["year"], ["month", unit], out="incident_deviation")
    return merge(
        rain.select(*keys, "rfh", "mean_rfh", "rainfall_deviation"),
        counts.select(*keys, "standardized_incidents", "mean_standardized_incidents", "incident_deviation"),
        keys,
    )


def unit_panel(
    rainfall: DataFrame, incidents: DataFrame, temperature: DataFrame, unit: str, skeleton_from: int = SKELETON_FROM,
) -> DataFrame:
    """The full panel: anomalies, optional temperature, date and time index, and the rescaled deviations."""
    keys = ["year", "month", unit]
    warm = deviation(temperature, "temperature", ["month", unit], out="temperature_deviation")
    panel = merge(
        anomaly_panel(rainfall, incidents, unit, skeleton_from),
        warm.select(*keys, "temperature", "mean_temperature", "temperature_deviation"), keys, "left",
    )
    # Three passes follow (ranks, scale, rows); the joins above run once.
    return zscore(period_index(materialise(panel)), DEVIATIONS, by=[])


def unit_models(panel: DataFrame, unit: str, partial_year: int = PARTIAL_YEAR) -> dict[str, DataFrame]:
    """Coefficient tables of the panel models, and the table of unit slopes."""
    rows = materialise(panel.where(F.col("year") != partial_year))
    fits = {
        "fe_unit": absorb_ols(rows, OUTCOME, COVARIATES, by=[unit, "year"]),
        "fe_unit_month": absorb_ols(rows, OUTCOME, COVARIATES, by=[unit, "year", "month"]),
        "fe_year": fe_within(rows, OUTCOME, COVARIATES, by="year"),
    }
    tables = {name: coef_interval(coefs) for name, coefs in fits.items()}
    tables["slopes"] = unit_slopes(rows, OUTCOME, COVARIATES[0], COVARIATES[1:], unit, "year")
    return tables


def profile(panel: DataFrame, unit: str, years: tuple[int, int] = PROFILE_YEARS) -> DataFrame:
    """Six means per unit and month over the recent years."""
    return recent_profile(panel, unit, years, PROFILE_MEANS)
