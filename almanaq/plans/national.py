"""One series per place: anomaly panel, models, trends and period densities (Q1, Q3, Q5, Q6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanaq.fixed import PARTIAL_YEAR
from almanaq.functions.calendar import month_name
from almanaq.operators.absorb import absorb_ols
from almanaq.operators.anomaly import deviation, standardised_deviation, zscore
from almanaq.operators.coefficients import coef_interval
from almanaq.operators.density import weighted_kde
from almanaq.operators.gls import gls_ar, lag_sums
from almanaq.operators.panel import merge, period_profile
from almanaq.operators.trend import trend_lm
from almanaq.operators.within import fe_within
from almanaq.sources.tables import materialise

OUTCOME = "scaled_incident_deviation"
COVARIATES = ["scaled_rainfall_deviation", "scaled_temperature_deviation"]
DEVIATIONS = {
    "scaled_rainfall_deviation": "rainfall_deviation",
    "scaled_incident_deviation": "incident_deviation",
    "scaled_temperature_deviation": "temperature_deviation",
}


def rainfall_anomaly(cells: DataFrame) -> DataFrame:
    """``(year, month, rfh)`` with the calendar-month mean, the deviation and its direction."""
    return deviation(cells, "rfh", ["month"], out="rainfall_deviation", flag="above_below_avg")


def incident_anomaly(cells: DataFrame) -> DataFrame:
    """``(year, month, incidents)`` standardised within the year, minus the calendar-month mean of that."""
    return standardised_deviation(cells, "incidents", ["year"], ["month"], out="incident_deviation")


def temperature_anomaly(cells: DataFrame) -> DataFrame:
    """Baseline over all years of ``(year, month, temperature)``, also those the panel does not cover."""
    return deviation(cells, "temperature", ["month"], out="temperature_deviation", flag="above_below_avg")


def national_panel(rainfall: DataFrame, incidents: DataFrame, temperature: DataFrame, scale_by: Sequence[str] = ("month",)) -> DataFrame:
    """Three deviations per (year, month), and the same rescaled.

    ``scale_by=("month",)`` rescales inside each calendar month, as both countries do; ``()`` over the whole table, as
    the city does. Each input is used several times; pass monthly cells that were materialised, so the facts behind
    them are read once.
    """
    keys = ["year", "month"]
    panel = merge(
        rainfall_anomaly(rainfall).select(*keys, "rainfall_deviation"),
        incident_anomaly(incidents).select(*keys, "incident_deviation"), keys)
    panel = merge(panel, temperature_anomaly(temperature).select(*keys, "temperature_deviation"), keys)
    return zscore(panel, DEVIATIONS, scale_by)


def national_models(panel: DataFrame, partial_year: int = PARTIAL_YEAR) -> dict[str, DataFrame]:
    """Coefficient tables of all models of the national series, with intervals of two standard errors.

    The partial last year takes part in baselines and scaling but not in the fits.
    """
    rows = materialise(panel.where(F.col("year") != partial_year))
    fits = {
        "fe": fe_within(rows, OUTCOME, COVARIATES, by="year"),
        "fe_check": absorb_ols(rows, OUTCOME, COVARIATES, by=["year", "month"]),
    }
    sums = lag_sums(rows, OUTCOME, COVARIATES, time="year", group="month", p=3)
    for p in (1, 2, 3):
        fits[f"gls_ar{p}"] = gls_ar(rows, OUTCOME, COVARIATES, time="year", group="month", p=p, sums=sums)
    return {name: coef_interval(coefs) for name, coefs in fits.items()}


def deviation_trends(anomaly: DataFrame, col: str, from_year: int | None = None) -> DataFrame:
    """Rows behind the trend figure: per calendar month the fitted line and its band over the years."""
    if from_year is not None:
        anomaly = anomaly.where(F.col("year") >= from_year)
    return trend_lm(anomaly, col, "year", ["month"]).withColumn("month_name", month_name("month"))


def period_densities(cells: DataFrame, periods: Sequence[tuple[str, int, int]], value: str) -> DataFrame:
    """Rows behind the density figure: weighted density of the months for each labelled year range."""
    means = period_profile(cells, periods, value, out="mean_value")
    return weighted_kde(means, "month", "mean_value", ["period_ord", "period"], adjust=0.6)
