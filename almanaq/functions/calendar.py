"""Calendar columns: year, month, month names, lenient date parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanaq.fixed import CLOCK_PATTERN, MONTH_NAMES


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_year_month(df: DataFrame, date: Column | str) -> DataFrame:
    """Adds integer ``year`` and ``month`` of a date or timestamp column."""
    d = _col(date)
    return df.withColumns({"year": F.year(d).cast("int"), "month": F.month(d).cast("int")})


def _parse(text: Column, order: str) -> Column:
    """Any run of spaces, slashes, dots or dashes separates; two-digit years 00-68 are 20xx, 69-99 are 19xx."""
    parts = F.regexp_replace(F.trim(text), r"[\s/.\-]+", "/")
    recent = F.regexp_replace(parts, r"/([0-5]\d|6[0-8])$", "/20$1")
    return F.try_to_date(F.regexp_replace(recent, r"/(\d\d)$", "/19$1"), order)


def parse_dmy(text: Column | str) -> Column:
    """Day-month-year text to a date; NULL when it is not a real date."""
    return _parse(_col(text), "d/M/yyyy")


def parse_mdy(text: Column | str) -> Column:
    """Month-day-year text to a date; NULL when it is not a real date."""
    return _parse(_col(text), "M/d/yyyy")


def strip_clock(text: Column | str) -> Column:
    """Removes a 12-hour clock time from text."""
    return F.regexp_replace(_col(text), CLOCK_PATTERN, "")


def month_start(year: Column | str, month: Column | str) -> Column:
    """First day of the month."""
    return F.make_date(_col(year), _col(month), F.lit(1))


def month_name(month: Column | str) -> Column:
    """English month name; NULL outside 1..12."""
    return F.get(F.array(*[F.lit(m) for m in MONTH_NAMES]), _col(month) - 1)


def month_number(name: Column | str, names: Sequence[str]) -> Column:
    """Position of a month name in ``names`` (upper case); NULL when unknown."""
    entries = [F.lit(v) for i, n in enumerate(names, 1) for v in (n, i)]
    return F.try_element_at(F.create_map(*entries), F.upper(F.trim(_col(name))))
