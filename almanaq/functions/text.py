"""Text cleaning: term filters, code prefixes, legacy code pages."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanaq.functions.calendar import _col


def any_term(terms: Iterable[str]) -> str:
    """Regular expression that matches any of the terms literally."""
    return "|".join(re.escape(t) for t in terms)


def keep_any(df: DataFrame, col: str, terms: Iterable[str]) -> DataFrame:
    """Keeps rows whose text contains any term (case-sensitive); NULL text is dropped."""
    return df.where(F.col(col).rlike(any_term(terms)))


def drop_any(df: DataFrame, col: str, terms: Iterable[str]) -> DataFrame:
    """Drops rows whose text contains any term; NULL text is dropped too."""
    return df.where(~F.col(col).rlike(any_term(terms)))


def strip_prefix(text: Column | str, prefix: str) -> Column:
    return F.regexp_replace(_col(text), "^" + re.escape(prefix), "")


def drop_one_zero(text: Column | str) -> Column:
    """Removes exactly one leading zero."""
    return F.regexp_replace(_col(text), "^0", "")


def to_int(text: Column | str) -> Column:
    """Integer or NULL; never raises."""
    return _col(text).try_cast("int")


def admin_codes(df: DataFrame, code: str, parent: str, unit: str, prefix: str = "CO", parent_length: int = 2) -> DataFrame:
    """Splits an administrative code such as ``CO05001`` into integer parent (5) and unit (5001) codes."""
    bare = strip_prefix(code, prefix)
    return df.withColumns({
        parent: to_int(drop_one_zero(F.substring(bare, 1, parent_length))),
        unit: to_int(drop_one_zero(bare)),
    })


def decode_codepage(text: Column | str, codec: str = "cp850") -> Column:
    """Re-reads text that was scanned one byte per character (ISO-8859-1) in a single-byte code page."""
    high = bytes(range(128, 256))
    return F.translate(_col(text), high.decode("iso-8859-1"), high.decode(codec))


def fold_key(text: Column | str) -> Column:
    """Lookup key with every character outside A-Z, a-z, 0-9 replaced by ``_``, in lower case.

    One character stays one character, so a key that lost its accented letter to a space, to a code page byte or to the
    right letter folds to the same value. Apply it to both sides of a lookup.
    """
    return F.lower(F.regexp_replace(_col(text), "[^A-Za-z0-9]", "_"))
