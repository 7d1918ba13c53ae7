"""Years from release dates kept as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def release_year(date: Column) -> Column:
    """Year to show: null unless the first four characters are a whole number."""
    return F.when(F.length(date) >= 4, F.substring(date, 1, 4).try_cast("int"))


def filter_year(date: Column) -> Column:
    """Year to filter on: the leading number of the first four characters, 0 when there is none."""
    digits = F.regexp_extract(F.substring(date, 1, 4), r"^\s*([+-]?[0-9]+)", 1)
    return F.when(date.isNotNull(), F.coalesce(digits.try_cast("int"), F.lit(0)))
