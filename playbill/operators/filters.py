"""Catalog predicates. Each returns a Column over a prepared catalog (see ``prepare_catalog``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from playbill.contracts import RELEASED


def is_released() -> Column:
    return F.col("status") == RELEASED


def is_eligible() -> Column:
    """Rows fit for enrichment: text, genres, both amounts known, released."""
    return (
        F.col("has_overview")
        & (F.col("budget") > 0) & (F.col("revenue") > 0)
        & is_released()
        & F.col("genres").isNotNull() & (F.col("genres") != "")
    )


def in_range(column: str, low=None, high=None) -> Column:
    """Closed range with optional bounds; no bound, no condition (a null value then passes too)."""
    condition = F.lit(True)
    if low is not None:
        condition = F.col(column) >= low
    if high is not None:
        upper = F.col(column) <= high
        condition = upper if low is None else condition & upper
    return condition


def has_genre(wanted: Sequence[str]) -> Column:
    """Any wanted genre, whole names, ignoring case; an empty list filters nothing."""
    if not wanted:
        return F.lit(True)
    keys = F.array(*[F.lower(F.lit(name)) for name in wanted])
    return F.arrays_overlap(F.col("genre_keys"), keys)


def only_ids(rows: DataFrame, ids: DataFrame, key: str = "movie_id") -> DataFrame:
    """Rows whose key is in the id table; the plan broadcasts the ids only if they are small."""
    return rows.join(ids.select(key), key, "left_semi")
