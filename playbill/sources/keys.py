"""Unique keys of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def duplicate_keys(table: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once; empty for a sound catalog or enrichment table."""
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def assert_unique(table: DataFrame, *keys: str) -> None:
    """ValueError with one example if a key occurs more than once: joins on it would double rows."""
    twice = duplicate_keys(table, *keys).first()
    if twice is not None:
        raise ValueError(f"{', '.join(f'{k}={twice[k]}' for k in keys)} occurs {twice['n']} times")
