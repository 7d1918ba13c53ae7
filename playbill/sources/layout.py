"""Order of stored rows: a space-filling curve over several columns, so that filters on any of them skip row groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from playbill.operators.intervals import LEVELS, axes

#: Columns that catalog searches bound.
CATALOG_AXES = ("filter_year", "budget", "runtime")


def interleaved(cells: Sequence[Column], bits: int = LEVELS) -> Column:
    """The bits of the numbers in turn, highest first; a null counts as 0."""
    place = F.lit(0).cast("long")
    for i, cell in enumerate(cells):
        number = F.coalesce(cell, F.lit(0)).cast("long")
        for bit in range(bits):
            place = place.bitwiseOR(F.shiftleft(F.shiftright(number, bit).bitwiseAND(F.lit(1).cast("long")), bit * len(cells) + len(cells) - 1 - i))
    return place


def along_curve(rows: DataFrame, files: int, columns: Sequence[str] = CATALOG_AXES, key: str = "movie_id") -> DataFrame:
    """``rows`` in ``files`` ranges of the curve through the cells of the whole-number columns, sorted in each. Cells hold about equal numbers of rows, so
    neither rare large values nor common ones stretch the curve; rows of one cell are spread by ``key``."""
    # Every axis takes the whole width of its number, however few cells it has.
    cells = [F.floor(axis.cell(F.col(axis.name)) * F.lit(1 << LEVELS) / F.lit(len(axis.edges) + 1)) for axis in axes(rows, list(columns))]
    placed = rows.withColumn("_place", interleaved(cells))
    return placed.repartitionByRange(files, "_place", key).sortWithinPartitions("_place", key).drop("_place")
