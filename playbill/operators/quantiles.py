"""Exact order statistics without ordering: rows are counted by cells of the value range, and only the cell that holds a rank is looked into.

The first pass counts by magnitude (a fixed number of cells for each doubling), further ones cut the cells that hold a wanted rank into BINS equal
parts, until such a part has one value or at most FEW rows, which are read. A pass sends at most BINS counts for each wanted rank to the driver and shuffles no
rows; seven passes bring doubles down to single values, whatever their distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from playbill.operators.ranking import magnitude_cell

BINS, FEW = 4096, 10_000


def finite(value: Column) -> Column:
    """The value as a double; null if it is no finite number."""
    x = value.cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def values_at(values: DataFrame, column: str, ranks: Sequence[int]) -> dict[int, float]:
    """The values at the given ranks (from 0) of a column of finite doubles in ascending order; ``values`` is read several times, so it should be written."""
    x = F.col(column)
    found: dict[int, float] = {}
    cells = values.groupBy(magnitude_cell(x).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
    # Ranks that lie in the same part go on together: (low, high, rows below, rows) and its ranks.
    open_ = _parts_of_ranks(cells, "cell", sorted(set(ranks)), 0, found)
    while open_:
        part, wanted = open_.popitem()
        low, high, below, n = part
        inside = values.where(x.between(low, high))
        if n <= FEW:
            ordered = sorted(r[0] for r in inside.select(x).collect())
            found |= {r: ordered[r - below] for r in wanted}
            continue
        width = high / BINS - low / BINS
        bin_ = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(BINS - 1)) if width > 0 else F.when(x > low, 1).otherwise(0)
        bins = inside.groupBy(bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
        open_ |= _parts_of_ranks(bins, "bin", wanted, below, found)
    return found


def _parts_of_ranks(parts: DataFrame, key: str, ranks: list[int], below: int, found: dict[int, float]) -> dict[tuple, list[int]]:
    """The parts in which the ranks lie, in order of ``key``; ranks in a part of one value are found."""
    left, open_ = list(ranks), {}
    for r in parts.orderBy(key).toLocalIterator():
        here = [k for k in left if below <= k < below + r["n"]]
        if here and r["low"] == r["high"]:
            found |= {k: r["low"] for k in here}
        elif here:
            open_[r["low"], r["high"], below, r["n"]] = here
        left = left[len(here):]
        below += r["n"]
        if not left:
            break
    return open_


def percentiles(values: DataFrame, column: str, count: int, shares: Sequence[float]) -> list[float | None]:
    """Percentiles with linear interpolation between the two neighbours, null for no values."""
    if not count:
        return [None for _ in shares]
    places = [share * (count - 1) for share in shares]
    at = values_at(values, column, [k for p in places for k in (int(p), min(int(p) + 1, count - 1))])
    return [at[int(p)] + (at[min(int(p) + 1, count - 1)] - at[int(p)]) * (p - int(p)) for p in places]
