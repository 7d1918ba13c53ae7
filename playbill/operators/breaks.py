"""Tiers by natural breaks: amounts of a group are parted where they part by themselves, not at fixed shares of the ranks.

Amounts are counted in cells of a rough logarithm (sixteen for each doubling, about a thousand at most), by Spark; of a group's cells, one row each, the two breaks
are found that leave the least squares within the three classes, by trying the second break for every first one over running sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def amount_cell(amount: Column) -> Column:
    """Whole-number cell of a positive amount: its highest five bits and how many bits lie below them; null for none."""
    amount = amount.cast("long")
    below = F.length(F.bin(amount)) - 5
    shifted = F.floor(amount / F.pow(F.lit(2.0), below))
    return F.when(amount > 0, F.when(amount < 16, amount).otherwise(below * 16 + shifted)).cast("int")


def two_breaks(cells: np.ndarray, counts: np.ndarray) -> tuple[int, int]:
    """First cells of the middle and of the high class; ties go to lower breaks. Of two cells one is low and one high, a single one is medium."""
    if len(cells) < 3:
        return (int(cells[0]), int(cells[0]) + 1) if len(cells) == 1 else (int(cells[1]), int(cells[1]))
    c, n = cells.astype(np.int64), counts.astype(np.int64)
    rows, first, second = (np.concatenate(([0], np.cumsum(n * c ** k))) for k in (0, 1, 2))

    def spread(a, b):
        size, total = rows[b] - rows[a], first[b] - first[a]
        return second[b] - second[a] - total * total / size

    best = None
    for a in range(1, len(c) - 1):
        b = np.arange(a + 1, len(c))
        cost = spread(0, a) + spread(a, b) + spread(b, len(c))
        k = int(cost.argmin())
        if best is None or cost[k] < best[0]:
            best = (cost[k], a, a + 1 + k)
    return int(c[best[1]]), int(c[best[2]])


def tier_breaks(rows: DataFrame, group: str, measures: list[str]) -> DataFrame:
    """(measure, <group>, medium_from, high_from): the cells at which tiers start, for every group with known amounts."""
    pairs = ", ".join(f"'{m}', cast({m} as bigint)" for m in measures)
    long = rows.select(group, F.expr(f"stack({len(measures)}, {pairs}) as (measure, amount)"))
    cells = long.withColumn("cell", amount_cell(F.col("amount"))).where("cell is not null").groupBy("measure", group, "cell").agg(F.count(F.lit(1)).alias("n"))

    def find(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("cell")
        return pd.DataFrame([(*keys, *two_breaks(part["cell"].to_numpy(), part["n"].to_numpy()))], columns=["measure", group, "medium_from", "high_from"])

    kind = rows.schema[group].dataType.simpleString()
    return cells.groupBy("measure", group).applyInPandas(find, f"measure string, {group} {kind}, medium_from int, high_from int")


def tiers_by_breaks(rows: DataFrame, key: str, group: str, measures: list[str], among: DataFrame | None = None) -> DataFrame:
    """(key, <measure>_tier ...) by the breaks of each row's group among the rows of ``among`` (default: ``rows``); null for unknown amounts."""
    found = tier_breaks(rows if among is None else among, group, measures)
    out = rows.select(key, group, *measures)
    for m in measures:
        own = found.where(F.col("measure") == m).select(F.col(group).alias("_group"), "medium_from", "high_from")
        cell = amount_cell(F.col(m))
        named = F.when(cell.isNull() | F.col("medium_from").isNull(), None).when(cell < F.col("medium_from"), "low").when(cell < F.col("high_from"), "medium").otherwise("high")
        out = out.join(own, out[group].eqNullSafe(own["_group"]), "left").withColumn(f"{m}_tier", named).drop("_group", "medium_from", "high_from")
    return out.select(key, *(f"{m}_tier" for m in measures))
