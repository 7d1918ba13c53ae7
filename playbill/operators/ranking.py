"""Ranks that stay distributed when one group holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. With a literal bound Spark cuts every task's rows to ``k`` per key
    before the shuffle, so a hot key costs at most ``k`` rows per task."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def seeded_hash(seed: int, key: str = "movie_id") -> Column:
    """Repeatable pseudo-random order of ids."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def magnitude_cell(value: Column, per_octave: int = 4096) -> Column:
    """Monotone cell number of a value: equal cells per doubling, so at most about 260,000 per sign
    for 64-bit amounts."""
    size = F.floor(F.log2(F.lit(1.0) + F.abs(value)) * per_octave)
    return F.coalesce(F.when(value < 0, -size - 1).otherwise(size), F.lit(0).cast("long"))


def percent_ranks(rows: DataFrame, key: str, group: str, measures: Sequence[str], among: DataFrame | None = None) -> DataFrame:
    """``percent_rank`` of each measure within its group, as ``<measure>_rank`` per key; the ranks are
    those among the rows of ``among`` (default: ``rows``), which must contain ``rows``.

    A window over a whole group would put the group into one task. Instead equal values are counted
    first, counts are summed below each cell of the value range, and only the values inside one cell
    are ordered among themselves: rank = rows in lower cells + rows of lower values in the cell."""
    pairs = ", ".join(f"'{m}', cast({m} as double)" for m in measures)
    stacked = F.expr(f"stack({len(measures)}, {pairs}) as (measure, value)")
    long = rows.select(key, group, stacked).filter("value is not null")
    by_group = ["measure", group]
    values = (
        (rows if among is None else among).select(group, stacked).filter("value is not null")
        .groupBy(*by_group, "value").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("cell", magnitude_cell(F.col("value")))
    )
    before = (Window.unboundedPreceding, -1)
    cells = (
        values.groupBy(*by_group, "cell").agg(F.sum("n").alias("cell_n"))
        .withColumn("below", F.coalesce(F.sum("cell_n").over(Window.partitionBy(*by_group).orderBy("cell").rowsBetween(*before)), F.lit(0)))
        .withColumn("group_n", F.sum("cell_n").over(Window.partitionBy(*by_group)))
        .drop("cell_n")
    )
    inside = F.coalesce(F.sum("n").over(Window.partitionBy(*by_group, "cell").orderBy("value").rowsBetween(*before)), F.lit(0))
    ranks = (
        values.withColumn("inside", inside)
        .join(cells, [*by_group, "cell"])
        .select(*by_group, "value",
                F.when(F.col("group_n") > 1, (F.col("below") + F.col("inside")) / (F.col("group_n") - 1)).otherwise(F.lit(0.0)).alias("pct"))
    )
    return (
        long.join(ranks, [*by_group, "value"])
        .groupBy(key)
        .agg(*[F.max(F.when(F.col("measure") == m, F.col("pct"))).alias(f"{m}_rank") for m in measures])
    )
