"""Global positions of rows without ordering them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from playbill.llm.common import written


def dealt_in_order(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` over range partitions, each sorted, partition after partition in ascending order (nulls first).

    A number hashed from the row's place breaks ties, so that a repeated key, even a repeated row, is spread over partitions like
    any other rows. ``rows`` must be a written table: its places, and with them the numbers, then stay the same however often they are read."""
    keyed = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    return keyed.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")


def ranked(rows: DataFrame, tree: str, *order: str, name: str = "ranked") -> DataFrame:
    """``rows`` (a written table) with ``rank``, the row's place from 0 among the rows of its ``tree`` by ``order``.

    The place inside a partition comes from Spark's own row numbers; partitions and trees meet in a table of their counts, which has
    at most as many rows as there are partitions and trees."""
    place = written(dealt_in_order(rows, tree, *order).withColumn("_place", F.monotonically_increasing_id()), name)
    place = place.withColumn("_dealt", F.shiftright("_place", 33))
    parts = place.groupBy(tree, "_dealt").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(tree).orderBy("_dealt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(tree, "_dealt", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return place.join(parts, [tree, "_dealt"]).withColumn("rank", F.col("_place") + F.col("_shift")).drop("_place", "_dealt", "_shift")
