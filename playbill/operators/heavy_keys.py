"""Joins on keys of which a few are very frequent: those meet a broadcast part of the other table, the rest is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is heavy if it has more than this share of the rows, so there are at most 1 / SHARE of them, and too many rows for one task.
SHARE, LEAST_ROWS = 1 / 2000, 200_000
COUNTERS = 1 << 16


def heavy_keys(rows: DataFrame, key: str, share: float = SHARE, least_rows: int = LEAST_ROWS) -> list:
    """Keys with more than ``share`` of the rows and more than ``least_rows``; at most 1 / share of them come to the driver.

    Rows are counted under COUNTERS hashes first, each task sending at most so many counts; a heavy key makes its counter heavy, so
    only keys under heavy counters are counted one by one."""
    keyed = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"))
    counter = F.pmod(F.xxhash64("key"), F.lit(COUNTERS))
    counts = keyed.groupBy(counter.alias("counter")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    least = max(least_rows, share * float(counts["n"].sum()))
    heavy = [int(c) for c in counts.loc[counts["n"] > least, "counter"]]
    if not heavy:
        return []
    found = keyed.where(counter.isin(heavy)).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    return [r["key"] for r in found.toLocalIterator()]


def split_join(left: DataFrame, right: DataFrame, key: str, heavy: list, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (inner or left), whose ``key`` is unique. Rows of ``left`` with a heavy key stay where they are and meet the
    broadcast rows of ``right`` with those keys (one for each key at most); all other rows are shuffled as usual."""
    if how not in ("inner", "left"):
        raise ValueError(f"{how} joins are not split")
    if not heavy:
        return left.join(right, key, how)
    is_heavy = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    rest = left.where(~is_heavy).join(right.where(~is_heavy), key, how)
    return left.where(is_heavy).join(F.broadcast(right.where(is_heavy)), key, how).unionByName(rest)
