"""Seeded samples of exact size: plain, and apportioned over strata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from playbill.operators.ranking import seeded_hash
from playbill.session import written


def allocate(pool: DataFrame, group: str, n: int) -> DataFrame:
    """Seats per stratum by largest remainder: every stratum gets the whole part of its share of
    ``n``, the rest goes to the largest remainders (ties by name), strata without a seat drop out.
    Decimal arithmetic throughout; the largest remainders are found by cells, without ordering all strata in one task."""
    strata = written(pool.groupBy(group).agg(F.count(F.lit(1)).alias("size")), "strata")
    product = F.lit(n).cast("decimal(19,0)") * F.col("size").cast("decimal(19,0)")
    shares = (
        strata.withColumn("total", strata.agg(F.sum("size")).scalar())
        .withColumn("product", product)
        .withColumn("seats", F.expr("(product div total)"))
        .withColumn("left_over", F.expr("product % total").cast("decimal(19,0)"))
        .drop("product")
    )
    spare = shares.agg((F.lit(n).cast("decimal(19,0)") - F.sum("seats")).cast("long")).scalar()
    # Largest remainders first: the smaller what is missing to the total, the earlier.
    lacking = F.col("total").cast("decimal(19,0)") - F.col("left_over")
    ranked = shares.select(
        group, F.lpad(lacking.cast("string"), 20, "0").alias("_h"),
        F.floor(lacking / F.col("total") * 65535).cast("int").alias("cell"))
    winners = _draw(ranked, [], lambda cells: cells.withColumn("seats", spare), group).select(group, F.lit(1).alias("extra"))
    return (
        shares.join(winners, group, "left")
        .select(group, "size", (F.col("seats") + F.coalesce("extra", F.lit(0))).cast("long").alias("seats"))
        .filter("seats > 0")
    )


#: A draw of at most so many rows broadcasts its cells: each holds a drawn row at least, so there are no more of them.
FEW_SEATS = 100_000


def sample_per_stratum(pool: DataFrame, group: str, seats: DataFrame, seed: int, key: str = "movie_id", most: int | None = None) -> DataFrame:
    """For each stratum the ``seats`` rows with the smallest seeded hash, or all if there are fewer; ``most`` is a bound of all seats, if known."""
    drawn = pool.withColumn("_h", seeded_hash(seed, key)).withColumn("cell", _hash_cell())
    return _draw(drawn, [group], lambda cells: cells.join(seats.select(group, "seats"), group), key, most).select(*(pool[f"`{c}`"] for c in pool.columns))


def _hash_cell():
    """The first four hash digits split a stratum into 65,536 even cells."""
    return F.substring("_h", 1, 4)


def _draw(drawn: DataFrame, groups: list[str], with_seats: Callable[[DataFrame], DataFrame], key: str, most: int | None = None) -> DataFrame:
    """The first ``seats`` rows of each group by ``_h``, without ordering a whole group: ``cell`` follows the same order, so cells behind the
    cut are left out by one join and only the rows of the others, hardly more than are drawn, are numbered. ``with_seats`` adds the seats to the cells."""
    before = Window.partitionBy(*groups).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = drawn.groupBy(*groups, "cell").agg(F.count(F.lit(1)).alias("cell_n"))
    cells = with_seats(cells.withColumn("below", F.coalesce(F.sum("cell_n").over(before), F.lit(0)))).filter("below < seats").select(*groups, "cell", "below", "seats")
    if most is not None and most <= FEW_SEATS:
        cells = F.broadcast(cells)
    placed = drawn.join(cells, [*groups, "cell"]).withColumn("place", F.row_number().over(Window.partitionBy(*groups, "cell").orderBy("_h", key)))
    return placed.filter("place <= seats - below")


def stratified_sample(pool: DataFrame, n: int, seed: int, group: str = "primary_genre", key: str = "movie_id") -> DataFrame:
    return sample_per_stratum(pool, group, allocate(pool, group, n), seed, key, n)


def simple_sample(pool: DataFrame, n: int, seed: int, key: str = "movie_id") -> DataFrame:
    """The ``n`` rows with the smallest seeded hash: the draw of a single stratum."""
    drawn = pool.withColumn("_h", seeded_hash(seed, key)).withColumn("cell", _hash_cell())
    return _draw(drawn, [], lambda cells: cells.withColumn("seats", F.lit(n).cast("long")), key, n).select(*(pool[f"`{c}`"] for c in pool.columns))


def sample(pool: DataFrame, n: int, seed: int, group: str = "primary_genre", key: str = "movie_id") -> DataFrame:
    """Stratified, unless ``n`` is below half the number of strata: then strata would only add noise.
    That count is the one number read before planning."""
    strata = pool.select(F.count_distinct(group)).first()[0]
    if n < strata / 2:
        return simple_sample(pool, n, seed, key)
    return stratified_sample(pool, n, seed, group, key)
