"""Profile of the catalog and its ratings: counts, missing rates, distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from playbill.functions.numbers import equal_width_bin
from playbill.operators import quantiles
from playbill.operators.filters import is_eligible
from playbill.session import written
from playbill.sources.tables import prepare_catalog


def row_counts(catalog: DataFrame, ratings: DataFrame) -> DataFrame:
    """One row: movies, ratings, users, rated movies and their share of the catalog in percent."""
    per_movie, users = ratings.groupBy("movie_id").agg(F.count(F.lit(1)).alias("n")), ratings.select("user_id").distinct()
    return (
        per_movie.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_ratings"), F.count("movie_id").alias("n_rated_movies"))
        .withColumn("n_users", users.agg(F.count("user_id")).scalar())
        .withColumn("n_movies", catalog.agg(F.count(F.lit(1))).scalar())
        .withColumn("rated_percent", F.round(F.try_divide(F.lit(100.0) * F.col("n_rated_movies"), F.col("n_movies")), 1))
        .select("n_ratings", "n_users", "n_rated_movies", "n_movies", "rated_percent")
    )


def eligible_share(catalog: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    eligible = F.count_if(is_eligible())
    return prepare_catalog(catalog).agg(n.alias("n_movies"), eligible.alias("n_eligible"), F.round(F.try_divide(eligible, n), 6).alias("share"))


def missing_rates(catalog: DataFrame) -> DataFrame:
    """Share of rows per field whose value is absent; zero amounts are absent."""
    def blank(column: str) -> Column:
        return F.col(column).isNull() | (F.col(column) == "")

    def zero(column: str) -> Column:
        return F.col(column).isNull() | (F.col(column) == 0)

    tests = {
        "overview_missing": ~F.col("has_overview"),
        "budget_zero": zero("budget"),
        "revenue_zero": zero("revenue"),
        "runtime_missing": zero("runtime"),
        "genres_missing": blank("genres"),
        "not_released": F.col("status").isNull() | (F.col("status") != "Released"),
    }
    wide = prepare_catalog(catalog).agg(*[F.avg(F.when(t, 1.0).otherwise(0.0)).alias(name) for name, t in tests.items()])
    pairs = ", ".join(f"'{name}', {name}" for name in tests)
    return wide.select(F.expr(f"stack({len(tests)}, {pairs}) as (field, rate)"))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """Count and share of each value."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def value_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of the values of several text columns, in long form."""
    pairs = ", ".join(f"'{c}', {c}" for c in columns)
    return (
        rows.select(F.expr(f"stack({len(columns)}, {pairs}) as (attribute, value)"))
        .filter("value is not null").groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def ratings_per(ratings: DataFrame, key: str) -> DataFrame:
    return ratings.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def describe(rows: DataFrame, column: str, percentiles: Sequence[float]) -> DataFrame:
    """Count, mean, sample deviation, minimum, interpolated percentiles and maximum in one row, of the values that are finite numbers. The
    values are written once; percentiles are exact and found by counting, so a column may have any number of distinct values."""
    values = written(rows.select(quantiles.finite(F.col(column)).alias("value")).where("value is not null"), "values")
    value = F.col("value")
    found = quantiles.percentiles(values, "value", values.count(), percentiles)
    return values.agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
        *[F.lit(v).cast("double").alias(f"p{round(p * 100)}") for p, v in zip(percentiles, found)],
        F.max(value).alias("max"),
    )


def histogram(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins over [min, max], empty bins included. Equal values are counted first; both
    the range and the bins come from those counts."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    placed = (
        counts.withColumn("range", counts.agg(F.struct(F.min("value").alias("low"), F.max("value").alias("high"))).scalar())
        .select("*", "range.low", "range.high")
        .groupBy(equal_width_bin(F.col("value"), F.col("low"), F.col("high"), bins).alias("bin"))
        .agg(F.sum("n").alias("n"))
    )
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(placed, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def most_common(rows: DataFrame, list_column: str, k: int, name: str) -> DataFrame:
    """The ``k`` most frequent list items (ties by item) and the number of distinct items."""
    counts = rows.select(F.explode(list_column).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.orderBy(F.desc("n"), name).limit(k)
        .withColumn("n_distinct", counts.agg(F.count(F.lit(1))).scalar())
    )
