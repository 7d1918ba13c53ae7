"""Rating statistics per movie and user, and the joins between ratings and catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from playbill.contracts import ACTIVE_USER_RATINGS
from playbill.functions.numbers import round_even


def movie_rating_stats(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("movie_id").agg(F.avg("rating").alias("avg_rating"), F.count("rating").alias("n_ratings"))


def with_rating_stats(catalog: DataFrame, ratings: DataFrame) -> DataFrame:
    """Every catalog row with its mean rating (null if unrated) and count. Ratings are aggregated
    before the join, so a hot movie reaches the join as one row."""
    return (
        catalog.join(movie_rating_stats(ratings), "movie_id", "left")
        .withColumn("n_ratings", F.coalesce("n_ratings", F.lit(0).cast("long")))
    )


def top_rated(catalog: DataFrame, ratings: DataFrame, n: int) -> DataFrame:
    """Best mean rating first, unrated titles last."""
    return with_rating_stats(catalog, ratings).orderBy(F.desc_nulls_last("avg_rating"), "movie_id").limit(n)


def rated_titles(ratings: DataFrame, catalog: DataFrame, *columns: str) -> DataFrame:
    """Ratings of catalogued movies, with catalog columns."""
    return ratings.join(catalog.select("movie_id", *columns), "movie_id")


def user_stats(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_ratings"), round_even(F.avg("rating"), 2).alias("mean_rating"))


def active_users(ratings: DataFrame, least: int = ACTIVE_USER_RATINGS) -> DataFrame:
    return ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_ratings")).filter(F.col("n_ratings") >= least)


def unique_titles(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("title").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("title")
