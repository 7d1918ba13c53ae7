"""Rating baseline by damped effects of users and items, fitted in alternating rounds of aggregates.

A rating is the mean of all plus what its item and its user add to it. In each round an item's effect is the sum of what its ratings leave beyond mean and
user, divided by their number plus DAMPING, then users likewise beyond mean and item. Few ratings so pull an effect little. Every round is two aggregates, written before the
next; ratings meet effects by joins that a hot user or item may skew, so those of very many ratings are joined apart (see ``heavy_keys``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from playbill.operators.heavy_keys import heavy_keys, split_join
from playbill.session import written

DAMPING, ROUNDS = 10.0, 3
LOWEST, HIGHEST = 0.5, 5.0


def split_by_time(ratings: DataFrame, cut: Column) -> tuple[DataFrame, DataFrame]:
    """Ratings before ``cut``, to fit on, and those from then on, to predict."""
    return ratings.where(F.col("ts") < cut), ratings.where(F.col("ts") >= cut)


def fit_effects(ratings: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> tuple[float | None, DataFrame, DataFrame]:
    """The mean of all ratings (null without any), (movie_id, item_effect) and (user_id, user_effect)."""
    rows = written(ratings.where("user_id is not null and movie_id is not null and rating is not null").select("user_id", "movie_id", F.col("rating").cast("double").alias("rating")), "ratings-fit")
    mean = rows.agg(F.avg("rating")).first()[0]
    heavy = {key: heavy_keys(rows, key) for key in ("movie_id", "user_id")}
    users = rows.sparkSession.createDataFrame([], f"user_id {rows.schema['user_id'].dataType.simpleString()}, user_effect double")
    items = None
    for turn in range(rounds):
        known = split_join(rows, users, "user_id", heavy["user_id"], "left") if turn else rows.withColumn("user_effect", F.lit(0.0))
        items = written(_effects(known, "movie_id", "user_effect", mean, damping, "item_effect"), "item-effects")
        known = split_join(rows, items, "movie_id", heavy["movie_id"], "left")
        users = written(_effects(known, "user_id", "item_effect", mean, damping, "user_effect"), "user-effects")
    return mean, items, users


def _effects(rows: DataFrame, key: str, other: str, mean: float | None, damping: float, name: str) -> DataFrame:
    left = F.col("rating") - F.lit(mean) - F.coalesce(other, F.lit(0.0))
    return rows.groupBy(key).agg((F.sum(left) / (F.count(F.lit(1)) + F.lit(damping))).alias(name))


def predict_effects(requests: DataFrame, mean: float | None, items: DataFrame, users: DataFrame) -> DataFrame:
    """Requests with ``predicted_rating``; an unknown user or item adds nothing, and without any ratings it is null."""
    rows = requests
    for key, effects in (("movie_id", items), ("user_id", users)):
        rows = split_join(rows, effects, key, heavy_keys(requests, key), "left")
    value = F.lit(mean).cast("double") + F.coalesce("item_effect", F.lit(0.0)) + F.coalesce("user_effect", F.lit(0.0))
    return rows.withColumn("predicted_rating", F.when(value.isNotNull(), F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), value)))).drop("item_effect", "user_effect")


def errors(model: str, predicted: DataFrame) -> DataFrame:
    """(model, n, rmse, mae) of predictions against ``actual``; rows without a prediction are not counted."""
    off = F.col("predicted_rating") - F.col("actual")
    return predicted.where(off.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(off * off)).alias("rmse"), F.avg(F.abs(off)).alias("mae")).select(F.lit(model).alias("model"), "n", "rmse", "mae")
