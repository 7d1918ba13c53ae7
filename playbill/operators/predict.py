"""Rating predictions for tables of (user, movie) requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from playbill.contracts import HISTORY_LENGTH, MIN_HISTORY
from playbill.functions.numbers import half_steps, round_even
from playbill.operators.history import pair_histories
from playbill.sources.tables import prepare_catalog

# Fixed values of the rule: how many genre ratings weigh as much as the user's mean, and the scale.
GENRE_WEIGHT = 5
LOWEST, HIGHEST = 0.5, 5.0


def _mean(entries: Column) -> Column:
    total = F.aggregate(entries, F.lit(0.0), lambda acc, h: acc + h["rating"])
    return F.try_divide(total, F.size(entries))


RULE_FACTS = ("genre_keys",)
TARGET_FACTS = ("title", "overview", "genre_names", "genre_keys")


def prediction_requests(
    requests: DataFrame, ratings: DataFrame, catalog: DataFrame, users: DataFrame | None = None, facts: Sequence[str] = RULE_FACTS,
) -> DataFrame:
    """Requests with the ``target_`` columns, leak-free ``history`` (entries carry ``facts`` too) and
    ``status``. An unknown target is reported before a short history."""
    targets = prepare_catalog(catalog).select(
        "movie_id", *[F.col(c).alias(f"target_{c}") for c in TARGET_FACTS], F.lit(True).alias("_known"))
    return (
        pair_histories(requests.join(targets, "movie_id", "left"), ratings, catalog, HISTORY_LENGTH, users, facts)
        .withColumn("n_history", F.size("history"))
        .withColumn("status", F.when(F.col("_known").isNull(), F.lit("target_not_found"))
                    .when(F.col("n_history") < MIN_HISTORY, F.lit("insufficient_history")).otherwise(F.lit("ok")))
        .drop("_known")
    )


def predict_by_rule(prepared: DataFrame) -> DataFrame:
    """Rule in place of a model: the user's recent mean, moved towards the mean of the history that
    shares a genre with the target, the more the more such ratings there are."""
    same = F.filter("history", lambda h: F.arrays_overlap(h["genre_keys"], F.col("target_genre_keys")))
    shift = F.coalesce(
        F.col("n_genre") / (F.col("n_genre") + GENRE_WEIGHT) * (F.col("genre_mean") - F.col("user_mean")), F.lit(0.0))
    why = F.format_string(
        "mean %.2f over %d ratings, %d of them sharing a genre", round_even(F.col("user_mean"), 2), F.col("n_history"), F.col("n_genre"))
    ok = F.col("status") == "ok"
    return (
        prepared.withColumn("_same", same)
        .withColumn("user_mean", _mean(F.col("history")))
        .withColumn("n_genre", F.size("_same"))
        .withColumn("genre_mean", _mean(F.col("_same")))
        .select(
            "user_id", "movie_id", "status",
            F.when(ok, half_steps(F.col("user_mean") + shift, LOWEST, HIGHEST)).alias("predicted_rating"),
            F.when(ok, why).alias("rationale"),
            F.col("n_history").alias("based_on_n_user_ratings"),
        )
    )


def predict_ratings(requests: DataFrame, ratings: DataFrame, catalog: DataFrame, users: DataFrame | None = None) -> DataFrame:
    return predict_by_rule(prediction_requests(requests, ratings, catalog, users))
