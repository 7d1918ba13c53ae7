"""Rating predictions and preference profiles answered by a user-supplied scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from playbill.contracts import PREDICTION_FIELDS, PROFILE_FIELDS
from playbill.operators.history import LINE_FACTS
from playbill.operators.inference import Scorer, run_inference
from playbill.operators.predict import prediction_requests
from playbill.operators.profiles import catalogued, top_and_bottom
from playbill.operators.ratings import user_stats
from playbill.plans.prompts import prediction_prompts, profile_prompts
from playbill.session import written
from playbill.sources.tables import prepare_catalog


def predict_with_scorer(
    requests: DataFrame, ratings: DataFrame, catalog: DataFrame, enriched: DataFrame, scorer: Scorer, model: str, **options,
) -> DataFrame:
    """As ``predict_ratings``, with rating and rationale from the scorer. Ids and the number of history
    rows never come from the model. A pair asked twice is scored once. Histories are
    built once and written: both the prompts and the final join read the table."""
    prepared = written(prediction_requests(requests, ratings, catalog, facts=LINE_FACTS), "prediction-requests")
    pair = F.concat_ws(":", "user_id", "movie_id")
    asked = prediction_prompts(prepared, enriched).select(pair.alias("pair"), "prompt").dropDuplicates(["pair"])
    answers = run_inference(asked, scorer, PREDICTION_FIELDS, model, key="pair", **options)
    return (
        prepared.select("user_id", "movie_id", F.col("status").alias("request_status"), "n_history", pair.alias("pair"))
        .join(answers, "pair", "left")
        .select("user_id", "movie_id", F.coalesce("status", "request_status").alias("status"), "predicted_rating", "rationale",
                F.col("n_history").alias("based_on_n_user_ratings"))
    )


def profiles_with_scorer(
    ratings: DataFrame, catalog: DataFrame, enriched: DataFrame, scorer: Scorer, model: str, **options,
) -> DataFrame:
    """As ``user_profiles``, with favourites, sentiment and summary from the scorer."""
    stats = written(user_stats(catalogued(ratings, catalog)), "user-stats")
    ranked = top_and_bottom(ratings, catalog)
    asked = profile_prompts(ranked, stats, prepare_catalog(catalog), enriched)
    answers = run_inference(asked, scorer, PROFILE_FIELDS, model, key="user_id", **options)
    return stats.join(
        answers.select("user_id", "status", "favorite_genres", "favorite_themes", "typical_sentiment", "summary"), "user_id", "left")
