"""Evaluation reports: run drift, prediction errors, token cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from playbill.functions.numbers import abs_error, token_cost
from playbill.operators.predict import predict_ratings
from playbill.operators.ranking import seeded_hash, top_per_key
from playbill.operators.ratings import active_users
from playbill.session import written

CATEGORICAL = ("overview_sentiment", "budget_tier", "revenue_tier", "production_effectiveness_score")
COMPARED = (*CATEGORICAL, "themes")

# Model prices in dollars per million input and output tokens.
PRICES = {"rules-v1": (0.07, 0.30)}
TITLE_WIDTH, RATIONALE_WIDTH = 40, 100
EXACT, NEAR, FAR = 0.0, 1.0, 2.5


def paired_runs(run_a: DataFrame, run_b: DataFrame) -> DataFrame:
    """Two runs side by side, with ``<field>_differs`` (null-safe) per compared field."""
    a = run_a.select("movie_id", *[F.col(c).alias(f"a_{c}") for c in COMPARED])
    b = run_b.select("movie_id", *[F.col(c).alias(f"b_{c}") for c in COMPARED])
    differs = {f"{c}_differs": ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in COMPARED}
    return a.join(b, "movie_id").withColumns(differs)


def drift_rows(run_a: DataFrame, run_b: DataFrame) -> DataFrame:
    """One row per movie and field whose values differ between the runs."""
    def shown(column: str):
        return F.array_join(column, ", ") if column.endswith("_themes") else F.col(column).cast("string")

    entries = F.array(*[
        F.when(F.col(f"{c}_differs"), F.struct(F.lit(c).alias("field"), shown(f"a_{c}").alias("before"), shown(f"b_{c}").alias("after")))
        for c in COMPARED])
    return (
        paired_runs(run_a, run_b)
        .select("movie_id", F.explode(F.array_compact(entries)).alias("d")).select("movie_id", "d.*")
    )


def run_drift(run_a: DataFrame, run_b: DataFrame) -> DataFrame:
    """Differences and comparisons per field, and over all categorical fields together."""
    wide = paired_runs(run_a, run_b).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"{c}_differs")).alias(c) for c in COMPARED])
    total = " + ".join(CATEGORICAL)
    pairs = ", ".join(f"'{c}', {c}, n" for c in COMPARED)
    return wide.select(F.expr(
        f"stack({len(COMPARED) + 1}, {pairs}, 'all_categorical', {total}, n * {len(CATEGORICAL)}) as (field, n_drift, n_compared)"))


def dry_run_table(enriched: DataFrame) -> DataFrame:
    """Enriched rows as a plain table, themes as text."""
    return enriched.select(
        "movie_id", "title", F.col("overview_sentiment").alias("sentiment"), "budget_tier", "revenue_tier",
        F.col("production_effectiveness_score").alias("score"), F.array_join("themes", ", ").alias("themes"),
        F.col("input_tokens").alias("tokens_asked"), F.col("output_tokens").alias("tokens_answered"))


def cost_report(enriched: DataFrame, prices: dict[str, tuple[float, float]] = PRICES) -> DataFrame:
    """Rows, tokens, total cost and cost per row for each model; cost is null without a price."""
    def price(which: int) -> Column:
        pairs = [part for model, both in prices.items() for part in (F.lit(model), F.lit(both[which]))]
        return F.try_element_at(F.create_map(*pairs), F.col("model"))

    return (
        enriched.groupBy("model").agg(
            F.count(F.lit(1)).alias("n_movies"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
        .withColumn("cost", token_cost(F.col("input_tokens"), F.col("output_tokens"), price(0), price(1)))
        .withColumn("cost_per_movie", F.col("cost") / F.col("n_movies"))
    )


def eval_candidates(ratings: DataFrame, catalog: DataFrame, enriched: DataFrame) -> DataFrame:
    """Ratings of enriched, catalogued movies by active users, with the true rating as ``actual``."""
    return (
        ratings.select("user_id", "movie_id", F.col("rating").alias("actual"), "ts")
        .join(enriched.select("movie_id"), "movie_id", "left_semi")
        .join(active_users(ratings).select("user_id"), "user_id", "left_semi")
        .join(catalog.select("movie_id", "title"), "movie_id")
    )


def first_per_movie(candidates: DataFrame) -> DataFrame:
    return top_per_key(candidates, ["movie_id"], [F.asc("user_id"), F.asc("ts"), F.asc("actual")], 1).drop("rank")


def eval_pairs(candidates: DataFrame, n: int = 5, seed: int = 7) -> DataFrame:
    """One pair per movie, then a seeded sample of ``n`` of them."""
    return first_per_movie(candidates).withColumn("_h", seeded_hash(seed)).orderBy("_h", "movie_id").limit(n).drop("_h")


def score_predictions(pairs: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predicted against actual, with cut texts and the absolute error."""
    return pairs.join(predictions, ["user_id", "movie_id"], "left").select(
        "user_id", "movie_id", F.substring("title", 1, TITLE_WIDTH).alias("title"),
        "predicted_rating", "actual", abs_error(F.col("predicted_rating"), F.col("actual")).alias("delta"),
        F.substring(F.coalesce("rationale", "status"), 1, RATIONALE_WIDTH).alias("rationale"))


def evaluate_predictions(ratings: DataFrame, catalog: DataFrame, enriched: DataFrame, n: int = 5, seed: int = 7) -> DataFrame:
    """The ``n`` sampled pairs are written once, and histories are built for their users only."""
    pairs = written(eval_pairs(eval_candidates(ratings, catalog, enriched), n, seed), "pairs")
    return score_predictions(pairs, predict_ratings(pairs.select("user_id", "movie_id"), ratings, catalog, users=pairs))


def prediction_hits(scored: DataFrame) -> DataFrame:
    """How many predictions are exact, within 1.0 and within 2.5, and the mean error."""
    delta = F.col("delta")
    return scored.agg(
        F.count(delta).alias("n"), F.count_if(delta == EXACT).alias("exact"), F.count_if(delta <= NEAR).alias("within_1"),
        F.count_if(delta <= FAR).alias("within_2_5"), F.round(F.avg(delta), 6).alias("mean_delta"))
