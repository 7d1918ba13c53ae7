"""Prompt columns for enrichment, rating prediction and preference profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from playbill.contracts import UNKNOWN_GENRE
from playbill.functions.text import money, rated_line, rating_phrase, roi_phrase, runtime_phrase
from playbill.operators.history import history_text

ENRICH_TASK = (
    "Answer with one JSON object and nothing else: overview_sentiment (positive, negative or neutral: the tone of the "
    "overview), budget_tier and revenue_tier (low, medium or high within the genre), production_effectiveness_score "
    "(whole number from 1 to 10), themes (3 to 5 specific keywords, no genre names)."
)
PREDICT_TASK = (
    "Answer with one JSON object: predicted_rating (0.5 to 5.0) and rationale (one sentence). Stay near the user's mean "
    "unless the history gives a specific reason."
)
PROFILE_TASK = (
    "Answer with one JSON object: favorite_genres (at most 5), favorite_themes (at most 5, empty without enriched titles), "
    "typical_sentiment (positive, negative, neutral or mixed), summary (two or three sentences)."
)


def _lines(*parts: tuple[str, Column]) -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), F.coalesce(value, F.lit(""))) for label, value in parts])


def enrichment_prompts(pool: DataFrame) -> DataFrame:
    """``movie_id, prompt`` for a prepared pool with ``avg_rating`` and ``n_ratings``."""
    names = F.when(F.size("genre_names") > 0, F.col("genre_names")).otherwise(F.array(F.lit(UNKNOWN_GENRE)))
    budget, revenue = F.col("budget"), F.col("revenue")
    facts = _lines(
        ("Title", F.col("title")),
        ("Overview", F.col("overview")),
        ("Genres", F.array_join(names, ", ")),
        ("Budget", money(budget)),
        ("Revenue", money(revenue)),
        ("ROI", roi_phrase(revenue, budget)),
        ("Runtime", F.concat(runtime_phrase(F.col("runtime")), F.lit(" min"))),
        ("User ratings", rating_phrase(F.col("avg_rating"), F.col("n_ratings"))),
    )
    return pool.select("movie_id", F.concat_ws("\n\n", facts, F.lit(ENRICH_TASK)).alias("prompt"))


def prediction_prompts(prepared: DataFrame, enriched: DataFrame) -> DataFrame:
    """``user_id, movie_id, prompt`` for the requests that can be predicted (see
    ``prediction_requests``, with ``LINE_FACTS``)."""
    facts = enriched.select("movie_id", F.concat_ws(
        "; ",
        F.concat(F.lit("sentiment "), "overview_sentiment"), F.concat(F.lit("budget "), "budget_tier"),
        F.concat(F.lit("revenue "), "revenue_tier"),
        F.concat(F.lit("effectiveness "), F.col("production_effectiveness_score").cast("string")),
        F.concat(F.lit("themes "), F.array_join("themes", ", ")),
    ).alias("_facts"))
    body = _lines(
        ("Title", F.col("target_title")),
        ("Overview", F.col("target_overview")),
        ("Genres", F.array_join("target_genre_names", ", ")),
        ("Enriched", F.coalesce("_facts", F.lit("outside the enriched sample, only overview and genres are known"))),
    )
    head = F.concat(F.lit("Newest ratings of user "), F.col("user_id").cast("string"), F.lit(":"))
    target = F.concat(F.lit("Movie to rate, id "), F.col("movie_id").cast("string"), F.lit(":"))
    return (
        prepared.filter("status = 'ok'").join(facts, "movie_id", "left")
        .select("user_id", "movie_id", F.concat_ws(
            "\n", head, history_text(F.col("history")), F.lit(""), target, body, F.lit(""), F.lit(PREDICT_TASK)).alias("prompt"))
    )


def profile_prompts(ranked: DataFrame, stats: DataFrame, catalog: DataFrame, enriched: DataFrame) -> DataFrame:
    """``user_id, prompt`` from ``top_and_bottom`` rows and ``user_stats``; at most 13 lines per user."""
    shown = F.concat(
        rated_line(F.col("rating"), F.col("title"), F.col("genre_names")),
        F.lit(" themes="), F.coalesce(F.array_join(F.slice("themes", 1, 3), ", "), F.lit("")),
        F.lit(" sentiment="), F.coalesce("overview_sentiment", F.lit("unknown")))
    lines = (
        ranked.join(catalog.select("movie_id", "title", "genre_names"), "movie_id")
        .join(enriched.select("movie_id", "themes", "overview_sentiment"), "movie_id", "left")
        .groupBy("user_id")
        .agg(F.array_sort(F.collect_list(F.struct("side", "rank", "movie_id", "ts", shown.alias("line")))).alias("all"))
    )

    def side(name: str) -> Column:
        return F.transform(F.filter("all", lambda x: x["side"] == name), lambda x: x["line"])

    bottom = F.when(F.size(side("bottom")) > 0, F.concat(F.lit("Lowest rated:\n"), F.array_join(side("bottom"), "\n")))
    head = F.format_string("User %s: %d ratings, mean %.2f.", F.col("user_id").cast("string"), F.col("n_ratings"), F.col("mean_rating"))
    return lines.join(stats, "user_id").select("user_id", F.concat_ws(
        "\n\n", head, F.concat(F.lit("Highest rated:\n"), F.array_join(side("top"), "\n")), bottom, F.lit(PROFILE_TASK)).alias("prompt"))
