"""Small literal frames shared by the tests."""

from __future__ import annotations

from datetime import datetime, timedelta

CATALOG = (
    "movie_id bigint, title string, overview string, budget bigint, revenue bigint, runtime int, language string, "
    "genres string, release_date string, status string"
)
RATINGS = "user_id bigint, movie_id bigint, rating double, ts timestamp"
ENRICHED = (
    "movie_id bigint, title string, overview_sentiment string, budget_tier string, revenue_tier string, "
    "production_effectiveness_score int, themes array<string>, input_tokens bigint, output_tokens bigint, model string"
)
DAY = datetime(2020, 1, 1)


def movie(movie_id, title=None, overview="a text", budget=100, revenue=200, runtime=90, genres='[{"id": 1, "name": "Drama"}]',
          release_date="1995-05-01", status="Released"):
    return (movie_id, title or f"T{movie_id}", overview, budget, revenue, runtime, "en", genres, release_date, status)


def catalog(spark, rows):
    return spark.createDataFrame(rows, CATALOG)


def ratings(spark, rows):
    """Rows of (user, movie, rating, day number)."""
    return spark.createDataFrame([(u, m, float(r), DAY + timedelta(days=d)) for u, m, r, d in rows], RATINGS)


def rich(movie_id, sentiment="positive", budget_tier="low", revenue_tier="high", score=5, themes=("a", "b", "c"), tokens=(100, 50), model="m"):
    return (movie_id, f"T{movie_id}", sentiment, budget_tier, revenue_tier, score, list(themes) if themes is not None else None, *tokens, model)


def enriched(spark, rows):
    return spark.createDataFrame(rows, ENRICHED)
