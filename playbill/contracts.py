"""Schemas, vocabularies and value ranges shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Vocabularies, bounds and sort keys of the data contract.
SENTIMENTS = ("positive", "negative", "neutral")
TIERS = ("low", "medium", "high")
SORT_COLUMNS = {
    "revenue_desc": "revenue",
    "budget_desc": "budget",
    "score_desc": "production_effectiveness_score",
    "runtime_desc": "runtime",
    "rating_desc": "production_effectiveness_score",
}
MAX_LIMIT = 50
DEFAULT_LIMIT = 10
MIN_HISTORY = 3
HISTORY_LENGTH = 10
TOP_RATED = 8
BOTTOM_RATED = 5
ACTIVE_USER_RATINGS = 20
UNKNOWN_GENRE = "Unknown"
RELEASED = "Released"

# Column names of the data contract.
CATALOG_COLUMNS = (
    "movie_id", "title", "overview", "budget", "revenue", "runtime",
    "language", "genres", "release_date", "status",
)
#: Columns that a catalog may have besides; they are passed through.
EXTRA_CATALOG_COLUMNS = ("production_companies", "imdb_id")
RATING_COLUMNS = ("user_id", "movie_id", "rating", "ts")
ENRICHED_COLUMNS = (
    "movie_id", "overview_sentiment", "budget_tier", "revenue_tier",
    "production_effectiveness_score", "themes",
)
RESULT_COLUMNS = (
    "movie_id", "title", "release_year", "budget", "revenue", "runtime",
    "overview_sentiment", "budget_tier", "revenue_tier",
    "production_effectiveness_score", "themes",
)

# Columns of the stored enrichment table.
ENRICHED_SCHEMA = T.StructType([
    T.StructField("movie_id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("overview_sentiment", T.StringType()),
    T.StructField("budget_tier", T.StringType()),
    T.StructField("revenue_tier", T.StringType()),
    T.StructField("production_effectiveness_score", T.IntegerType()),
    T.StructField("themes", T.ArrayType(T.StringType())),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("model", T.StringType()),
])


@dataclass(frozen=True)
class Field:
    """One field of a request or answer: its kind and the values it may take."""

    name: str
    kind: str  # "int", "double", "text" or "texts"
    required: bool = False
    nullable: bool = True
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()
    min_items: int | None = None
    max_items: int | None = None


# Fields of requests and answers, with their bounds.
FILTER_FIELDS = (
    Field("genres", "texts", nullable=False),
    Field("budget_tier", "text", choices=TIERS),
    Field("revenue_tier", "text", choices=TIERS),
    Field("sentiment", "text", choices=SENTIMENTS),
    Field("min_score", "int", low=1, high=10),
    Field("min_year", "int"),
    Field("max_year", "int"),
    Field("min_budget", "int"),
    Field("max_budget", "int"),
    Field("min_runtime", "int"),
    Field("max_runtime", "int"),
    Field("sort_by", "text", choices=tuple(SORT_COLUMNS)),
    Field("limit", "int", nullable=False, low=1, high=MAX_LIMIT),
)
ENRICHED_FIELDS = (
    Field("overview_sentiment", "text", required=True, choices=SENTIMENTS),
    Field("budget_tier", "text", required=True, choices=TIERS),
    Field("revenue_tier", "text", required=True, choices=TIERS),
    Field("production_effectiveness_score", "int", required=True, low=1, high=10),
    Field("themes", "texts", required=True, min_items=3, max_items=5),
)
PREDICTION_FIELDS = (
    Field("predicted_rating", "double", required=True, low=0.5, high=5.0),
    Field("rationale", "text", required=True),
)
PROFILE_FIELDS = (
    Field("favorite_genres", "texts", required=True, max_items=5),
    Field("favorite_themes", "texts", required=True, max_items=5),
    Field("typical_sentiment", "text", required=True),
    Field("summary", "text", required=True),
)
