"""Single questions to one catalog. Each is the batch operator on a one-row request; a user's ratings
are filtered at the scan."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from playbill.operators.inference import Scorer
from playbill.operators.lookup import compare, find_titles, lookup_enriched
from playbill.operators.predict import predict_ratings
from playbill.operators.profiles import profiles_for, user_profiles
from playbill.operators.search import search_json
from playbill.plans.models import predict_with_scorer, profiles_with_scorer
from playbill.session import configure


@dataclass(frozen=True)
class Desk:
    catalog: DataFrame
    ratings: DataFrame
    enriched: DataFrame
    #: Optional: predictions and profiles then come from the scorer instead of rules.
    scorer: Scorer | None = None
    model: str = "scorer"

    def __post_init__(self) -> None:
        configure(self.catalog.sparkSession)

    def _request(self, schema: str, *values) -> DataFrame:
        return self.catalog.sparkSession.createDataFrame([values], schema)

    def _ratings_of(self, user_id: int) -> DataFrame:
        return self.ratings.filter(F.col("user_id") == user_id)

    def query_movies(self, filter_json: str) -> DataFrame:
        """Rows that meet a JSON filter; ValueError for a bad one."""
        return search_json(self.catalog, self.enriched, filter_json)

    def get_enriched_movie(self, movie_id: int) -> DataFrame:
        return lookup_enriched(self._request("movie_id bigint", movie_id), self.enriched)

    def compare_movies(self, movie_ids_json: str) -> DataFrame:
        """Comparison of the ids of a JSON list."""
        ids = json.loads(movie_ids_json)
        ids = ids if isinstance(ids, list) else []
        return compare(self._request("request_id int, movie_ids array<bigint>", 1, ids), self.catalog, self.enriched).drop("request_id")

    def predict_user_rating(self, user_id: int, movie_id: int) -> DataFrame:
        asked, ratings = self._request("user_id bigint, movie_id bigint", user_id, movie_id), self._ratings_of(user_id)
        if self.scorer is None:
            return predict_ratings(asked, ratings, self.catalog)
        return predict_with_scorer(asked, ratings, self.catalog, self.enriched, self.scorer, self.model)

    def summarize_user_preferences(self, user_id: int) -> DataFrame:
        ratings = self._ratings_of(user_id)
        if self.scorer is None:
            profiles = user_profiles(ratings, self.catalog, self.enriched)
        else:
            profiles = profiles_with_scorer(ratings, self.catalog, self.enriched, self.scorer, self.model)
        return profiles_for(self._request("user_id bigint", user_id), profiles)

    def find_movies(self, title: str) -> DataFrame:
        """Ids of the titles equal to ``title``, letter case and outer spaces aside."""
        return find_titles(self._request("title string", title), self.catalog)


def as_json(rows: DataFrame) -> DataFrame:
    """Answers as JSON text, nulls included."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("answer"))
