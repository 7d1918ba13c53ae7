from __future__ import annotations

import statistics

import pytest
from pyspark.sql import functions as F

from frames import catalog, enriched, movie, ratings, rich
from playbill.operators import profile_report as report
from playbill.operators import ratings as rated


@pytest.fixture(scope="module")
def world(spark):
    movies = [movie(1), movie(2, budget=0, revenue=None), movie(3, overview=None, status=None), movie(4, genres="", runtime=0, title="T1")]
    return catalog(spark, movies), ratings(spark, [(1, 1, 4, 1), (2, 1, 3, 1), (1, 2, 5, 2), (1, 77, 1, 3)])


def test_counts_and_missing(world):
    row = report.row_counts(*world).first()
    assert (row.n_movies, row.n_ratings, row.n_users, row.n_rated_movies, row.rated_percent) == (4, 4, 2, 3, 75.0)
    rates = {r.field: r.rate for r in report.missing_rates(world[0]).collect()}
    assert rates == dict.fromkeys(("overview_missing", "budget_zero", "revenue_zero", "runtime_missing", "genres_missing", "not_released"), 0.25)
    assert report.eligible_share(world[0]).first().n_eligible == 1


def test_rating_joins(world):
    rows = {r.movie_id: (r.avg_rating, r.n_ratings) for r in rated.with_rating_stats(*world).collect()}
    assert rows == {1: (3.5, 2), 2: (5.0, 1), 3: (None, 0), 4: (None, 0)}
    assert [r.movie_id for r in rated.top_rated(*world, 3).collect()] == [2, 1, 3]
    assert rated.rated_titles(world[1], world[0], "title").count() == 3
    assert {r.title for r in rated.unique_titles(world[0]).collect()} == {"T2", "T3"}
    assert [r.user_id for r in rated.active_users(world[1], 3).collect()] == [1]


def test_describe_and_histograms(spark):
    values = [1, 2, 2, 3, 10, 40]
    frame = spark.createDataFrame([(v,) for v in values], "n int")
    row = report.describe(frame, "n", (0.5, 0.9)).first()
    assert (row["count"], row["min"], row["max"], row.p50, row.p90) == (6, 1.0, 40.0, 2.5, 25.0)
    assert row["std"] == pytest.approx(statistics.stdev(values))
    bins = [r.n for r in report.histogram(frame, "n", 4).orderBy("bin").collect()]
    assert bins == [5, 0, 0, 1]
    same = [r.n for r in report.histogram(frame.filter("n = 2"), "n", 10).orderBy("bin").collect()]
    assert same == [0, 0, 0, 0, 0, 2, 0, 0, 0, 0]


def test_distributions(spark):
    rows = enriched(spark, [rich(1, themes=("a", "b")), rich(2, "neutral", themes=("b", "c")), rich(3, None, themes=("b", "a"))])
    counts = {(r.attribute, r.value): r.n for r in report.value_counts(rows, ("overview_sentiment", "budget_tier")).collect()}
    assert counts == {("overview_sentiment", "positive"): 1, ("overview_sentiment", "neutral"): 1, ("budget_tier", "low"): 3}
    assert [(r.theme, r.n, r.n_distinct) for r in report.most_common(rows, "themes", 2, "theme").orderBy(F.desc("n")).collect()] == [("b", 3, 3), ("a", 2, 3)]
    shares = {r.budget_tier: r.share for r in report.distribution(rows, "budget_tier").collect()}
    assert shares == {"low": 1.0}
