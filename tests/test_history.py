from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from frames import catalog, enriched, movie, ratings, rich
from playbill.operators import history, predict, profiles
from playbill.operators.ratings import user_stats
from playbill.plans import prompts
from playbill.sources.tables import prepare_catalog


def remembered(spark, rating_rows, pairs, movies):
    frame = spark.createDataFrame(pairs, "user_id bigint, movie_id bigint")
    found = history.pair_histories(frame, ratings(spark, rating_rows), movies)
    return {(r.user_id, r.movie_id): [(h.movie_id, h.rating) for h in r.history] for r in found.collect()}


def expected(rating_rows, pair, known, k=10):
    mine = sorted(((-d, m, r) for u, m, r, d in rating_rows if u == pair[0] and m != pair[1] and m in known))
    return [(m, float(r)) for _, m, r in mine[:k]]


def test_histories_equal_brute_force_under_skew(spark):
    """One user has most ratings and rates one movie many times; some movies are not catalogued."""
    rng = random.Random(11)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4]), rng.choice([7, 7, 7, *range(1, 16)]), rng.randrange(1, 11) / 2, rng.randrange(12)) for _ in range(400)]
    rows += [(5, 1, 3, 1), (5, 2, 3, 1)]
    rows += [(6, 7, 2, d) for d in range(30)] + [(6, m, 4, 0) for m in range(1, 13)]
    known = set(range(1, 14))
    movies = catalog(spark, [movie(m) for m in known])
    pairs = [(u, m) for u in range(1, 8) for m in (1, 7, 14, 99)]
    got = remembered(spark, rows, pairs, movies)
    assert got == {p: expected(rows, p, known) for p in pairs}
    assert all(m != target for (_, target), seen in got.items() for m, _ in seen)


def test_restricting_users_changes_nothing(spark):
    rows = [(u, m, 3, m) for u in (1, 2, 3) for m in range(1, 6)]
    movies = catalog(spark, [movie(m) for m in range(1, 6)])
    pairs = spark.createDataFrame([(2, 1)], "user_id bigint, movie_id bigint")
    free, tied = (history.pair_histories(pairs, ratings(spark, rows), movies, users=u).collect() for u in (None, pairs))
    assert free == tied


@pytest.fixture(scope="module")
def world(spark):
    movies = [movie(i, title=f"Unique {i}", genres="Drama|War" if i % 2 else "Comedy") for i in range(1, 21)]
    rows = [(1, m, 5 if m % 2 else 1, m) for m in range(1, 13)] + [(2, 1, 4, 1), (2, 2, 4, 2), (2, 3, 4, 3), (3, 1, 2, 1), (3, 2, 2, 1)]
    return ratings(spark, rows), prepare_catalog(catalog(spark, movies)).cache()


def test_predictions(spark, world):
    pairs = spark.createDataFrame([(1, 13), (1, 1), (2, 1), (2, 14), (3, 5), (9, 5), (9, 99), (1, 99)], "user_id bigint, movie_id bigint")
    got = {(r.user_id, r.movie_id): r for r in predict.predict_ratings(pairs, *world).collect()}
    assert got[(1, 13)].status == "ok" and got[(1, 13)].based_on_n_user_ratings == 10
    # mean 3.0 of the ten newest; five Drama ratings of 5.0 pull it up by half of the difference
    assert got[(1, 13)].predicted_rating == 4.0
    assert got[(1, 1)].predicted_rating == 4.0
    assert (got[(2, 1)].status, got[(2, 1)].based_on_n_user_ratings) == ("insufficient_history", 2)
    assert got[(2, 14)].predicted_rating == 4.0 and got[(2, 14)].based_on_n_user_ratings == 3
    assert got[(3, 5)].status == got[(9, 5)].status == "insufficient_history" and got[(9, 5)].based_on_n_user_ratings == 0
    assert got[(9, 99)].status == got[(1, 99)].status == "target_not_found" and got[(1, 99)].predicted_rating is None


def test_prompt_does_not_leak_the_target(spark, world):
    pairs = spark.createDataFrame([(1, m) for m in range(1, 13)], "user_id bigint, movie_id bigint")
    prepared = predict.prediction_requests(pairs, *world, facts=history.LINE_FACTS)
    made = prompts.prediction_prompts(prepared, enriched(spark, [rich(3)])).collect()
    assert len(made) == 12
    for row in made:
        seen, asked = row.prompt.split("Movie to rate")
        assert f"Unique {row.movie_id} " not in seen and f"Unique {row.movie_id}" in asked
        assert seen.count("/5.0") == 10
        assert ("outside the enriched sample" in asked) == (row.movie_id != 3)
    assert "  - 1.0/5.0 — Unique 12 [Comedy]\n  - 5.0/5.0 — Unique 11 [Drama, War]" in made[0].prompt


@pytest.mark.parametrize("n, top, bottom", [(1, 1, 0), (8, 8, 0), (12, 8, 0), (13, 8, 5), (20, 8, 5)])
def test_top_and_bottom_never_overlap(spark, n, top, bottom):
    movies = catalog(spark, [movie(m) for m in range(1, 21)])
    rows = ratings(spark, [(1, m, (m % 4 + 1), m) for m in range(1, n + 1)] + [(1, 50, 5, 1)])
    got = profiles.top_and_bottom(rows, movies).collect()
    sides = {s: [r.movie_id for r in sorted(got, key=lambda r: r.rank) if r.side == s] for s in ("top", "bottom")}
    order = sorted(range(1, n + 1), key=lambda m: (-(m % 4 + 1), m))
    assert sides["top"] == order[:top] and sides["bottom"] == (order[-5:] if bottom else [])


def test_profiles(spark, world):
    made = profiles.user_profiles(*world, enriched(spark, [rich(1, "negative", themes=("x", "y", "z")), rich(3, "negative", themes=("x", "q", "r")), rich(5, "positive")]))
    got = {r.user_id: r for r in made.collect()}
    assert got[1].n_ratings == 12 and got[1].mean_rating == 3.0
    assert got[1].favorite_genres == ["Drama", "War", "Comedy"]
    assert got[1].favorite_themes == ["x", "a", "b", "c", "q"]
    assert got[1].typical_sentiment == "negative" and "Drama, War, Comedy" in got[1].summary
    assert got[3].typical_sentiment == "negative" and got[3].mean_rating == 2.0
    asked = spark.createDataFrame([(1,), (77,)], "user_id bigint")
    answer = {r.user_id: r for r in profiles.profiles_for(asked, made).collect()}
    assert answer[1].error is None and "77" in answer[77].error


def test_mixed_and_missing_sentiment(spark, world):
    tie = profiles.user_profiles(*world, enriched(spark, [rich(1, "negative"), rich(2, "positive")]))
    assert {r.user_id: r.typical_sentiment for r in tie.collect()} == {1: "mixed", 2: "mixed", 3: "mixed"}
    none = profiles.user_profiles(*world, enriched(spark, []))
    assert {(r.typical_sentiment, tuple(r.favorite_themes)) for r in none.collect()} == {(None, ())}


def test_profile_prompt(spark, world):
    rows, movies = world
    made = prompts.profile_prompts(profiles.top_and_bottom(rows, movies), user_stats(rows), movies, enriched(spark, [rich(1)]))
    got = {r.user_id: r.prompt for r in made.collect()}
    assert "User 1: 12 ratings, mean 3.00." in got[1] and "Lowest rated" not in got[1]
    assert "  - 5.0/5.0 — Unique 1 [Drama, War] themes=a, b, c sentiment=positive" in got[1]


def test_mean_of_two_decimals(spark):
    rows = ratings(spark, [(1, m, 2.5 if m > 3 else 2, m) for m in range(1, 5)])
    assert user_stats(rows).first().mean_rating == round(8.5 / 4, 2)


def test_model_predictions_and_profiles(spark, world):
    import json

    import pandas as pd

    from playbill.plans.models import predict_with_scorer, profiles_with_scorer

    def scorer(batch, attempt):
        def reply(prompt):
            n = prompt.count("/5.0 ")
            if "Movie to rate" in prompt:
                return json.dumps({"predicted_rating": n / 2, "rationale": f"{n} lines"})
            return json.dumps({"favorite_genres": ["Drama"], "favorite_themes": [], "typical_sentiment": "mixed", "summary": f"{n} lines"})

        return pd.DataFrame({"content": [[{"text": reply(p), "reasoning": None}] for p in batch], "input_tokens": 1, "output_tokens": 1})

    rows, movies = world
    asked = spark.createDataFrame([(2, 14), (2, 14), (1, 13), (2, 1), (1, 99)], "user_id bigint, movie_id bigint")
    got = sorted(tuple(r) for r in predict_with_scorer(asked, rows, movies, enriched(spark, []), scorer, "m", retries=0).collect() if r.status in ("ok", "invalid"))
    assert got == [(1, 13, "ok", 5.0, "10 lines", 10), (2, 14, "ok", 1.5, "3 lines", 3), (2, 14, "ok", 1.5, "3 lines", 3)]
    statuses = {r.status for r in predict_with_scorer(asked, rows, movies, enriched(spark, []), scorer, "m").collect()}
    assert statuses == {"ok", "insufficient_history", "target_not_found"}
    made = {r.user_id: (r.n_ratings, r.status, r.summary) for r in profiles_with_scorer(rows, movies, enriched(spark, []), scorer, "m").collect()}
    assert made == {1: (12, "ok", "8 lines"), 2: (3, "ok", "3 lines"), 3: (2, "ok", "2 lines")}


def test_desk(spark, world):
    import json

    from playbill.plans.desk import Desk, as_json

    rows, movies = world
    desk = Desk(movies, rows, enriched(spark, [rich(1), rich(2)]))
    assert [r.movie_id for r in desk.query_movies('{"genres": ["drama"], "limit": 2}').collect()] == [1, 3]
    assert desk.get_enriched_movie(999999999).first().error
    assert len(desk.compare_movies("[1, 3]").first().movies) == 2 and len(desk.compare_movies("[1, 3, 2]").first().movies) == 3
    assert desk.compare_movies("[1]").first().error and "999999999" in desk.compare_movies("[1, 999999999]").first().note
    assert desk.predict_user_rating(999999999, 1).first().status == "insufficient_history"
    assert desk.predict_user_rating(1, 13).first().predicted_rating == 4.0
    assert desk.summarize_user_preferences(1).first().n_ratings == 12 and desk.summarize_user_preferences(5).first().error
    answer = json.loads(as_json(desk.get_enriched_movie(1)).first().answer)
    assert answer["error"] is None and answer["themes"] == ["a", "b", "c"]
