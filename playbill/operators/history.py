"""Rating histories: the newest ratings of a user, without the title that is to be predicted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from playbill.contracts import HISTORY_LENGTH
from playbill.functions.text import rated_line
from playbill.operators.ranking import top_per_key
from playbill.sources.tables import prepare_catalog


def newest_per_user(ratings: DataFrame, catalog: DataFrame, k: int = HISTORY_LENGTH, users: DataFrame | None = None) -> DataFrame:
    """Enough of each user's newest ratings of catalogued movies to serve any target: 2k rows.

    Keeping k per (user, movie) loses nothing, as no history shows more than k of one movie; then
    a target can remove at most k of the newest 2k. Both cuts are literal bounds, applied per task
    before the shuffle, so neither a hot user nor a hot movie gathers its rows in one task.
    ``users`` restricts the work to a few users (broadcast only if small)."""
    rows = ratings.select("user_id", "movie_id", "rating", "ts")
    if users is not None:
        rows = rows.join(users.select("user_id").distinct(), "user_id", "left_semi")
    newest = [F.desc("ts"), F.asc("movie_id"), F.asc("rating")]
    capped = top_per_key(rows, ["user_id", "movie_id"], [F.desc("ts"), F.asc("rating")], k, "_per_movie").drop("_per_movie")
    known = capped.join(catalog.select("movie_id"), "movie_id", "left_semi")
    return top_per_key(known, ["user_id"], newest, 2 * k, "recency")


def histories(
    ratings: DataFrame, catalog: DataFrame, k: int = HISTORY_LENGTH, users: DataFrame | None = None, facts: Sequence[str] = (),
) -> DataFrame:
    """One row per user with an array of at most 2k ratings, newest first, with the catalog columns
    ``facts`` of each rated movie."""
    newest = newest_per_user(ratings, catalog, k, users)
    if facts:
        newest = newest.join(prepare_catalog(catalog).select("movie_id", *facts), "movie_id")
    entry = F.struct("recency", "movie_id", "rating", "ts", *facts)
    return newest.groupBy("user_id").agg(F.array_sort(F.collect_list(entry)).alias("newest"))


def without_target(newest: Column, target: Column, k: int = HISTORY_LENGTH) -> Column:
    """The k newest ratings of other movies than the target."""
    kept = F.slice(F.filter(newest, lambda h: h["movie_id"] != target), 1, k)
    return F.coalesce(kept, F.array())


def pair_histories(
    pairs: DataFrame, ratings: DataFrame, catalog: DataFrame, k: int = HISTORY_LENGTH, users: DataFrame | None = None,
    facts: Sequence[str] = (),
) -> DataFrame:
    """``pairs`` (user_id, movie_id, ...) with the leak-free ``history`` array, empty if there is none."""
    return (
        pairs.join(histories(ratings, catalog, k, users, facts), "user_id", "left")
        .withColumn("history", without_target(F.col("newest"), F.col("movie_id"), k))
        .drop("newest")
    )


def history_rows(with_history: DataFrame) -> DataFrame:
    """Long form: one row per pair and remembered rating, ``rank`` 1 is the newest."""
    return (
        with_history.select("user_id", "movie_id", F.posexplode("history").alias("position", "h"))
        .select("user_id", "movie_id", (F.col("position") + 1).alias("rank"),
                F.col("h.movie_id").alias("rated_movie_id"), F.col("h.rating").alias("rating"), F.col("h.ts").alias("ts"))
    )


LINE_FACTS = ("title", "genre_names")


def history_text(history: Column) -> Column:
    """The history (with ``LINE_FACTS``) as lines of text, newest first."""
    return F.array_join(F.transform(history, lambda h: rated_line(h["rating"], h["title"], h["genre_names"])), "\n")
