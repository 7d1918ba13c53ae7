"""User preference profiles: best and worst rated titles, favourite genres and themes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from playbill.contracts import BOTTOM_RATED, TOP_RATED
from playbill.operators.ranking import top_per_key
from playbill.operators.ratings import user_stats
from playbill.sources.tables import prepare_catalog

MAX_FAVORITES = 5


def catalogued(ratings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Ratings of movies the catalog has."""
    return ratings.select("user_id", "movie_id", "rating", "ts").join(catalog.select("movie_id"), "movie_id", "left_semi")


def top_and_bottom(ratings: DataFrame, catalog: DataFrame, top: int = TOP_RATED, bottom: int = BOTTOM_RATED) -> DataFrame:
    """Each user's ``top`` best and ``bottom`` worst ratings, as ``side`` and ``rank`` (best first on
    both sides). The bottom appears only when it cannot overlap the top: when the user has
    ``top + bottom`` ratings, which the ranking from the top shows without counting them all."""
    rows = catalogued(ratings, catalog)

    def ranked(order: list[Column], k: int, name: str) -> DataFrame:
        first = top_per_key(rows, ["user_id"], order, k)
        return first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "movie_id", "rating", "ts"))).alias(name))

    def placed(entries: Column, side: str, rank) -> Column:
        return F.transform(entries, lambda e: F.struct(e["movie_id"].alias("movie_id"), e["rating"].alias("rating"), e["ts"].alias("ts"),
                                                       rank(e["rank"]).alias("rank"), F.lit(side).alias("side")))

    best = ranked([F.desc("rating"), F.asc("movie_id"), F.desc("ts")], top + bottom, "best")
    worst = ranked([F.asc("rating"), F.desc("movie_id"), F.asc("ts")], bottom, "worst")
    shown = F.when(F.size("best") == top + bottom, F.col("worst")).otherwise(F.slice("worst", 1, 0))
    both = F.concat(
        placed(F.slice("best", 1, top), "top", lambda r: r),
        placed(shown, "bottom", lambda r: F.lit(bottom + 1) - r),
    )
    return best.join(worst, "user_id").select("user_id", F.inline(both))


def _traits(top: DataFrame) -> DataFrame:
    """Favourite genres and themes and the typical sentiment of each user's top titles.

    Genres and themes go by frequency, then mean rating, then name. A sentiment is typical when more
    than half of the enriched top titles have it, otherwise the user is ``mixed``. A user has at most
    TOP_RATED rows here, so they are brought together once and everything after stays in place."""
    def tagged(kind: str, items: Column) -> Column:
        return F.transform(items, lambda item: F.struct(F.lit(kind).alias("kind"), item.alias("item")))

    nothing = F.array().cast("array<string>")
    traits = F.concat(
        tagged("genre", F.array_distinct("genre_names")),
        tagged("theme", F.array_distinct(F.coalesce("themes", nothing))),
        tagged("tone", F.array_compact(F.array("overview_sentiment"))),
    )
    counts = (
        top.select("user_id", "rating", traits.alias("traits")).repartition("user_id")
        .select("user_id", "rating", F.inline("traits"))
        .groupBy("user_id", "kind", "item").agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("mean"))
    )
    ranked = top_per_key(counts, ["user_id", "kind"], [F.desc("n"), F.desc("mean"), F.asc("item")], MAX_FAVORITES)

    def favorites(kind: str) -> Column:
        listed = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "item"))))
        return F.transform(listed, lambda x: x["item"])

    tone = F.col("kind") == "tone"
    most = F.max(F.when(tone & (F.col("rank") == 1), F.struct("n", "item")))
    return (
        ranked.groupBy("user_id").agg(
            favorites("genre").alias("favorite_genres"), favorites("theme").alias("favorite_themes"),
            most.alias("most"), F.sum(F.when(tone, F.col("n"))).alias("n_tone"))
        .select("user_id", "favorite_genres", "favorite_themes",
                F.when(F.col("most.n") * 2 > F.col("n_tone"), F.col("most.item"))
                .when(F.col("n_tone").isNotNull(), F.lit("mixed")).alias("typical_sentiment"))
    )


def _listed(items: Column, none: str) -> Column:
    return F.when(F.size(items) > 0, F.array_join(items, ", ")).otherwise(F.lit(none))


def user_profiles(ratings: DataFrame, catalog: DataFrame, enriched: DataFrame) -> DataFrame:
    """Profile of every user with ratings of catalogued movies."""
    known = catalogued(ratings, catalog)
    best = top_per_key(known, ["user_id"], [F.desc("rating"), F.asc("movie_id"), F.desc("ts")], TOP_RATED)
    top = (
        best.join(prepare_catalog(catalog).select("movie_id", "genre_names"), "movie_id")
        .join(enriched.select("movie_id", "overview_sentiment", "themes"), "movie_id", "left")
    )
    nothing = F.array().cast("array<string>")
    return (
        user_stats(known)
        .join(_traits(top), "user_id", "left")
        .withColumn("favorite_genres", F.coalesce("favorite_genres", nothing))
        .withColumn("favorite_themes", F.coalesce("favorite_themes", nothing))
        .withColumn("summary", F.format_string(
            "%d ratings with a mean of %.2f. Favorite genres: %s. Recurring themes: %s.",
            F.col("n_ratings"), F.col("mean_rating"), _listed(F.col("favorite_genres"), "none"), _listed(F.col("favorite_themes"), "none")))
        .select("user_id", "n_ratings", "mean_rating", "favorite_genres", "favorite_themes", "typical_sentiment", "summary")
    )


def profiles_for(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles of the requested users, with an ``error`` for users without ratings."""
    return (
        requests.select("user_id").join(profiles, "user_id", "left")
        .withColumn("error", F.when(F.col("n_ratings").isNull(),
                                    F.concat(F.lit("no ratings for user "), F.col("user_id").cast("string"))))
    )
