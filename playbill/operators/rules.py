"""Rule-based enrichment: declared rules in place of a model. They follow its rubric; they do not
reproduce any model's answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from playbill.functions.numbers import roi
from playbill.operators.breaks import tiers_by_breaks
from playbill.operators.heavy_keys import LEAST_ROWS, SHARE, heavy_keys, split_join
from playbill.operators.ranking import percent_ranks, top_per_key
from playbill.session import written

# Fixed values of the rules.
TIER_CUTS = (1 / 3, 2 / 3)
ROI_WEIGHT, RATING_WEIGHT, UNRATED = 0.6, 0.4, 0.5
THEMES, THEME_LETTERS = 5, 4
RULE_MODEL = "rules-v1"


def words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}]+")


def tier(rank: Column, cuts: tuple[float, float] = TIER_CUTS) -> Column:
    return F.when(rank < cuts[0], F.lit("low")).when(rank < cuts[1], F.lit("medium")).when(rank.isNotNull(), F.lit("high"))


def effectiveness(roi_rank: Column, avg_rating: Column) -> Column:
    liked = F.coalesce((avg_rating - 0.5) / 4.5, F.lit(UNRATED))
    return F.least(F.lit(10), 1 + F.floor(9 * (ROI_WEIGHT * roi_rank + RATING_WEIGHT * liked))).cast("int")


def _terms(text: Column, genre_keys: Column) -> Column:
    """Words long enough to be a theme that do not name a genre of the title."""
    return F.filter(words(text), lambda w: (F.length(w) >= THEME_LETTERS) & ~F.array_contains(genre_keys, w))


def themes(pool: DataFrame, norms: DataFrame | None = None, k: int = THEMES) -> DataFrame:
    """The ``k`` words of each overview with the highest tf-idf against the overviews of ``norms``.

    Texts are spread by id before they are split, so the counts per text, and the ranking of a text's
    words where the word table is small enough to be broadcast, need no further shuffle. Texts are
    smaller than their exploded words. Document counts leave each task already summed per word. Words of very many texts meet their
    counts without a shuffle: their own counts tell which they are."""
    norms = pool if norms is None else norms
    terms = _terms(F.col("overview"), F.col("genre_keys"))
    own = (
        pool.select("movie_id", "overview", "genre_keys").repartition("movie_id")
        .select("movie_id", F.explode(terms).alias("word"))
        .groupBy("movie_id", "word").agg(F.count(F.lit(1)).alias("tf"))
    )
    spread = norms.select(F.explode(F.array_distinct(terms)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    spread = written(spread, "word-counts")
    uses = spread.agg(F.sum("df")).first()[0] or 0
    heavy = [r["word"] for r in spread.where(F.col("df") > max(LEAST_ROWS, SHARE * uses)).toLocalIterator()]
    n = norms.agg(F.count(F.lit(1))).scalar()
    scored = split_join(own, spread, "word", heavy).select(
        "movie_id", "word", F.round(F.col("tf") * F.ln(n / F.col("df")), 6).alias("score"))
    best = top_per_key(scored, ["movie_id"], [F.desc("score"), F.asc("word")], k)
    return best.groupBy("movie_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("themes"))


def sentiments_from_lexicon(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Tone of each overview: the sign of the summed ``weight`` of its words in ``lexicon`` (word,
    weight, each word once); neutral when they cancel out or none occurs. Words are counted before they are joined, and
    words of very many texts meet their weight without a shuffle."""
    used = texts.select("movie_id", F.explode(words(F.col("overview"))).alias("word"))
    counts = used.groupBy("movie_id", "word").agg(F.count(F.lit(1)).alias("n"))
    tones = split_join(counts, lexicon.select("word", "weight"), "word", heavy_keys(used, "word")).groupBy("movie_id").agg(F.sum(F.col("n") * F.col("weight")).alias("tone"))
    named = F.when(F.col("tone") > 0, F.lit("positive")).when(F.col("tone") < 0, F.lit("negative")).otherwise(F.lit("neutral"))
    return texts.select("movie_id").join(tones, "movie_id", "left").select("movie_id", named.alias("overview_sentiment"))


def enrich_by_rules(
    pool: DataFrame, stats: DataFrame, sentiments: DataFrame, norms: DataFrame | None = None,
    cuts: tuple[float, float] = TIER_CUTS, k: int = THEMES, breaks: bool = False,
) -> DataFrame:
    """Enriched rows for a prepared pool. ``stats`` has ``movie_id, avg_rating``, ``sentiments`` has
    ``movie_id, overview_sentiment`` (missing: neutral). Tiers and scores compare a row with its
    primary genre in ``norms`` (default: the pool itself), which must contain the pool. Tiers are thirds of the rank (``cuts``), or, with
    ``breaks``, start where the genre's amounts part by themselves."""
    def measured(rows: DataFrame) -> DataFrame:
        return rows.select("movie_id", "primary_genre", "budget", "revenue", roi(F.col("revenue"), F.col("budget")).alias("roi"))

    among = None if norms is None else measured(norms)
    ranks = percent_ranks(measured(pool), "movie_id", "primary_genre", ["budget", "revenue", "roi"], among)
    n_words = F.size(F.filter(words(F.col("overview")), lambda w: w != ""))
    by_rank = ranks.select("movie_id", "roi_rank", tier(F.col("budget_rank"), cuts).alias("budget_tier"), tier(F.col("revenue_rank"), cuts).alias("revenue_tier"))
    if breaks:
        ranks = by_rank.select("movie_id", "roi_rank").join(tiers_by_breaks(measured(pool), "movie_id", "primary_genre", ["budget", "revenue"], among), "movie_id")
    else:
        ranks = by_rank
    return (
        pool.select("movie_id", "title", n_words.cast("long").alias("input_tokens"))
        .join(ranks, "movie_id")
        .join(themes(pool, norms, k), "movie_id", "left")
        .join(stats.select("movie_id", "avg_rating"), "movie_id", "left")
        .join(sentiments, "movie_id", "left")
        .select(
            "movie_id", "title",
            F.coalesce("overview_sentiment", F.lit("neutral")).alias("overview_sentiment"),
            "budget_tier", "revenue_tier",
            effectiveness(F.col("roi_rank"), F.col("avg_rating")).alias("production_effectiveness_score"),
            F.coalesce("themes", F.array().cast("array<string>")).alias("themes"),
            "input_tokens",
            (F.coalesce(F.size("themes"), F.lit(0)) + 4).cast("long").alias("output_tokens"),
            F.lit(RULE_MODEL).alias("model"),
        )
    )
