"""One query per operator, over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from playbill.contracts import ENRICHED_FIELDS
from playbill.functions.dates import filter_year, release_year
from playbill.functions.names import first_three, parse_names, primary_name
from playbill.functions.numbers import abs_error, roi
from playbill.operators import (
    baseline, breaks, filters, history, inference, lookup, predict, profile_report as report, profiles, ratings as rated, sampling, search, validate, vectors,
)
from playbill.operators.rules import sentiments_from_lexicon, words
from playbill.plans import enrichment, evaluation, models, prompts
from playbill.session import new_run_dir
from playbill.sources.sinks import append_enriched, format_records
from playbill.sources.specs import parse_filter_specs
from playbill.sources.tables import scan_catalog, scan_enriched, scan_ratings
from workload.tables import Tables, rules, tables

SAMPLE_SIZE, SAMPLE_SEED = 75, 42
DAY = "yyyy-MM-dd"


def themes_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("themes", F.array_join("themes", ","))


def day(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts", F.date_format("ts", DAY))


# Requests derived from the given tables.

def filter_requests(t: Tables) -> DataFrame:
    """A JSON filter per supplier: good ones of many shapes, bad values and broken text."""
    s = F.col("s_suppkey")
    kind = s % 14
    year = (s % 30 + 1980).cast("string")
    text = (
        F.when(kind == 0, F.concat(F.lit('{"genres": ["promo", "Brand#'), (s % 25).cast("string"), F.lit('"], "min_year": '), year, F.lit(', "sort_by": "revenue_desc"}')))
        .when(kind == 1, F.concat(F.lit('{"min_year": '), year, F.lit(', "max_year": "1999", "limit": 20, "sort_by": "budget_desc", "title": "x"}')))
        .when(kind == 2, F.lit('{"budget_tier": "high", "sentiment": "positive", "min_score": 5.0, "sort_by": "rating_desc"}'))
        .when(kind == 3, F.lit('{"genres": ["Economy", "ECONOMY", "small"], "revenue_tier": "low", "limit": 50}'))
        .when(kind == 4, F.lit('{"genres": ["%"], "limit": 5}'))
        .when(kind == 5, F.concat(F.lit('{"max_budget": '), (s * 1000).cast("string"), F.lit(', "min_runtime": 10, "max_runtime": 40, "sort_by": "runtime_desc"}')))
        .when(kind == 6, F.lit('{"budget_tier": "LOW", "limit": -3}'))
        .when(kind == 7, F.lit('{"min_score": 7.25, "limit": 51, "sort_by": "title_asc"}'))
        .when(kind == 8, F.lit('{"min_year": 1990'))
        .when(kind == 9, F.concat(F.lit('{"max_budget": '), (s * 1000).cast("string"), F.lit(', "sort_by": "score_desc"}')))
        .when(kind == 10, F.concat(F.lit('{"min_runtime": '), (s % 50).cast("string"), F.lit(', "limit": 50}')))
        .when(kind == 11, F.lit('{"min_year": 0, "max_year": 9999, "sort_by": "revenue_desc", "limit": 50}'))
        .when(kind == 12, F.lit('{"sort_by": "budget_desc"}'))
        .otherwise(F.lit('{"genres": null, "sentiment": null}'))
    )
    return t.read("supplier").select(s.alias("spec_id"), text.alias("filter_json"))


def typed_filters(t: Tables) -> DataFrame:
    """Typed filters, one per part, some out of bounds."""
    k, size = F.col("p_partkey"), F.col("p_size")
    none = F.lit(None).cast("long")
    return t.read("part").select(
        k.alias("spec_id"), F.array("p_type").alias("genres"),
        F.get(F.array(*map(F.lit, ("low", "medium", "high", "huge"))), (k % 5).cast("int")).alias("budget_tier"),
        F.lit("high").alias("revenue_tier"),
        F.get(F.array(*map(F.lit, ("positive", "negative", "neutral", "cheerful"))), (k % 7).cast("int")).alias("sentiment"),
        (size % 13).cast("long").alias("min_score"), none.alias("min_year"), none.alias("max_year"), none.alias("min_budget"),
        none.alias("max_budget"), none.alias("min_runtime"), none.alias("max_runtime"),
        F.get(F.array(*map(F.lit, ("revenue_desc", "budget_desc", "score_desc", "runtime_desc", "rating_desc", "by_magic"))), (k % 8).cast("int")).alias("sort_by"),
        (size + 2).cast("long").alias("limit"),
    )


def pair_requests(t: Tables) -> DataFrame:
    """Every rated pair, and one further pair per customer whose movie is often unknown."""
    return t.ratings.select("user_id", "movie_id").union(customer_requests(t)).distinct()


def customer_requests(t: Tables) -> DataFrame:
    return t.read("customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") * 2).alias("movie_id"))


def comparison_requests(t: Tables) -> DataFrame:
    """One request per order: one, two or three ids, some unknown, some repeated."""
    a, b = F.col("o_custkey"), F.col("o_orderkey")
    ids = F.when(F.col("o_orderpriority") == "5-LOW", F.array(a)).when(F.col("o_orderstatus") == "F", F.array(a, b, a)).otherwise(F.array(b, a))
    return t.read("orders").select(b.alias("request_id"), ids.alias("movie_ids"))


def model_responses(t: Tables) -> DataFrame:
    """Model-like answers around each document: a reasoning block, then text, fenced for half of them."""
    body = F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("```json\n"), "text", F.lit("\n```\n"))).otherwise(F.concat(F.lit("  "), "text", F.lit("\n")))
    half = (F.length(body) / 2).cast("int")

    def block(text, reasoning):
        return F.struct(text.alias("text"), reasoning.alias("reasoning"))

    none = F.lit(None).cast("string")
    blocks = F.array(block(none, F.col("lang")), block(F.substr(body, F.lit(1), half), none), block(F.substr(body, half + 1), none))
    return t.read("documents").select("doc_id", blocks.alias("content"))


def damaged_enrichment(t: Tables) -> DataFrame:
    """The enrichment table with values pushed out of bounds for part of the rows."""
    k = F.col("movie_id")
    return t.enriched.select(
        "movie_id",
        F.when(k % 5 == 1, "mixed").otherwise(F.col("overview_sentiment")).alias("overview_sentiment"),
        F.when(k % 7 == 2, F.lit(None).cast("string")).otherwise(F.col("budget_tier")).alias("budget_tier"), "revenue_tier",
        (F.col("production_effectiveness_score") + k % 6 - 1).cast("long").alias("production_effectiveness_score"),
        F.when(k % 4 == 3, F.slice("themes", 1, 2)).when(k % 4 == 2, F.concat("themes", F.array(F.lit("more")))).otherwise(F.col("themes")).alias("themes"),
    )


def title_scorer() -> inference.Scorer:
    """A small deterministic scorer that fails in known ways, by the length of the title. It is made
    here, not imported, so that workers need no module of this repo."""
    def answer(size: int, attempt: int) -> str:
        if size % 3 == 0 and attempt == 0:
            return "not JSON"
        score = 11 if size % 6 == 0 and attempt <= 1 or size % 12 == 0 else 1 + size % 10
        return (
            '```json\n{"overview_sentiment": "neutral", "budget_tier": "low", "revenue_tier": "high", '
            f'"production_effectiveness_score": {score}.0, "themes": ["a", "b", "c{size}"]}}\n```'
        )

    def score(batch: pd.Series, attempt: int) -> pd.DataFrame:
        sizes = batch.str.extract(r"^Title: (.*)", expand=False).str.len()
        content = sizes.map(lambda n: [{"text": None, "reasoning": "thinking"}, {"text": answer(int(n), attempt), "reasoning": None}])
        return pd.DataFrame({"content": content, "input_tokens": sizes, "output_tokens": attempt + 1})

    return score


def line_scorer() -> inference.Scorer:
    """Rates by the number of history lines and lists their number; also made here, not imported."""
    def score(batch: pd.Series, attempt: int) -> pd.DataFrame:
        lines = batch.str.count("  - ")
        rating = batch.str.contains("Movie to rate", regex=False)
        texts = [
            f'{{"predicted_rating": {n / 2}, "rationale": "{n} lines"}}' if rate else
            f'{{"favorite_genres": ["g"], "favorite_themes": [], "typical_sentiment": "mixed", "summary": "{n} lines"}}'
            for n, rate in zip(lines, rating)
        ]
        return pd.DataFrame({"content": [[{"text": t, "reasoning": None}] for t in texts], "input_tokens": 1, "output_tokens": 1})

    return score


def label_lexicon(t: Tables) -> DataFrame:
    """Weights learned from the labels: documents with a word that are positive, less those that are negative."""
    tone = F.when(F.col("toxic") == 1, -1).when(F.col("quality") == 1, 1).otherwise(0)
    labelled = t.read("documents").join(t.read("labels").select("doc_id", tone.cast("long").alias("tone")), "doc_id")
    return (
        labelled.select("tone", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
        .groupBy("word").agg(F.sum("tone").alias("weight")).filter("weight <> 0")
    )


def asked_titles(t: Tables) -> DataFrame:
    """A title per supplier, in other letter case and with outer spaces; some are unknown."""
    part = t.read("part").select(F.col("p_partkey").alias("s_suppkey"), F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ")).alias("title"))
    known = t.read("supplier").select("s_suppkey").join(part, "s_suppkey", "left")
    return known.select(F.col("s_suppkey").alias("request_id"), F.when(F.col("s_suppkey") % 4 == 0, F.lit("no such title")).otherwise(F.col("title")).alias("title"))


# Queries.

def scan_catalog_query(t: Tables) -> DataFrame:
    return scan_catalog(t.spark, t.stored("catalog"), ("movie_id", "title", "budget", "revenue", "runtime", "genres", "release_date"))


def parse_genres(t: Tables) -> DataFrame:
    return t.catalog.select("movie_id", F.array_join(parse_names(F.col("genres")), ";").alias("names"), F.size(parse_names(F.col("genres"))).cast("long").alias("n_names"))


def render_prompts(t: Tables) -> DataFrame:
    return prompts.enrichment_prompts(enrichment.rated_pool(t.catalog, t.ratings))


def history_lines(t: Tables) -> DataFrame:
    found = history.pair_histories(pair_requests(t), t.ratings, t.catalog, facts=history.LINE_FACTS)
    return found.select("user_id", "movie_id", history.history_text(F.col("history")).alias("lines"))


def render_prediction_prompts(t: Tables) -> DataFrame:
    prepared = predict.prediction_requests(customer_requests(t), t.ratings, t.catalog, facts=history.LINE_FACTS)
    return prompts.prediction_prompts(prepared, t.enriched)


def render_profile_prompts(t: Tables) -> DataFrame:
    ranked = profiles.top_and_bottom(t.ratings, t.catalog)
    stats = rated.user_stats(profiles.catalogued(t.ratings, t.catalog))
    return prompts.profile_prompts(ranked, stats, t.catalog, t.enriched)


def search_rows(**wanted) -> Callable[[Tables], DataFrame]:
    return lambda t: themes_text(search.candidates(t.catalog, t.enriched, **wanted))


def best_rows(**wanted) -> Callable[[Tables], DataFrame]:
    return lambda t: themes_text(search.search(t.catalog, t.enriched, **wanted))


def query_movies_batch(t: Tables) -> DataFrame:
    specs = parse_filter_specs(filter_requests(t)).filter("valid")
    return themes_text(search.search_batch(t.catalog, t.enriched, specs))


def parse_filter_specs_query(t: Tables) -> DataFrame:
    return parse_filter_specs(filter_requests(t)).withColumn("genres", F.array_join("genres", ";"))


def eligible_pool(t: Tables) -> DataFrame:
    return enrichment.eligible_pool(t.catalog).select("movie_id", "primary_genre", "budget", "revenue")


def movies_with_ratings(t: Tables) -> DataFrame:
    rows = rated.with_rating_stats(t.catalog.select("movie_id", "title"), t.ratings)
    return rows.withColumn("avg_rating", F.round("avg_rating", 6))


def movie_rating_stats(t: Tables) -> DataFrame:
    return rated.movie_rating_stats(t.ratings).withColumn("avg_rating", F.round("avg_rating", 6))


def first_per_movie(t: Tables) -> DataFrame:
    return day(evaluation.first_per_movie(evaluation.eval_candidates(t.ratings, t.catalog, t.enriched)))


def ratings_per_key(t: Tables) -> DataFrame:
    per = [report.ratings_per(t.ratings, k).select(F.lit(k).alias("key_name"), F.col(k).alias("key"), "n") for k in ("movie_id", "user_id")]
    return per[0].unionByName(per[1])


def describe_counts(t: Tables) -> DataFrame:
    per = [
        report.describe(report.ratings_per(t.ratings, k), "n", (0.5, 0.9)).withColumn("key_name", F.lit(k))
        for k in ("movie_id", "user_id")
    ]
    return rounded(per[0].unionByName(per[1]))


def score_describe(t: Tables) -> DataFrame:
    return rounded(report.describe(t.enriched, "production_effectiveness_score", (0.25, 0.5, 0.75)), 2)


def rounded(rows: DataFrame, digits: int = 6) -> DataFrame:
    return rows.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes])


def clipped_histogram(t: Tables) -> DataFrame:
    counts = report.ratings_per(t.ratings, "movie_id").select(F.least("n", F.lit(100)).alias("n_ratings"))
    return report.histogram(counts, "n_ratings", 30)


def similar_titles(t: Tables, probes: int | None = None) -> DataFrame:
    """Every 20th vector against all of them."""
    rows = t.read("embeddings")
    found = vectors.similar(vectors.build_index(rows), rows.where("vec_id % 20 = 0"), probes=probes)
    return found.withColumn("score", F.round("score", 6))


def stratum_allocation(t: Tables) -> DataFrame:
    return sampling.allocate(enrichment.eligible_pool(t.catalog), "primary_genre", SAMPLE_SIZE)


def stratified_sample(t: Tables) -> DataFrame:
    return rounded(enrichment.sampled_pool(t.catalog, t.ratings, SAMPLE_SIZE, SAMPLE_SEED).select("movie_id", "title", "primary_genre", "avg_rating", "n_ratings"))


def small_sample(t: Tables) -> DataFrame:
    """Three rows are fewer than half the strata, so the strata are ignored."""
    return sampling.sample(enrichment.eligible_pool(t.catalog), 3, SAMPLE_SEED).select("movie_id", "title", "primary_genre")


def run_pair(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The stored enrichment, and the same titles under other cuts with fewer themes."""
    pool = enrichment.eligible_pool(t.catalog).join(t.enriched.select("movie_id"), "movie_id", "left_semi")
    return t.enriched, rules(t, pool, cuts=(0.4, 0.7), k=4)


def full_enriched(t: Tables) -> DataFrame:
    names = [f.name for f in enrichment.ENRICHED_SCHEMA]
    return scan_enriched(t.spark, t.stored("enriched"), names)


def cost_report(t: Tables) -> DataFrame:
    return rounded(evaluation.cost_report(full_enriched(t)), 9)


def compare_movies(t: Tables) -> DataFrame:
    def text(m):
        shown = ("movie_id", "title", "release_year", "budget", "revenue", "runtime", "overview_sentiment", "budget_tier",
                 "revenue_tier", "production_effectiveness_score")
        return F.concat_ws("|", *[F.coalesce(m[c].cast("string"), F.lit("-")) for c in shown], F.array_join(m["themes"], ","))

    table = lookup.compare(comparison_requests(t), t.catalog, t.enriched)
    return table.select("request_id", "error", "note", F.array_join(F.transform("movies", text), ";").alias("movies"))


def compare_notes(t: Tables) -> DataFrame:
    return lookup.compare(comparison_requests(t), t.catalog, t.enriched).filter("note is not null").select("request_id", "note")


def predict_ratings(t: Tables) -> DataFrame:
    return predict.predict_ratings(pair_requests(t), t.ratings, t.catalog).withColumn(
        "based_on_n_user_ratings", F.col("based_on_n_user_ratings").cast("long"))


def prediction_delta(t: Tables) -> DataFrame:
    """Every rated pair's leak-free prediction against its newest rating."""
    actual = t.ratings.groupBy("user_id", "movie_id").agg(F.max(F.struct("ts", "rating"))["rating"].alias("actual"))
    made = predict.predict_ratings(actual.select("user_id", "movie_id"), t.ratings, t.catalog)
    return actual.join(made.select("user_id", "movie_id", "predicted_rating"), ["user_id", "movie_id"]).select(
        "user_id", "movie_id", "predicted_rating", "actual", abs_error(F.col("predicted_rating"), F.col("actual")).alias("delta"))


def prediction_eval(t: Tables) -> DataFrame:
    return evaluation.evaluate_predictions(t.ratings, t.catalog, t.enriched)


def rating_baseline(t: Tables) -> DataFrame:
    """Three models fitted on the ratings before a day and held against those from then on."""
    train, test = baseline.split_by_time(t.ratings, F.lit("1997-01-01").cast("date"))
    asked = test.select("user_id", "movie_id", F.col("rating").alias("actual"))
    mean, items, users = baseline.fit_effects(train)
    by_rule = predict.predict_ratings(asked.select("user_id", "movie_id").distinct(), train, t.catalog).select("user_id", "movie_id", "predicted_rating")
    made = {"effects": baseline.predict_effects(asked, mean, items, users), "mean": asked.withColumn("predicted_rating", F.lit(mean).cast("double")),
            "history rule": asked.join(by_rule, ["user_id", "movie_id"])}
    rows = [baseline.errors(name, predicted) for name, predicted in made.items()]
    return rounded(rows[0].unionByName(rows[1]).unionByName(rows[2]))


def user_profiles(t: Tables) -> DataFrame:
    made = profiles.user_profiles(t.ratings, t.catalog, t.enriched)
    return made.withColumn("favorite_genres", F.array_join("favorite_genres", ",")).withColumn("favorite_themes", F.array_join("favorite_themes", ","))


def validated(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, "valid", "reject_reason")


def validate_predictions(t: Tables) -> DataFrame:
    made = t.ratings.select(
        "user_id", "movie_id", (F.col("rating") * 1.25 - 0.25).alias("predicted_rating"),
        F.when(F.col("rating") != 2.5, "because").alias("rationale"))
    return validate.validate_predictions(made).groupBy("predicted_rating", "valid", "reject_reason").agg(F.count(F.lit(1)).alias("n"))


def validate_profiles(t: Tables) -> DataFrame:
    made = profiles.user_profiles(t.ratings, t.catalog, t.enriched)
    longer = made.withColumn("favorite_genres", F.concat("favorite_genres", F.slice("favorite_genres", 1, 1)))
    return validated(validate.validate_profiles(longer), "user_id")


def cache_union_new(t: Tables) -> DataFrame:
    pool = enrichment.eligible_pool(t.catalog)
    fresh = rules(t, enrichment.uncached(pool, t.enriched))
    return themes_text(enrichment.merge_cached(pool, full_enriched(t), fresh))


def enrich_incremental(t: Tables) -> DataFrame:
    """The stored enrichment is the cache; the whole eligible pool is requested."""
    path = new_run_dir(t.spark, "enriched")
    append_enriched(full_enriched(t), path)
    return themes_text(enrichment.enrich_incremental(enrichment.eligible_pool(t.catalog), path, lambda pool: rules(t, pool)))


def batch_inference(t: Tables) -> DataFrame:
    asked = prompts.enrichment_prompts(enrichment.rated_pool(t.catalog, t.ratings))
    return themes_text(inference.run_inference(asked, title_scorer(), ENRICHED_FIELDS, "title-length")).withColumn(
        "attempts", F.col("attempts").cast("long"))


def model_predictions(t: Tables) -> DataFrame:
    made = models.predict_with_scorer(customer_requests(t), t.ratings, t.catalog, t.enriched, line_scorer(), "lines")
    return made.withColumn("based_on_n_user_ratings", F.col("based_on_n_user_ratings").cast("long"))


def model_profiles(t: Tables) -> DataFrame:
    made = models.profiles_with_scorer(t.ratings, t.catalog, t.enriched, line_scorer(), "lines")
    return made.select("user_id", "n_ratings", "mean_rating", "status", F.array_join("favorite_genres", ",").alias("favorite_genres"), "typical_sentiment", "summary")


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    # scans, sources, sinks
    "scan_catalog": scan_catalog_query,
    "scan_ratings": lambda t: day(scan_ratings(t.spark, t.stored("ratings"))),
    "scan_enriched": lambda t: themes_text(t.enriched),
    "format_records": lambda t: format_records(search.candidates(t.catalog, t.enriched), keep=("movie_id",)),
    "parse_filter_specs": parse_filter_specs_query,
    # scalar functions
    "parse_genres": parse_genres,
    "primary_genre": lambda t: t.catalog.select("movie_id", primary_name(parse_names(F.col("genres"))).alias("primary_genre"),
                                                first_three(parse_names(F.col("genres"))).alias("first_genres")),
    "release_year": lambda t: t.catalog.select("movie_id", release_year(F.col("release_date")).alias("release_year")),
    "predicate_year": lambda t: t.catalog.select("movie_id", filter_year(F.col("release_date")).alias("filter_year")),
    "roi": lambda t: t.catalog.select("movie_id", F.round(roi(F.col("revenue"), F.col("budget")), 6).alias("roi")),
    "render_prompts": render_prompts,
    "history_lines": history_lines,
    "clean_responses": lambda t: inference.clean_answers(model_responses(t)).select("doc_id", "answer"),
    "render_prediction_prompts": render_prediction_prompts,
    "render_profile_prompts": render_profile_prompts,
    "prediction_delta": prediction_delta,
    "dry_run_table": lambda t: evaluation.dry_run_table(full_enriched(t)),
    # filters and validation
    "filter_status": search_rows(),
    "filter_year_range": search_rows(min_year=1990, max_year=1999),
    "filter_budget_range": search_rows(min_budget=100_000, max_budget=300_000),
    "filter_runtime_range": search_rows(min_runtime=10, max_runtime=40),
    "eligible_pool": eligible_pool,
    "filter_genres": search_rows(genres=["promo", "Brand#7"]),
    "filter_tiers": search_rows(budget_tier="low", revenue_tier="high"),
    "filter_sentiment": search_rows(sentiment="positive"),
    "filter_min_score": search_rows(min_score=6),
    "ids_semi_join": lambda t: filters.only_ids(t.catalog.select("movie_id", "title", "budget"), t.enriched),
    "validate_filters": lambda t: validated(validate.validate_filters(typed_filters(t)), "spec_id"),
    "validate_enriched": lambda t: validated(validate.validate_enriched(damaged_enrichment(t)), "movie_id"),
    "validate_predictions": validate_predictions,
    "validate_profiles": validate_profiles,
    # joins
    "movies_with_ratings": movies_with_ratings,
    "rated_titles": lambda t: day(rated.rated_titles(t.ratings, t.catalog, "title")),
    "candidates_enriched": search_rows(genres=["economy"]),
    "enriched_lookup": lambda t: themes_text(lookup.lookup_enriched(t.read("orders").select(F.col("o_orderkey").alias("movie_id")), t.enriched)),
    "uncached_requests": lambda t: enrichment.uncached(enrichment.eligible_pool(t.catalog), t.enriched).select("movie_id", "title"),
    "eval_candidates": lambda t: day(evaluation.eval_candidates(t.ratings, t.catalog, t.enriched)),
    "run_drift": lambda t: evaluation.run_drift(*run_pair(t)),
    "drift_rows": lambda t: evaluation.drift_rows(*run_pair(t)),
    # aggregations
    "movie_rating_stats": movie_rating_stats,
    "row_counts": lambda t: report.row_counts(t.catalog, t.ratings),
    "eligible_share": lambda t: report.eligible_share(t.catalog),
    "missing_rates": lambda t: rounded(report.missing_rates(t.catalog)),
    "genre_distribution": lambda t: rounded(report.distribution(enrichment.eligible_pool(t.catalog), "primary_genre")),
    "ratings_per_key": ratings_per_key,
    "describe_counts": describe_counts,
    "rating_histogram": lambda t: report.histogram(t.ratings, "rating", 10),
    "clipped_histogram": clipped_histogram,
    "attribute_counts": lambda t: report.value_counts(t.enriched, ("overview_sentiment", "budget_tier", "revenue_tier")),
    "score_describe": score_describe,
    "top_themes": lambda t: report.most_common(t.enriched, "themes", 15, "theme"),
    "user_stats": lambda t: rated.user_stats(t.ratings),
    "cost_report": cost_report,
    "prediction_hits": lambda t: evaluation.prediction_hits(prediction_delta(t)),
    "stratum_allocation": stratum_allocation,
    "active_users": lambda t: rated.active_users(t.ratings),
    "unique_titles": lambda t: rated.unique_titles(t.catalog.withColumn("title", F.concat_ws(" ", "title", "runtime"))),
    "title_ids": lambda t: lookup.find_titles(asked_titles(t), t.catalog),
    # windows, ranking, sampling
    "leak_free_history": lambda t: day(history.history_rows(history.pair_histories(pair_requests(t), t.ratings, t.catalog))),
    "top_bottom_rated": lambda t: day(profiles.top_and_bottom(t.ratings, t.catalog)),
    "stratified_sample": stratified_sample,
    "small_sample": small_sample,
    "first_per_movie": first_per_movie,
    "eval_pairs": lambda t: day(evaluation.eval_pairs(evaluation.eval_candidates(t.ratings, t.catalog, t.enriched))),
    # sort, limit, top-k
    "top_movies": best_rows(sort_by="score_desc", limit=50),
    "first_movies": best_rows(limit=50),
    "top_rated": lambda t: rounded(rated.top_rated(t.catalog.select("movie_id", "title"), t.ratings, 5)),
    # set operations
    "cache_union_new": cache_union_new,
    "compare_notes": compare_notes,
    # composite operators
    "query_movies_nineties": best_rows(genres=["PROMO"], min_year=1990, max_year=1999, sort_by="revenue_desc"),
    "query_movies_positive": best_rows(genres=["Economy"], revenue_tier="high", sentiment="positive", limit=50),
    "query_movies_small_budget": best_rows(genres=["standard"], budget_tier="low", sort_by="revenue_desc"),
    "query_movies_score": best_rows(min_score=8, max_budget=300_000, sort_by="score_desc"),
    "query_movies_batch": query_movies_batch,
    "compare_movies": compare_movies,
    "predict_ratings": predict_ratings,
    "user_profiles": user_profiles,
    "enrich_incremental": enrich_incremental,
    "batch_inference": batch_inference,
    "prediction_eval": prediction_eval,
    "rating_baseline": rating_baseline,
    "tier_breaks": lambda t: breaks.tier_breaks(enrichment.eligible_pool(t.catalog), "primary_genre", ["budget", "revenue"]),
    "natural_tiers": lambda t: breaks.tiers_by_breaks(enrichment.eligible_pool(t.catalog), "movie_id", "primary_genre", ["budget", "revenue"]),
    "similar_titles": lambda t: similar_titles(t),
    "similar_titles_exact": lambda t: similar_titles(t, 1 << 30),
    "lexicon_sentiment": lambda t: sentiments_from_lexicon(enrichment.eligible_pool(t.catalog), label_lexicon(t)),
    "model_predictions": model_predictions,
    "model_profiles": model_profiles,
}


def bind(query: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(tables(spark, sf_dir))
