"""Enrichment of a catalog: the eligible pool, cached and new rows, and the enrichment table."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import suppress

from pyspark.sql import DataFrame

from playbill.contracts import ENRICHED_FIELDS, ENRICHED_SCHEMA
from playbill.operators.filters import is_eligible
from playbill.operators.inference import Scorer, run_inference
from playbill.operators.ratings import with_rating_stats
from playbill.operators.sampling import stratified_sample
from playbill.operators.validate import validate_enriched
from playbill.plans.prompts import enrichment_prompts
from playbill.session import written
from playbill.sources.tables import enriched_table, prepare_catalog
from playbill.sources.versions import StaleVersion

_ALL = [f.name for f in ENRICHED_SCHEMA]


def eligible_pool(catalog: DataFrame) -> DataFrame:
    return prepare_catalog(catalog).filter(is_eligible())


def rated_pool(catalog: DataFrame, ratings: DataFrame) -> DataFrame:
    """The eligible pool with mean rating and count."""
    return with_rating_stats(eligible_pool(catalog), ratings)


def sampled_pool(catalog: DataFrame, ratings: DataFrame, n: int, seed: int) -> DataFrame:
    """A stratified sample of the eligible pool with rating statistics: drawn first, so that only ratings of drawn rows are met."""
    drawn = stratified_sample(eligible_pool(catalog), n, seed)
    return with_rating_stats(drawn, ratings.join(drawn.select("movie_id"), "movie_id", "left_semi"))


def uncached(requested: DataFrame, cached: DataFrame) -> DataFrame:
    """Requested rows without a cached one; an id that is requested twice counts once."""
    return requested.join(cached.select("movie_id"), "movie_id", "left_anti").dropDuplicates(["movie_id"])


def merge_cached(requested: DataFrame, cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Enriched rows of the request: cached rows first, valid new rows for the rest."""
    kept = cached.select(*_ALL).join(requested.select("movie_id"), "movie_id", "left_semi")
    new = validate_enriched(fresh).filter("valid").select(*_ALL)
    return kept.unionByName(new)


def scorer_enrichment(scorer: Scorer, model: str, retries: int = 2, run_dir: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """An ``enrich`` step for ``enrich_incremental`` that asks a model about each row of a rated pool."""
    def enrich(pool: DataFrame) -> DataFrame:
        answers = run_inference(enrichment_prompts(pool), scorer, ENRICHED_FIELDS, model, retries, run_dir=run_dir)
        return answers.filter("status = 'ok'").join(pool.select("movie_id", "title"), "movie_id").select(*_ALL)

    return enrich


#: Appends that lookups meet one by one before they are moved into a new base, and rows of a bucket of the base.
MOST_APPENDS, ROWS_PER_BUCKET = 16, 1_000_000


def enrich_incremental(requested: DataFrame, path: str, enrich: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Enrich the requested rows that the table at ``path`` lacks, append the valid ones as its next version, and return
    the requested part of the table. Rows not requested stay; rows that failed are simply not
    there and are tried again next time. If another writer publishes meanwhile, this one's rows are compared with the new
    version and those still missing are appended to it, so nothing is enriched or stored twice."""
    table = enriched_table(requested.sparkSession, path)
    at = table.manifest()
    fresh = written(validate_enriched(enrich(table.missing(requested, at).dropDuplicates(["movie_id"]))).filter("valid").select(*_ALL), "enriched")
    while True:
        try:
            at = table.append(table.missing(fresh, at), at)
            break
        except StaleVersion:
            at = table.manifest()
    if len(at.appends) > MOST_APPENDS:
        rows = table.read(at).count()
        with suppress(StaleVersion):  # whoever publishes first decides; the next one compacts
            at = table.compact(at.buckets or 1 + rows // ROWS_PER_BUCKET, at)
    return table.found(requested, at).select(*_ALL)
