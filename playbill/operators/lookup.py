"""Lookups of enriched rows and side-by-side comparisons, for tables of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from playbill.contracts import ENRICHED_COLUMNS, RESULT_COLUMNS
from playbill.functions.text import strip
from playbill.operators.search import with_enrichment
from playbill.sources.tables import prepare_catalog

#: About so many requests for a title meet about so many rows of the catalog with it at a time.
ASKED, KNOWN = 256, 4096


def lookup_enriched(requests: DataFrame, enriched: DataFrame) -> DataFrame:
    """Enriched columns for each requested ``movie_id``, or an ``error`` where there are none."""
    found = enriched.select(*ENRICHED_COLUMNS).withColumn("_found", F.lit(True))
    missing = F.concat(F.lit("movie "), F.col("movie_id").cast("string"), F.lit(" is not enriched"))
    return (
        requests.join(found, "movie_id", "left")
        .withColumn("error", F.when(F.col("_found").isNull(), missing))
        .drop("_found")
    )


def find_titles(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog ids for each requested ``title``, compared in lower case without outer spaces; null where there is none.

    A title that many rows ask for and many have is a row for each pair. Its requests and its rows are cut into parts by hash, and each two parts
    are a cell that any task may take: no task gets a title whole, and it holds the requests of one cell only (equal requests share theirs). A row of
    the catalog meets the requests of a cell one after the other, so written results are runs of one id beside a short list that recurs."""
    key = lambda title: F.lower(strip(title))
    count = lambda rows, size, name: rows.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    one_of = lambda value, parts: F.when(F.col(parts) > 1, F.pmod(F.xxhash64(value), parts)).otherwise(0).cast("int")
    each_of = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    asked = requests.withColumn("_key", key(F.col("title")))
    known = catalog.select("movie_id", F.col("title").alias("catalog_title"), key(F.col("title")).alias("_key"))
    parts = count(known, KNOWN, "_known").join(count(asked, ASKED, "_asked"), "_key")
    met = asked.join(parts, "_key", "left")
    cell = F.concat_ws(":", "_request_part", "_movie_part", "_key").alias("_cell")  # one column, which is no constant even where the title is
    tasks = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: few bytes may be many pairs
    wanted = (
        met.filter(F.col("_known").isNotNull())
        .withColumn("_request_part", one_of(F.to_json(F.struct(*requests.columns)), "_asked")).withColumn("_movie_part", each_of("_known"))
        .select(cell, *requests.columns).repartition(tasks, "_cell")
    )
    held = (
        known.join(parts, "_key")
        .withColumn("_movie_part", one_of(F.col("movie_id"), "_known")).withColumn("_request_part", each_of("_asked"))
        .select(cell, "movie_id", "catalog_title").repartition(tasks, "_cell")
    )
    found = held.join(wanted.hint("merge"), "_cell").select(*requests.columns, "movie_id", "catalog_title")
    return found.unionByName(met.filter(F.col("_known").isNull()).select(*requests.columns), allowMissingColumns=True)


def compare_rows(requests: DataFrame, catalog: DataFrame, enriched: DataFrame) -> DataFrame:
    """Long form of ``compare``: one row per requested id, with ``position``, ``in_catalog`` and ``is_enriched``."""
    return _compared(requests.select("request_id", F.posexplode("movie_ids").alias("position", "movie_id")), catalog, enriched).select(
        "request_id", "position", "in_catalog", "is_enriched", *RESULT_COLUMNS)


def _compared(asked: DataFrame, catalog: DataFrame, enriched: DataFrame) -> DataFrame:
    """Requested ids with the facts of the catalog and the enrichment table."""
    facts = (
        prepare_catalog(catalog)
        .select("movie_id", "title", "release_year", "budget", "revenue", "runtime")
        .withColumn("in_catalog", F.lit(True))
    )
    return (
        with_enrichment(asked.join(facts, "movie_id", "left"), enriched)
        .withColumn("in_catalog", F.coalesce("in_catalog", F.lit(False)))
        .withColumn("is_enriched", F.col("overview_sentiment").isNotNull())
        .withColumn("themes", F.coalesce("themes", F.array().cast("array<string>")))
    )


def _ids(rows, condition):
    chosen = F.transform(F.filter(rows, condition), lambda r: r["movie_id"].cast("string"))
    return F.concat(F.lit("["), F.array_join(chosen, ", "), F.lit("]"))


def compare(requests: DataFrame, catalog: DataFrame, enriched: DataFrame) -> DataFrame:
    """Comparison table per request ``(request_id, movie_ids)``: rows in request order, repeats kept.
    Ids not in the catalog are named in the note; otherwise those not enriched are. Fewer than two
    ids is an error. A group is one request's own id list, so it stays as small as its input row."""
    few = F.when(F.coalesce(F.size("movie_ids"), F.lit(0)) < 2, F.lit("at least two ids are needed"))
    listed = requests.select("request_id", few.alias("error"), F.when(few.isNull(), F.col("movie_ids")).alias("movie_ids"))
    asked = listed.select("request_id", "error", F.posexplode_outer("movie_ids").alias("position", "movie_id"))
    entry = F.when(F.col("position").isNotNull(), F.struct("position", "in_catalog", "is_enriched", *RESULT_COLUMNS))
    rows = _compared(asked, catalog, enriched).groupBy("request_id").agg(F.max("error").alias("error"), F.array_sort(F.collect_list(entry)).alias("rows"))
    fine = F.col("error").isNull()
    movies = F.transform(F.filter("rows", lambda r: r["in_catalog"]), lambda r: F.struct(*[r[c].alias(c) for c in RESULT_COLUMNS]))
    note = (
        F.when(F.exists("rows", lambda r: ~r["in_catalog"]), F.concat(F.lit("not found: "), _ids("rows", lambda r: ~r["in_catalog"])))
        .when(F.exists("rows", lambda r: r["in_catalog"] & ~r["is_enriched"]), F.concat(F.lit("not enriched: "), _ids("rows", lambda r: r["in_catalog"] & ~r["is_enriched"])))
    )
    return rows.select("request_id", "error", F.when(fine, movies).alias("movies"), F.when(fine, note).alias("note"))
