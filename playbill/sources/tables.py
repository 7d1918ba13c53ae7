"""Scans of the three tables, each with an explicit column list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from playbill.contracts import CATALOG_COLUMNS, ENRICHED_COLUMNS, ENRICHED_SCHEMA, EXTRA_CATALOG_COLUMNS, RATING_COLUMNS
from playbill.functions.dates import filter_year, release_year
from playbill.functions.names import name_keys, parse_names, primary_name
from playbill.session import configure
from playbill.sources.keys import assert_unique, duplicate_keys  # noqa: F401
from playbill.sources.versions import VersionedTable


def scan_catalog(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The named columns; by default those of the contract, and the optional ones that the table has."""
    rows = spark.read.parquet(path)
    return rows.select(*(columns or (*CATALOG_COLUMNS, *(c for c in EXTRA_CATALOG_COLUMNS if c in rows.columns))))


def scan_ratings(spark: SparkSession, path: str, columns: Sequence[str] = RATING_COLUMNS) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def scan_enriched(spark: SparkSession, path: str, columns: Sequence[str] = ENRICHED_COLUMNS) -> DataFrame:
    """The newest version, or the files of a plain table. The title is left out by default: the catalog owns it, and a join must not see it twice."""
    table = enriched_table(spark, path)
    rows = table.read() if table.exists() else spark.read.schema(ENRICHED_SCHEMA).parquet(path)
    return rows.select(*columns)


def enriched_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, ENRICHED_SCHEMA, "movie_id")


def prepare_catalog(catalog: DataFrame) -> DataFrame:
    """Add the parsed columns the operators filter and group on. Store the result once: filters on
    these columns then reach the parquet scan, which functions of text never do, and whether there is an
    overview is known without reading the texts."""
    configure(catalog.sparkSession)
    derived = {
        "genre_names": lambda: parse_names(F.col("genres")),
        "genre_keys": lambda: name_keys(F.col("genre_names")),
        "primary_genre": lambda: primary_name(F.col("genre_names")),
        "release_year": lambda: release_year(F.col("release_date")),
        "filter_year": lambda: filter_year(F.col("release_date")),
        "has_overview": lambda: F.col("overview").isNotNull() & (F.col("overview") != ""),
    }
    for name, make in derived.items():
        if name not in catalog.columns:
            catalog = catalog.withColumn(name, make())
    return catalog
