"""The generic test tables seen as a catalog, its ratings and an enrichment table.

The three tables are written once per application and sf folder, as the real ones would be, so that
every query scans stored columns and its filters reach the parquet reader. Each is written when it is first read: a query
pays for the tables it reads, not for the others."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from playbill.operators.ratings import movie_rating_stats
from playbill.operators.rules import enrich_by_rules
from playbill.operators.validate import validate_enriched
from playbill.plans.enrichment import eligible_pool
from playbill.session import configure, new_run_dir
from playbill.sources.layout import along_curve
from playbill.sources.sinks import append_enriched
from playbill.sources.tables import prepare_catalog, scan_enriched

_paths: dict[tuple[str, str], str] = {}
_stored: set[str] = set()


class Tables:
    def __init__(self, spark: SparkSession, source: str, path: str):
        self.spark, self.source, self.path = spark, source, path

    def read(self, name: str) -> DataFrame:
        """One of the given tables."""
        return self.spark.read.parquet(f"{self.source}/{name}.parquet")

    def stored(self, name: str) -> str:
        """Folder of the catalog, the ratings or the enrichment table, which is written first if need be."""
        path = f"{self.path}/{name}"
        if path not in _stored:
            _WRITERS[name](self, path)
            _stored.add(path)
        return path

    @cached_property
    def catalog(self) -> DataFrame:
        return self.spark.read.parquet(self.stored("catalog"))

    @cached_property
    def ratings(self) -> DataFrame:
        return self.spark.read.parquet(self.stored("ratings"))

    @cached_property
    def enriched(self) -> DataFrame:
        return scan_enriched(self.spark, self.stored("enriched"))


def map_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    key = F.col("p_partkey")
    revenue = read("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.sum(F.round("l_extendedprice").cast("long")).alias("sold"))
    texts = read("documents").select(F.col("doc_id").alias("p_partkey"), F.col("text").alias("overview"), F.col("lang").alias("language"))
    genres = (
        F.when(key % 50 == 1, "[]").when(key % 50 == 2, "")
        .when(key % 10 == 3, F.concat("p_type", F.lit("|"), "p_brand"))
        .when(key % 10 == 4, F.col("p_type"))
        .otherwise(F.concat(F.lit('[{"id": 1, "name": "'), "p_type", F.lit('"}, {"id": 2, "name": "'), "p_brand", F.lit('"}]')))
    )
    date = (
        F.when(key % 40 == 5, "").when(key % 40 == 6, "unknown")
        .otherwise(F.concat((key % 37 + 1980).cast("string"), F.lit("-0"), (key % 9 + 1).cast("string"), F.lit("-15")))
    )
    return (
        read("part").join(texts, "p_partkey", "left").join(revenue, "p_partkey", "left")
        .select(
            key.alias("movie_id"), F.col("p_name").alias("title"), "overview",
            F.when(key % 7 == 0, F.lit(0).cast("long")).otherwise(F.round("p_retailprice").cast("long") * F.col("p_size") * 10).alias("budget"),
            F.when(key % 11 == 0, F.lit(0).cast("long")).otherwise(F.coalesce("sold", F.lit(0).cast("long"))).alias("revenue"),
            F.col("p_size").alias("runtime"), "language", genres.alias("genres"), date.alias("release_date"),
            F.when(key % 20 == 0, "Rumored").otherwise("Released").alias("status"),
        )
    )


def map_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("movie_id"),
        (F.ceil(F.col("l_quantity") / 5.0) * 0.5).alias("rating"), F.col("l_shipdate").alias("ts"))


def label_sentiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentiment = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("movie_id"), sentiment.alias("overview_sentiment"))


def rules(tables: Tables, pool: DataFrame, **options) -> DataFrame:
    """Rule enrichment of ``pool`` against the norms of the whole eligible pool."""
    return enrich_by_rules(
        pool, movie_rating_stats(tables.ratings), label_sentiments(pool.sparkSession, tables.source), eligible_pool(tables.catalog), **options)


def _write_catalog(t: Tables, path: str) -> None:
    """The axes of the curve are read without the texts; those are written once."""
    along_curve(prepare_catalog(map_catalog(t.spark, t.source)), int(t.spark.conf.get("spark.sql.shuffle.partitions"))).write.parquet(path)


def _write_ratings(t: Tables, path: str) -> None:
    map_ratings(t.spark, t.source).write.parquet(path)


def _write_enriched(t: Tables, path: str) -> None:
    labelled = eligible_pool(t.catalog).join(label_sentiments(t.spark, t.source).select("movie_id"), "movie_id", "left_semi")
    append_enriched(validate_enriched(rules(t, labelled)).filter("valid"), path)


_WRITERS = {"catalog": _write_catalog, "ratings": _write_ratings, "enriched": _write_enriched}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    configure(spark)
    sf_dir = sf_dir.rstrip("/")
    memo = (spark.sparkContext.applicationId, sf_dir)
    if memo not in _paths:
        _paths[memo] = new_run_dir(spark, "tables")
    return Tables(spark, sf_dir, _paths[memo])
