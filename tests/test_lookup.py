"""Titles that many ask for and many have: results, and how the pairs are dealt out and written."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import frames
from playbill.operators.lookup import find_titles


@pytest.fixture
def large(spark):
    """Plan as if no table were small."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def hot(spark, asked, known, constant=False):
    """``asked`` requests for one title that ``known`` movies have; with ``constant`` the plan knows that it is one."""
    title = lambda text: F.lit(text) if constant else F.when(F.col("id") >= 0, text)
    requests = spark.range(asked).select(F.col("id").alias("request_id"), title(" HOT ").alias("title"))
    return find_titles(requests, spark.range(known).select(F.col("id").alias("movie_id"), title("Hot").alias("title")))


def test_every_pair_once(spark):
    """Several parts of requests and of movies; equal requests, null and blank titles, titles that nobody has or nobody asks for."""
    titles = ["Hot"] * 9000 + ["warm "] * 300 + ["", None, "Cold", "Two", "two"]
    asked = [" HOT"] * 600 + ["Warm"] * 300 + ["none"] * 300 + [None, None, "  ", "TWO"]
    movies = frames.catalog(spark, [frames.movie(k, "x")[:1] + (title,) + frames.movie(k)[2:] for k, title in enumerate(titles)])
    requests = spark.createDataFrame([(k // 2, title) for k, title in enumerate(asked)], "request_id bigint, title string")
    found = find_titles(requests, movies)
    assert found.columns == ["request_id", "title", "movie_id", "catalog_title"]
    key = lambda title: None if title is None else title.strip().lower()
    having: dict = {}
    for k, title in enumerate(titles):
        having.setdefault(key(title), []).append((k, title))
    pairs = Counter((k // 2, title) for k, title in enumerate(asked))
    counted = {(r[0], r[1], r[2]): r[3] for r in found.groupBy("request_id", "title", "catalog_title").agg(F.count(F.lit(1))).collect()}
    wanted: Counter = Counter()
    for (request, title), times in pairs.items():
        for _, name in (having.get(key(title), []) if title is not None else []) or [(None, None)]:
            wanted[request, title, name] += times
    assert counted == wanted
    each = found.filter("movie_id IS NOT NULL").groupBy("movie_id").agg(F.count(F.lit(1)).alias("n"))
    assert {(r["movie_id"], r["n"]) for r in each.collect()} == {
        (k, n) for k, title in enumerate(titles) if (n := sum(key(a) == key(title) for a in asked if a is not None and title is not None))}


@pytest.mark.parametrize("asked, known, constant", [(999, 6001, False), (6001, 999, False), (999, 6001, True)])
def test_a_common_title_is_dealt_to_several_tasks(spark, large, asked, known, constant):
    """Few bytes are many pairs, on either side."""
    dealt = [r["count"] for r in hot(spark, asked, known, constant).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(dealt) == asked * known and max(dealt) < 0.75 * sum(dealt)


def test_pairs_are_written_in_runs(spark, tmp_path):
    """A third of a byte a pair at most, where ids one by one take several."""
    hot(spark, 999, 6001).write.parquet(str(tmp_path / "pairs"))
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 999 * 6001 / 3
