"""What the plans must and must not contain, with broadcasts by size turned off as for large tables."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from playbill.operators import history, predict, profiles, sampling
from playbill.plans import enrichment
from workload.queries import QUERIES, bind
from workload.tables import _WRITERS, tables

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")


@pytest.fixture(scope="module")
def large(spark):
    """Plan as if no table were small."""
    t = tables(spark, SF_DIR)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield t
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUERIES)
def test_no_cross_joins(spark, large, name):
    text = plan(bind(QUERIES[name])(spark, SF_DIR))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    if not re.search("sample|prediction_eval", name):
        assert "BroadcastExchange" not in text


def test_queries_write_only_the_tables_they_read(spark, monkeypatch):
    """Counts of ratings need neither catalog nor enrichment, a distribution of the catalog no ratings; similar vectors none of them. Texts are written once."""
    written = []
    monkeypatch.setattr("workload.tables._paths", {})
    monkeypatch.setattr("workload.tables._stored", set())
    monkeypatch.setattr("workload.tables._WRITERS", {name: lambda t, path, name=name, write=write: (written.append(name), write(t, path)) for name, write in _WRITERS.items()})
    tables(spark, SF_DIR).read("embeddings")
    assert written == []
    bind(QUERIES["active_users"])(spark, SF_DIR)
    assert written == ["ratings"]
    bind(QUERIES["genre_distribution"])(spark, SF_DIR)
    bind(QUERIES["title_ids"])(spark, SF_DIR)
    assert written == ["ratings", "catalog"]
    bind(QUERIES["enriched_lookup"])(spark, SF_DIR)
    bind(QUERIES["query_movies_score"])(spark, SF_DIR)
    assert written == ["ratings", "catalog", "enriched"]


def test_rankings_are_cut_before_the_shuffle(large):
    text = plan(history.newest_per_user(large.ratings, large.catalog))
    assert len(re.findall(r"WindowGroupLimit .*Partial", text)) == 2
    text = plan(profiles.top_and_bottom(large.ratings, large.catalog))
    assert {re.search(r"row_number\(\), (\d+), Partial", line).group(1) for line in text.splitlines() if "Partial" in line and "WindowGroupLimit" in line} == {"13", "5"}


def test_draws_order_only_the_cells_they_take(large):
    """Pool rows meet the few cells up to the cut before any shuffle, and rows are numbered inside a cell."""
    text = plan(sampling.stratified_sample(enrichment.eligible_pool(large.catalog), 75, 42))
    assert re.search(r"Window \[row_number\(\) windowspecdefinition\(primary_genre#\d+, cell#\d+, _h#", text)
    numbered = text[text.index("row_number()"):]
    assert numbered.index("Exchange") < numbered.index("BroadcastHashJoin") < numbered.index("BroadcastExchange")
    wide = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("_h#" in line or "movie_id#" in line for line in wide) == 0


def test_eligibility_reads_no_text(large):
    text = plan(enrichment.eligible_pool(large.catalog).agg(F.count(F.lit(1))))
    assert "overview:string" not in text and "EqualTo(has_overview,true)" in text


def test_pairs_do_not_multiply_history(large):
    """One row per user meets the requests; nothing is exploded."""
    text = plan(predict.predict_ratings(large.ratings.select("user_id", "movie_id"), large.ratings, large.catalog))
    assert "Generate" not in text
