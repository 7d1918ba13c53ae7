from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from frames import catalog, enriched, movie, rich
from playbill.contracts import SORT_COLUMNS
from playbill.operators import intervals
from playbill.operators.lookup import compare, lookup_enriched
from playbill.operators.search import _placed, best_of_nodes, candidates, looked_through, refused_requests, search, search_batch
from playbill.sources.sinks import format_records
from playbill.sources.specs import parse_filter_specs
from playbill.sources.tables import prepare_catalog


@pytest.fixture(scope="module")
def tables(spark):
    movies = [
        movie(1, budget=0, release_date="1990-01-01", genres="Drama|Crime"),
        movie(2, budget=50, revenue=900, release_date="1999-12-31", genres="drama"),
        movie(3, budget=70, revenue=900, runtime=120, release_date="2001-01-01"),
        movie(4, release_date="unknown", genres='[{"name": "Comedy"}]'),
        movie(5, status="Rumored"),
        movie(6, release_date="", genres=""),
    ]
    return catalog(spark, movies), enriched(spark, [rich(1, score=3), rich(2, "negative", score=9), rich(5)])


def ids(frame):
    return [r.movie_id for r in frame.collect()]


def test_titles_survive_and_only_released(tables):
    rows = search(*tables, limit=3).collect()
    assert [(r.movie_id, r.title) for r in rows] == [(1, "T1"), (2, "T2"), (3, "T3")]
    assert ids(search(*tables, limit=50)) == [1, 2, 3, 4, 6]


def test_genres_ignore_case_and_wildcards(tables):
    assert ids(search(*tables, genres=["DRAMA"])) == ids(search(*tables, genres=["drama"])) == [1, 2, 3]
    assert ids(search(*tables, genres=["%"])) == [] == ids(search(*tables, genres=["Dram"]))
    assert ids(search(*tables, genres=["crime", "comedy"])) == [1, 4]


def test_ranges(tables):
    assert ids(search(*tables, min_year=1990, max_year=1999)) == [1, 2]
    assert ids(search(*tables, max_year=1999)) == [1, 2, 4, 6]  # an unreadable year counts as 0
    assert ids(search(*tables, max_budget=60)) == [1, 2]  # an unknown budget is 0
    assert ids(search(*tables, min_runtime=100)) == [3]


def test_enriched_filters(tables):
    assert ids(search(*tables, sentiment="positive")) == [1]
    assert ids(search(*tables, min_score=5)) == [2]
    assert ids(search(*tables, budget_tier="low", revenue_tier="high")) == [1, 2]


def test_sorting(tables):
    assert ids(search(*tables, sort_by="revenue_desc", limit=3)) == [2, 3, 1]
    assert ids(search(*tables, sort_by="score_desc")) == [2, 1, 3, 4, 6] == ids(search(*tables, sort_by="rating_desc"))
    assert ids(search(*tables, sort_by="runtime_desc", limit=1)) == [3]


def test_few_winners_are_joined(tables):
    plan = search(*tables, sort_by="revenue_desc")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("GlobalLimit")  # printed from the top: the limit is below the join


def test_records_keep_nulls_and_order(tables):
    record = format_records(candidates(*tables), ("movie_id", "absent", "title", "themes"), keep=("movie_id",)).filter("movie_id = 4").first().record
    assert record == '{"movie_id":4,"title":"T4","themes":null}'


def test_filters_reach_the_scan(spark, tables, tmp_path):
    prepare_catalog(tables[0]).write.parquet(f"{tmp_path}/c")
    plan = search(spark.read.parquet(f"{tmp_path}/c"), tables[1], min_year=1990, min_budget=5)._jdf.queryExecution().toString()
    for pushed in ("EqualTo(status,Released)", "GreaterThanOrEqual(filter_year,1990)", "GreaterThanOrEqual(budget,5)"):
        assert pushed in plan
    assert "overview:string" not in plan.split("ReadSchema")[1]


def brute(movies, rich_rows, spec):
    best = []
    for m in movies:
        e = rich_rows.get(m["movie_id"], {})
        if m["status"] != "Released":
            continue
        keys = set(m["genre_keys"])
        if spec["genres"] and not keys & {g.lower() for g in spec["genres"]}:
            continue
        pairs = [("min_year", m["filter_year"], 1), ("max_year", m["filter_year"], -1), ("min_budget", m["budget"], 1), ("max_budget", m["budget"], -1),
                 ("min_runtime", m["runtime"], 1), ("max_runtime", m["runtime"], -1), ("min_score", e.get("production_effectiveness_score"), 1)]
        if any(spec[n] is not None and (v is None or (v - spec[n]) * sign < 0) for n, v, sign in pairs):
            continue
        if any(spec[n] is not None and e.get(c) != spec[n] for n, c in (("budget_tier", "budget_tier"), ("revenue_tier", "revenue_tier"), ("sentiment", "overview_sentiment"))):
            continue
        column = SORT_COLUMNS.get(spec["sort_by"])
        value = (m.get(column, e.get(column)) if column in m else e.get(column)) if column else None
        best.append((value is None, -(value or 0), m["movie_id"]))
    return [b[2] for b in sorted(best)[: spec["limit"]]]


def test_batch_equals_brute_force_and_single_search(spark):
    rng = random.Random(5)
    names = ["Drama", "Crime", "Comedy", "War"]
    movies = [movie(i, budget=rng.choice([0, 10, 20, 30]), revenue=rng.randrange(5), runtime=rng.randrange(60, 65),
                    genres="|".join(rng.sample(names, rng.randrange(0, 4))) or None, release_date=rng.choice(["1990-1", "1995-1", "x", None]),
                    status=rng.choice(["Released", "Released", "Rumored"])) for i in range(120)]
    c = prepare_catalog(catalog(spark, movies)).cache()
    e = enriched(spark, [rich(i, rng.choice(["positive", "neutral"]), rng.choice(["low", "high"]), score=rng.randrange(1, 11)) for i in range(0, 120, 2)])
    kinds = {"genres": lambda: rng.sample(["drama", "WAR", "crime", "none", "Drama"], 3), "min_year": lambda: rng.choice([1985, 1991]),
             "max_year": lambda: rng.choice([1990, 2300]), "min_budget": lambda: 10, "max_budget": lambda: 20, "min_runtime": lambda: 61,
             "max_runtime": lambda: 63, "budget_tier": lambda: "low", "sentiment": lambda: "positive", "min_score": lambda: 4,
             "sort_by": lambda: rng.choice(list(SORT_COLUMNS)), "limit": lambda: rng.choice([1, 3, 50])}
    specs = [{k: make() for k, make in kinds.items() if rng.random() < 0.3} for _ in range(60)] + [{}, {"min_year": 1999, "max_year": 1990}, {"min_year": -5, "max_year": 5000},
        {"min_year": -9000000000000000000, "max_year": 9000000000000000000}, {"max_year": 1990}, {"min_year": 1991}]
    specs += [{"sort_by": k, "limit": 50, **b} for k in (None, *SORT_COLUMNS) for b in ({"min_budget": 10}, {"max_budget": 19, "min_runtime": 61}, {"min_runtime": 62, "max_runtime": 62}, {"max_year": 0}, {"min_budget": 21, "max_budget": 9}, {})]
    frame = parse_filter_specs(spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate(specs)], "spec_id int, filter_json string"))
    got = {}
    for r in search_batch(c, e, frame, salts=3).orderBy("spec_id", "rank").collect():
        got.setdefault(r.spec_id, []).append(r.movie_id)
    facts, rich_rows = [r.asDict() for r in c.collect()], {r.movie_id: r.asDict() for r in e.collect()}
    for row in frame.collect():
        assert got.get(row.spec_id, []) == brute(facts, rich_rows, row.asDict()), row
    for i in range(0, 60, 15):
        assert got.get(i, []) == ids(search(c, e, **specs[i]))


def test_comparison(spark, tables):
    asked = [("two", [1, 3]), ("same", [1, 1]), ("one", [1]), ("unknown", [1, 99, 98]), ("plain", [3, 1, 4]), ("both", [3, 99]), ("none", None), ("hidden", [5, 2])]
    requests = spark.createDataFrame(asked, "request_id string, movie_ids array<bigint>")
    got = {r.request_id: r for r in compare(requests, *tables).collect()}
    assert [m.movie_id for m in got["two"].movies] == [1, 3] and got["two"].note == "not enriched: [3]"
    assert [m.movie_id for m in got["same"].movies] == [1, 1] and got["same"].note is None
    assert got["one"].error and got["one"].movies is None and got["none"].error
    assert [m.movie_id for m in got["unknown"].movies] == [1] and got["unknown"].note == "not found: [99, 98]"
    assert [m.movie_id for m in got["plain"].movies] == [3, 1, 4] and got["plain"].note == "not enriched: [3, 4]"
    assert got["both"].note == "not found: [99]"  # unknown ids hide the other note
    assert [m.movie_id for m in got["hidden"].movies] == [5, 2]  # the status does not matter here
    assert got["two"].movies[1].themes == [] and got["two"].movies[0].production_effectiveness_score == 3


def test_lookup(spark, tables):
    got = {r.movie_id: r for r in lookup_enriched(spark.createDataFrame([(1,), (99,)], "movie_id bigint"), tables[1]).collect()}
    assert got[1].error is None and got[1].themes == ["a", "b", "c"]
    assert "99" in got[99].error and got[99].themes is None


def test_index_covers_each_value_once(spark):
    rng = random.Random(3)
    values = [rng.choice([0, 0, 0, 5, rng.randrange(-50, 3000), rng.randrange(10 ** 12)]) for _ in range(3000)] + [None]
    rows = spark.createDataFrame([(v,) for v in values], "x bigint")
    axis, = intervals.axes(rows, ["x"])
    assert axis.has_nulls and len(axis.edges) < 1 << intervals.LEVELS and {0, 1} <= set(axis.edges)
    bounds = [(rng.choice([None, *values, -9 * 10 ** 18]), rng.choice([None, *values, 9 * 10 ** 18])) for _ in range(60)] + [(0, 0), (5, 4), (None, None), (-(1 << 63), (1 << 63) - 1)]
    ranges = spark.createDataFrame([(i, *b) for i, b in enumerate(bounds)], "id int, low bigint, high bigint").withColumn("c", axis.cover(F.col("low"), F.col("high")))
    held = {r.x: r.nodes for r in rows.distinct().withColumn("nodes", axis.nodes(F.col("x"))).collect()}
    assert held.pop(None) is None and all(len(n) == intervals.LEVELS + 1 for n in held.values())
    for r in ranges.collect():
        low, high = bounds[r.id]
        assert len(r.c.whole) <= 2 * intervals.LEVELS and len(r.c.parts) <= 2
        for x, nodes in held.items():
            whole, part = len(set(nodes) & set(r.c.whole)), len(set(nodes) & set(r.c.parts))
            inside = (low is None or x >= low) and (high is None or x <= high)
            assert whole + part <= 1 and whole <= inside <= whole + part, (low, high, x)


def test_range_requests_meet_few_rows(spark):
    """Half-open, closed and absent ranges over many rows: what is looked through one by one is small, whatever the range holds."""
    rng = random.Random(9)
    n = 5000
    rows = [(i, 1900 + rng.randrange(120), rng.choice([0, rng.randrange(10 ** 6)]), rng.randrange(10 ** 6), rng.randrange(1, 300), [], None, None, None, None) for i in range(n)]
    items = spark.createDataFrame(rows, "movie_id long, filter_year int, budget long, revenue long, runtime int, genre_keys array<string>, overview_sentiment string, "
                                        "budget_tier string, revenue_tier string, production_effectiveness_score int")
    found = intervals.axes(items, ["filter_year", "budget", "runtime"])
    specs = [{"min_year": 1901}, {"max_budget": 900_001}, {"min_budget": 1}, {}, {"min_year": -1, "max_year": 9999}, {"min_runtime": 2, "max_runtime": 298}, {"max_budget": 0}]
    specs += [{"min_year": 1950, "max_year": 1951, "min_budget": 5}, {"min_year": 1900, "max_runtime": 10}]
    frame = parse_filter_specs(spark.createDataFrame([(i, json.dumps(s | {"limit": 50, "sort_by": "revenue_desc"})) for i, s in enumerate(specs)], "spec_id int, filter_json string"))
    placed = _placed(frame.withColumn("wanted", F.col("genres")), found)
    singly = {r.spec_id: r["count"] for r in looked_through(items, placed, found, 2).groupBy("spec_id").count().collect()}
    assert all(singly.get(i, 0) <= n / 50 for i in range(7)), singly
    assert singly[7] <= n / 20 and singly[8] <= n / 20 and singly[8] > 0
    tops = best_of_nodes(items, placed, found, 2).groupBy("spec_id").count().collect()
    assert {r.spec_id for r in tops} >= {0, 1, 2, 3, 4, 5, 6} and max(r["count"] for r in tops) <= 50 * 2 * intervals.LEVELS


def test_requests_stop_at_their_limit(spark, monkeypatch):
    """Many unlike requests under one large facet: each passes on no more rows than it asks for, found block by block, and they are the right ones."""
    monkeypatch.setattr("playbill.operators.search.BLOCK", 16)
    rng = random.Random(4)
    rows = [(i, 1900 + rng.randrange(120), rng.randrange(1000), rng.choice([None, rng.randrange(9)]), rng.randrange(1, 300), rng.choice([["drama"], ["drama", "war"], ["war"]]), "neutral",
             rng.choice(["low", "high"]), "low", rng.randrange(1, 11)) for i in range(3000)]
    items = spark.createDataFrame(rows, "movie_id long, filter_year int, budget long, revenue long, runtime int, genre_keys array<string>, overview_sentiment string, "
                                        "budget_tier string, revenue_tier string, production_effectiveness_score int")
    found = intervals.axes(items, ["filter_year", "budget", "runtime"])
    specs = [{"genres": ["war", "drama"], "max_budget": i * 20, "sort_by": by, "limit": 7} for i in range(20) for by in SORT_COLUMNS]
    specs += [{"genres": ["drama"], "min_score": 9, "budget_tier": "low", "limit": 50, "sort_by": "revenue_desc"}] * 3 + [{"sentiment": "neutral", "max_runtime": 0}, {"min_score": 10, "limit": 9}]
    frame = parse_filter_specs(spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate(specs)], "spec_id int, filter_json string"))
    met = looked_through(items, _placed(frame.withColumn("wanted", F.col("genres")), found), found, 2).collect()
    got = {}
    for r in sorted(met, key=lambda r: (r._sort is None, -(r._sort or 0), r.movie_id)):
        got.setdefault(r.spec_id, []).append(r.movie_id)
    facts = {r.movie_id: r.asDict() | {"status": "Released"} for r in items.collect()}
    for row in frame.collect():
        mine = got.get(row.spec_id, [])
        assert len(mine) <= row.limit * max(1, len(row.genres))
        wanted = row.asDict()
        kept = [m for m in facts.values() if (wanted["min_score"] or 0) <= m["production_effectiveness_score"] and wanted["budget_tier"] in (None, m["budget_tier"])]
        assert mine[:row.limit] == brute(kept, {}, wanted | {"min_score": None, "budget_tier": None, "sentiment": None}), wanted


def test_bad_requests_are_reported(spark, tables):
    specs = spark.createDataFrame([(1, [], 99, None), (2, [], 10, None), (3, [], 5, "by luck")], "spec_id int, genres array<string>, limit int, sort_by string")
    for f in ("min_year", "max_year", "min_budget", "max_budget", "min_runtime", "max_runtime", "min_score"):
        specs = specs.withColumn(f, F.lit(None).cast("long"))
    for f in ("budget_tier", "revenue_tier", "sentiment"):
        specs = specs.withColumn(f, F.lit(None).cast("string"))
    assert {r.spec_id for r in search_batch(*tables, specs).collect()} == {2}
    assert {r.spec_id: r.reject_reason for r in refused_requests(specs).collect()} == {1: "limit: too large", 3: "sort_by: not allowed"}
    told = {r.spec_id: (r["rank"], r.error) for r in search_batch(*tables, specs, report=True).filter("error is not null").collect()}
    assert told == {1: (None, "limit: too large"), 3: (None, "sort_by: not allowed")}
