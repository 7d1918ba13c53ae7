from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from frames import catalog, enriched, movie
from playbill.contracts import DEFAULT_LIMIT, ENRICHED_FIELDS, FILTER_FIELDS, PREDICTION_FIELDS, PROFILE_FIELDS, Field
from playbill.operators.search import check_filters, search_json
from playbill.operators.validate import read_fields, validate, validate_enriched
from playbill.sources.specs import parse_filter_specs


def parse(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "spec_id int, filter_json string")
    return parse_filter_specs(rows).orderBy("spec_id").collect()


def test_filter_defaults_and_roundtrip(spark):
    asked = {"genres": ["Western", "noir"], "revenue_tier": "medium", "sentiment": "neutral", "min_year": 1931, "max_budget": 9007199254740993,
             "min_runtime": 61, "limit": 17, "sort_by": "runtime_desc"}
    empty, full = parse(spark, "{}", json.dumps(asked | {"colour": "ignored"}))
    assert (empty.genres, empty.revenue_tier, empty.limit, empty.valid) == ([], None, DEFAULT_LIMIT, True)
    assert full.valid and {name: full[name] for name in asked} == asked


def beyond(field: Field) -> list:
    """Values outside the bounds of a field."""
    outside = [n for n in (None if field.low is None else field.low - 1, None if field.high is None else field.high + 1) if n is not None]
    return outside + (["not among the choices"] if field.choices else []) + ([2.25, "1e1"] if field.kind == "int" else [])


BAD = {json.dumps({f.name: value}): f.name for f in FILTER_FIELDS for value in beyond(f)} | {
    '{"limit": null}': "limit", '{"genres": null}': "genres", '{"genres": "Western"}': "genres", '{"genres": [7]}': "genres", '{"min_year": "soon"}': "min_year"}


def test_bad_filters_are_named(spark):
    for row, field in zip(parse(spark, *BAD), BAD.values()):
        assert not row.valid and row.reject_reason.startswith(f"{field}:"), row


@pytest.mark.parametrize("text", [*BAD, "{not json", "[1]"])
def test_bad_single_filters_raise(spark, text):
    movies = catalog(spark, [movie(1)])
    with pytest.raises(ValueError):
        search_json(movies, enriched(spark, []), text)


def test_broken_json_and_lax_numbers(spark):
    assert [r.valid for r in parse(spark, "{} {}", "{}}", '{"limit": 5},', ' {"limit": 5}\n')] == [False, False, False, True]
    broken, listed, lax, nulls = parse(spark, "{not json", "[1]", '{"limit": "8", "min_score": 8.0}', '{"min_year": null, "sentiment": null}')
    assert broken.reject_reason == listed.reject_reason == "not a JSON object"
    assert (lax.limit, lax.min_score, lax.valid) == (8, 8, True)
    assert nulls.valid and nulls.min_year is None


def test_single_filter_checks_like_the_table():
    assert check_filters({"limit": "8", "min_score": 8.0, "unknown": 1}) == {"genres": [], "limit": 8, "min_score": 8}


def within(field: Field):
    """A value at the lower bound of a field."""
    if field.kind == "texts":
        return [f"item {k}" for k in range(field.min_items or 1)]
    return field.choices[-1] if field.choices else field.low


def test_enriched_rows(spark):
    """One row at the bounds, then rows that leave them in one field each."""
    good = {f.name: within(f) for f in ENRICHED_FIELDS}
    rows = [good]
    for f in ENRICHED_FIELDS:
        lists = [["x"] * n for n in (f.min_items - 1, f.max_items + 1)] if f.kind == "texts" else []
        rows += [good | {f.name: value} for value in [None, *lists, *(v for v in beyond(f) if not (f.kind == "int" and not isinstance(v, int)))]]
    schema = "i int, " + ", ".join(f"{f.name} {'array<string>' if f.kind == 'texts' else 'int' if f.kind == 'int' else 'string'}" for f in ENRICHED_FIELDS)
    frame = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], schema)
    assert [r.valid for r in validate_enriched(frame).orderBy("i").collect()] == [True] + [False] * (len(rows) - 1)


def test_predictions_and_profiles(spark):
    frame = spark.createDataFrame([(i, r, "x") for i, r in enumerate((0.5, 5.0, 5.01, -0.5, 0.49, float("nan")))], "i int, predicted_rating double, rationale string")
    assert [r.valid for r in validate(frame, PREDICTION_FIELDS).orderBy("i").collect()] == [True, True, False, False, False, False]
    lists = [(["a"], ["x"]), (list("abcdef"), ["x"]), (["a"], list("123456")), ([], [])]
    frame = spark.createDataFrame([(i, g, t, "mixed", "s") for i, (g, t) in enumerate(lists)],
                                  "i int, favorite_genres array<string>, favorite_themes array<string>, typical_sentiment string, summary string")
    assert [r.valid for r in validate(frame, PROFILE_FIELDS).orderBy("i").collect()] == [True, False, False, True]


def test_answers_read_from_json(spark):
    base = {"overview_sentiment": "neutral", "budget_tier": "low", "revenue_tier": "low", "production_effectiveness_score": 8, "themes": ["a", "b", "c"]}
    scores = [8, "8", 8.0, 8.5, "x", None]
    frame = spark.createDataFrame([(i, json.dumps({**base, "production_effectiveness_score": s})) for i, s in enumerate(scores)], "i int, t string")
    rows = read_fields(frame, F.col("t"), ENRICHED_FIELDS, keep=["i"]).orderBy("i").collect()
    assert [r.valid for r in rows] == [True, True, True, False, False, False]
    assert [r.production_effectiveness_score for r in rows[:3]] == [8, 8, 8]
