from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from playbill.functions import dates, names, numbers, text


def one(spark, kind, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("x"))).collect()]


def test_parse_names(spark):
    cases = {
        None: [], "": [], " \t\n": [],
        '[{"id": 1, "name": "Drama"}, {"id": 2, "name": "Crime"}]': ["Drama", "Crime"],
        "[]": ["[]"],
        '{"name": "x"}': ['{"name": "x"}'],
        "A|B": ["A", "B"], "bare": ["bare"], " Warner Bros. ": ["Warner Bros."], "|||": ["|||"],
        '[1, {"name": "x"}, {"id": 2}]': ["x"],
        '[{"name": null}, {"name": "z"}]': ["z"],
        '[{"name": 5}]': ["5"],
        '[{"name": "a", "name": "b"}]': ["b"],
        " A | | B ": ["A", "B"],
        '[{"name": NaN}]': ['[{"name": NaN}]'],
        '[{"name": "q"|': ['[{"name": "q"'],
        "[{'name': 'x'}]": ["[{'name': 'x'}]"],
        '[{"name": "x"}] more': ['[{"name": "x"}] more'], '[{"name": "x"}]]': ['[{"name": "x"}]]'], '[{"name": "x"}],[]': ['[{"name": "x"}],[]'],
        '[{"name": "x"}, {"name": "y"}]|z': ['[{"name": "x"}, {"name": "y"}]', "z"], ' [{"name": "x"}]\n': ["x"],
    }
    assert one(spark, "string", cases, names.parse_names) == list(cases.values())


def test_primary_name_and_keys(spark):
    assert one(spark, "string", [None, "A|b", "[]"], lambda c: names.primary_name(names.parse_names(c))) == ["Unknown", "A", "[]"]
    assert one(spark, "string", ["Ab|aB|c"], lambda c: names.name_keys(names.parse_names(c))) == [["ab", "c"]]
    assert one(spark, "string", ["a|b|c|d"], lambda c: names.first_three(names.parse_names(c))) == ["a, b, c"]


def test_years(spark):
    values = [None, "", "unknown", "1999-01-02", "199x", "abcd", "19", "12/5/1999", "19.5"]
    assert one(spark, "string", values, dates.release_year) == [None, None, None, 1999, None, None, None, None, None]
    assert one(spark, "string", values, dates.filter_year) == [None, 0, 0, 1999, 199, 0, 19, 12, 19]


def test_roi_and_unknown_amounts(spark):
    rows = spark.createDataFrame([(0, 5), (10, 15), (None, 5)], "b bigint, r bigint")
    assert [r[0] for r in rows.select(numbers.roi(F.col("r"), F.col("b"))).collect()] == [None, 1.5, None]


def test_rounding_is_on_the_binary_value(spark):
    values = [2.125, 2.135, 2.175, 3.375, 0.5]
    assert one(spark, "double", values, lambda c: numbers.round_even(c, 2)) == [round(v, 2) for v in values]


def test_half_steps(spark):
    values = [0.1, 0.74, 0.75, 3.2, 3.25, 4.9, 7.0]
    assert one(spark, "double", values, lambda c: numbers.half_steps(c, 0.5, 5.0)) == [0.5, 0.5, 1.0, 3.0, 3.5, 5.0, 5.0]


@pytest.mark.parametrize("content, answer", [
    ([('{"x": 1}', None)], '{"x": 1}'),
    ([('```json\n{"x": 3}\n```', None)], '{"x": 3}'),
    ([(None, "thinking"), (' {"x": 4} \n', None)], '{"x": 4}'),
    ([("a ``` b", None)], "a ``` b"),
    ([('```\n{"a":', None), (' 1}\n  ```  \n', None)], '{"a": 1}'),
    ([("```json\r\n{}\r\n```", None)], "{}"),
    ([(None, "only thinking")], ""),
])
def test_clean_answers(spark, content, answer):
    rows = spark.createDataFrame([(content,)], "content array<struct<text:string,reasoning:string>>")
    assert rows.select(text.without_fences(text.answer_text(F.col("content")))).first()[0] == answer


def test_phrases(spark):
    rows = spark.createDataFrame([(3.9, 12), (None, 0), (2.125, 1)], "a double, n bigint")
    assert [r[0] for r in rows.select(text.rating_phrase(F.col("a"), F.col("n"))).collect()] == [
        "3.90 avg across 12 user ratings", "no user ratings", "2.12 avg across 1 user ratings"]
    assert one(spark, "bigint", [1234567, 0, None], text.money) == ["$1,234,567", "$0", "$0"]
    rows = spark.createDataFrame([(150, 100), (150, 0), (0, 100)], "r bigint, b bigint")
    assert [r[0] for r in rows.select(text.roi_phrase(F.col("r"), F.col("b"))).collect()] == ["1.5x", "n/a", "n/a"]
    assert one(spark, "int", [90, 0, None], text.runtime_phrase) == ["90", "unknown", "unknown"]


def test_histogram_bins(spark):
    values = [0.0, 0.5, 4.9, 5.0, 10.0]
    assert one(spark, "double", values, lambda c: numbers.equal_width_bin(c, F.lit(0.0), F.lit(10.0), 10)) == [0, 0, 4, 5, 9]
    assert one(spark, "double", [3.0], lambda c: numbers.equal_width_bin(c, F.lit(3.0), F.lit(3.0), 10)) == [5]


def test_parse_names_like_a_json_reader(spark):
    """Random near-JSON text against Python's own reader."""
    import json
    import random

    rng = random.Random(1)
    values = ['"A"', '"B c"', "null", "5", "1.5", '"x|y"', '"\\u00e9"', '" s "', '""', "-0", "01", "1e5", "+1", '"\t"', "'q'"]

    def item():
        v, w = rng.choice(values), rng.choice(values)
        return rng.choice([f'{{"id": {v}, "name": {w}}}', f'{{"name": {v}}}', v, "{}", f"[{v}]", f'{{"name": {v},}}', f"{{name: {v}}}", f'{{"name": {v}, "name": {w}}}'])

    def text():
        listed = "[" + ", ".join(item() for _ in range(rng.randrange(3))) + "]"
        return rng.choice([
            listed, listed, listed + rng.choice([" x", "|b", ",", "]", " ", "\n", "{}", "//c"]), rng.choice([" ", "\n", "x"]) + listed,
            listed[: rng.randrange(len(listed))], "|".join(rng.choice(["a", " b ", "", "\t", '{"name":"z"}']) for _ in range(rng.randrange(1, 5)))])

    def expected(raw):
        if not raw.strip():
            return []
        try:
            doc = json.loads(raw)
        except ValueError:
            doc = None
        named = [str(x["name"]) for x in doc if isinstance(x, dict) and x.get("name") is not None] if isinstance(doc, list) else []
        return named or [p.strip() for p in raw.split("|") if p.strip()] or [raw.strip()]

    texts = sorted({text() for _ in range(1500)})
    got = one(spark, "string", texts, names.parse_names)
    assert [(t, g) for t, g in zip(texts, got) if g != expected(t)] == []
