"""JSON text as variants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

_END = "end of the document"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strict_json(text: Column) -> Column:
    """The JSON value of a text, null unless the text holds exactly one. Spark's parser stops after the
    first value, so the text is read as the first of two list items, the second being a marker."""
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f', "{_END}"]')))
    return let(pair, lambda p: F.when(
        (F.try_variant_get(p, "$[1]", "string") == _END) & F.try_variant_get(p, "$[2]", "variant").isNull(),
        F.try_variant_get(p, "$[0]", "variant")))
