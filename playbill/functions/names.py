"""Names held as JSON list text, as a pipe-separated list or as bare text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from playbill.contracts import UNKNOWN_GENRE
from playbill.functions.documents import let, strict_json
from playbill.functions.text import strip


def parse_names(raw: Column) -> Column:
    """Array of names. Null or blank text gives ``[]``. A JSON list gives the ``name`` of its objects
    if there is any; other text (``[]`` included) is split on ``|``; what yields no part stays whole."""
    listed = F.try_variant_get(strict_json(raw), "$", "array<variant>")
    from_json = F.filter(
        F.transform(listed, lambda item: F.try_variant_get(item, "$.name", "string")),
        lambda name: name.isNotNull(),
    )
    parts = F.filter(F.transform(F.split(raw, "[|]"), strip), lambda part: part != "")
    by_pipe = F.when(F.size(parts) > 0, parts).otherwise(F.array(strip(raw)))
    chosen = let(from_json, lambda found: F.when(F.size(found) > 0, found).otherwise(by_pipe))
    return F.when(raw.isNull() | (strip(raw) == ""), F.array().cast("array<string>")).otherwise(chosen)


def name_keys(names: Column) -> Column:
    """Lower-cased distinct names, for case-insensitive matching."""
    return F.array_distinct(F.transform(names, F.lower))


def primary_name(names: Column) -> Column:
    return F.coalesce(F.get(names, F.lit(0)), F.lit(UNKNOWN_GENRE))


def first_three(names: Column) -> Column:
    return F.array_join(F.slice(names, 1, 3), ", ")
