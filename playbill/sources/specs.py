"""Filter requests given as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from playbill.contracts import DEFAULT_LIMIT, FILTER_FIELDS
from playbill.operators.validate import read_fields


def parse_filter_specs(requests: DataFrame, json_column: str = "filter_json") -> DataFrame:
    """Typed filter columns plus ``valid`` and ``reject_reason``. Unknown keys are ignored;
    a missing ``genres`` is ``[]`` and a missing ``limit`` is the default."""
    others = [c for c in requests.columns if c != json_column]
    typed = read_fields(requests, F.col(json_column), FILTER_FIELDS, keep=others)
    return typed.withColumns({
        "genres": F.coalesce("genres", F.array().cast("array<string>")),
        "limit": F.coalesce("limit", F.lit(DEFAULT_LIMIT).cast("long")),
    })
