"""Writers: enrichment rows and JSON records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from playbill.contracts import ENRICHED_SCHEMA, RESULT_COLUMNS


def append_enriched(rows: DataFrame, path: str) -> None:
    """Append new rows to the enrichment table. Only the new rows are written, so the cost does not
    grow with the table, and the table may be an input of ``rows``."""
    rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ENRICHED_SCHEMA]).write.mode("append").parquet(path)


def format_records(rows: DataFrame, columns: Sequence[str] = RESULT_COLUMNS, keep: Sequence[str] = ()) -> DataFrame:
    """One JSON object per row, nulls included, columns in the given order; absent columns are skipped."""
    present = [c for c in columns if c in rows.columns]
    return rows.select(*keep, F.to_json(F.struct(*present), {"ignoreNullFields": "false"}).alias("record"))
