"""Helpers the operators share: Arrow columns made in tasks, ASCII word splitting, written intermediates."""

from __future__ import annotations

import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from playbill.session import written

__all__ = ["add_columns", "binary", "by_value", "map_rows", "read", "tidy_words", "written"]

ROWS_PER_BATCH = 1000

# A-Z become a-z; 0-9, a-z and all bytes of non-ASCII characters are word bytes; the rest separates.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def by_value(module: str) -> None:
    """Ship a module's functions inside the task, so that workers need not find the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def tidy_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.translate(WORD_BYTES).split()


def binary(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    return [v or b"" for v in batch.column(name).cast(pa.binary()).to_pylist()]


def _small_batches(spark: SparkSession) -> None:
    """Texts are long: keep few of them in a worker's memory at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def add_columns(rows: DataFrame, added: str, compute: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """``rows`` with the columns of the DDL ``added``; ``compute`` gives one list of values for each.
    Columns of the same names are replaced, all others pass through."""
    fields = StructType.fromDDL(added).fields
    names = {f.name.lower() for f in fields}
    kept = [c for c in rows.columns if c.lower() not in names]
    types = [to_arrow_type(f.dataType) for f in fields]
    labels = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            values = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(compute(batch), types, strict=True)]
            n = len(kept)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *values], names=[*kept, *labels])

    _small_batches(rows.sparkSession)
    clash = [c for c in rows.columns if c not in kept]
    schema = StructType([*(rows.schema[c] for c in kept), *fields])
    return rows.select(*(rows[c] for c in [*kept, *clash])).mapInArrow(run, schema)


def map_rows(rows: DataFrame, made: str, compute: Callable) -> DataFrame:
    """``compute`` gets an iterator of Arrow batches and yields lists of columns in the order of the DDL ``made``."""
    fields = StructType.fromDDL(made).fields
    types = [to_arrow_type(f.dataType) for f in fields]
    labels = [f.name for f in fields]

    def run(batches):
        for columns in compute(batches):
            yield pa.RecordBatch.from_arrays(
                [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(columns, types, strict=True)], names=labels)

    _small_batches(rows.sparkSession)
    return rows.mapInArrow(run, StructType(fields))
