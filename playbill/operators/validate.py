"""Validation as columns: every row gets ``valid`` and ``reject_reason`` instead of an exception."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from playbill.session import configure
from playbill.contracts import ENRICHED_FIELDS, FILTER_FIELDS, PREDICTION_FIELDS, PROFILE_FIELDS, Field
from playbill.functions.documents import strict_json

_TYPES = {"int": "long", "double": "double", "text": "string", "texts": "array<string>"}


def _value_reason(field: Field, value: Column) -> Column:
    """Reason why a typed value is refused, null when it is fine."""
    def say(what: str) -> Column:
        return F.lit(f"{field.name}: {what}")

    reason = F.when(value.isNull(), say("missing") if field.required else F.lit(None).cast("string"))
    if field.choices:
        reason = reason.when(~value.isin(*field.choices), say("not allowed"))
    if field.low is not None:
        reason = reason.when(F.isnan(value.cast("double")) | (value < field.low), say("too small"))
    if field.high is not None:
        reason = reason.when(value > field.high, say("too large"))
    if field.min_items is not None:
        reason = reason.when(F.size(value) < field.min_items, say("too few items"))
    if field.max_items is not None:
        reason = reason.when(F.size(value) > field.max_items, say("too many items"))
    return reason


def _with_verdict(rows: DataFrame, reasons: Sequence[Column]) -> DataFrame:
    found = F.array_compact(F.array(*reasons))
    return (
        rows.withColumn("reject_reason", F.nullif(F.array_join(found, "; "), F.lit("")))
        .withColumn("valid", F.col("reject_reason").isNull())
    )


def validate(rows: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Verdict on typed columns."""
    return _with_verdict(rows, [_value_reason(f, F.col(f.name)) for f in fields])


def validate_filters(specs: DataFrame) -> DataFrame:
    return validate(specs, FILTER_FIELDS)


def validate_enriched(rows: DataFrame) -> DataFrame:
    return validate(rows, ENRICHED_FIELDS)


def validate_predictions(rows: DataFrame) -> DataFrame:
    return validate(rows, PREDICTION_FIELDS)


def validate_profiles(rows: DataFrame) -> DataFrame:
    return validate(rows, PROFILE_FIELDS)


def _read(doc: Column, field: Field) -> tuple[Column, Column]:
    """Typed value of a JSON field, and whether the JSON value has an acceptable type. Whole numbers
    may come as ``8``, ``8.0`` or ``"8"``; text must be text."""
    path = f"$.{field.name}"
    raw = F.try_variant_get(doc, path, "variant")
    if field.kind in ("int", "double"):
        if field.kind == "double":
            number = F.try_variant_get(doc, path, "double")
            return number, number.isNotNull()
        # Exact: a whole JSON number or digits in a text as long, other numbers only if their decimal value is whole.
        text = F.try_variant_get(doc, path, "string")
        digits = F.regexp_like(text, F.lit(r"^\s*[+-]?[0-9]+(?:\.0*)?\s*$"))
        whole = F.when(digits, F.regexp_replace(F.trim(text), r"\.0*$", "").try_cast("long")).when(
            F.schema_of_variant(raw) != "STRING", F.when(F.try_variant_get(doc, path, "decimal(38,10)") % 1 == 0, F.try_variant_get(doc, path, "decimal(38,10)").try_cast("long")))
        return whole, whole.isNotNull()
    if field.kind == "text":
        is_text = F.schema_of_variant(raw) == "STRING"
        return F.when(is_text, F.try_variant_get(doc, path, "string")), is_text
    items = F.try_variant_get(doc, path, "array<variant>")
    all_text = F.coalesce(F.forall(items, lambda x: F.schema_of_variant(x) == "STRING"), F.lit(False))
    return F.when(all_text, F.transform(items, lambda x: F.try_variant_get(x, "$", "string"))), all_text


def read_fields(rows: DataFrame, text: Column, fields: Sequence[Field], keep: Sequence[str] = ()) -> DataFrame:
    """Read ``fields`` from JSON text into typed columns, with the verdict beside them. The values are
    taken out by ``inline``, so that filters on them are not rewritten into repeated parsing."""
    configure(rows.sparkSession)
    doc = F.col("_doc")
    values, reasons = [], [F.when(~F.col("_object"), F.lit("not a JSON object"))]
    for field in fields:
        raw = F.try_variant_get(doc, f"$.{field.name}", "variant")
        value, type_ok = _read(doc, field)
        refused = raw.isNotNull() & F.when(F.is_variant_null(raw), F.lit(field.required or not field.nullable)).otherwise(~type_ok)
        values += [value.cast(_TYPES[field.kind]).alias(field.name), F.coalesce(refused, F.lit(False)).alias(f"_bad_{field.name}")]
        reasons.append(F.when(F.col("_object"), F.when(F.col(f"_bad_{field.name}"), F.lit(f"{field.name}: wrong type"))
                              .otherwise(_value_reason(field, F.col(field.name)))))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")), F.lit(False)).alias("_object")
    typed = (
        rows.select(*keep, strict_json(text).alias("_doc"))
        .select(*keep, F.inline(F.array(F.struct(is_object, *values))))
    )
    return _with_verdict(typed, reasons).drop("_object", *[f"_bad_{f.name}" for f in fields])
