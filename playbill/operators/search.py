"""Catalog search: one request as a plain plan, or a whole table of requests at once."""

from __future__ import annotations

import json
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from playbill.contracts import (
    DEFAULT_LIMIT, ENRICHED_COLUMNS, FILTER_FIELDS, MAX_LIMIT, RESULT_COLUMNS, SORT_COLUMNS, Field,
)
from playbill.operators.filters import has_genre, in_range, is_released
from playbill.operators.intervals import Axis, axes
from playbill.operators.validate import validate_filters
from playbill.session import written
from playbill.sources.tables import prepare_catalog

_BY_NAME = {f.name: f for f in FILTER_FIELDS}


def _checked(field: Field, value: Any) -> Any:
    """A single request is checked before planning, by the same bounds the request tables use."""
    if value is None:
        if not field.nullable:
            raise ValueError(f"{field.name}: must not be null")
        return None
    if field.kind == "texts":
        if not isinstance(value, (list, tuple)) or any(not isinstance(v, str) for v in value):
            raise ValueError(f"{field.name}: must be a list of text")
        return list(value)
    if field.kind == "text":
        if value not in field.choices:
            raise ValueError(f"{field.name}: {value!r} is not allowed")
        return value
    try:
        number = Decimal(value.strip() if isinstance(value, str) else str(value))
    except (InvalidOperation, ValueError):
        raise ValueError(f"{field.name}: {value!r} is not a whole number") from None
    if isinstance(value, bool) or (isinstance(value, str) and "e" in value.lower()) or not number.is_finite() or number != int(number):
        raise ValueError(f"{field.name}: {value!r} is not a whole number")
    if (field.low is not None and number < field.low) or (field.high is not None and number > field.high):
        raise ValueError(f"{field.name}: {value!r} is out of range")
    return int(number)


def check_filters(filters: dict[str, Any]) -> dict[str, Any]:
    """Checked filters with defaults; unknown keys are ignored, bad values raise ValueError."""
    checked = {"genres": [], "limit": DEFAULT_LIMIT}
    checked.update({k: _checked(_BY_NAME[k], v) for k, v in filters.items() if k in _BY_NAME})
    return checked


def with_enrichment(rows: DataFrame, enriched: DataFrame, required: bool = False) -> DataFrame:
    """Add the enriched columns, null outside the enriched set, or keep only enriched rows."""
    return rows.join(enriched.select(*ENRICHED_COLUMNS), "movie_id", "inner" if required else "left")


def _catalog_matches(catalog: DataFrame, f: dict[str, Any]) -> DataFrame:
    return prepare_catalog(catalog).filter(
        is_released()
        & in_range("filter_year", f.get("min_year"), f.get("max_year"))
        & in_range("budget", f.get("min_budget"), f.get("max_budget"))
        & in_range("runtime", f.get("min_runtime"), f.get("max_runtime"))
        & has_genre(f["genres"])
    )


def _enriched_conditions(f: dict[str, Any]) -> list[Column]:
    equal = {"budget_tier": "budget_tier", "revenue_tier": "revenue_tier", "sentiment": "overview_sentiment"}
    wanted = [F.col(column) == f[name] for name, column in equal.items() if f.get(name) is not None]
    if f.get("min_score") is not None:
        wanted.append(F.col("production_effectiveness_score") >= f["min_score"])
    return wanted


def candidates(catalog: DataFrame, enriched: DataFrame, **filters: Any) -> DataFrame:
    """All rows that meet the filters, before sort and limit."""
    f = check_filters(filters)
    wanted = _enriched_conditions(f)
    for condition in wanted:
        enriched = enriched.filter(condition)
    return with_enrichment(_catalog_matches(catalog, f), enriched, required=bool(wanted)).select(*RESULT_COLUMNS)


def search(catalog: DataFrame, enriched: DataFrame, **filters: Any) -> DataFrame:
    """Best rows for one request. Ties, and requests without a sort key, go by ``movie_id``.
    If nothing enriched decides which rows win, they are chosen first and only they are joined."""
    f = check_filters(filters)
    sort_column = SORT_COLUMNS.get(f.get("sort_by"))
    order = ([F.desc_nulls_last(sort_column)] if sort_column else []) + [F.asc("movie_id")]
    if _enriched_conditions(f) or sort_column in ENRICHED_COLUMNS:
        return candidates(catalog, enriched, **filters).orderBy(*order).limit(f["limit"])
    winners = _catalog_matches(catalog, f).orderBy(*order).limit(f["limit"])
    return with_enrichment(winners, enriched).select(*RESULT_COLUMNS).orderBy(*order)


def search_json(catalog: DataFrame, enriched: DataFrame, filter_json: str) -> DataFrame:
    """``search`` for a request given as JSON text."""
    filters = json.loads(filter_json)
    if not isinstance(filters, dict):
        raise ValueError("a filter must be a JSON object")
    return search(catalog, enriched, **filters)


def _spec_accepts() -> Column:
    """A request's bounds against a row: a null bound asks for nothing."""
    def bound(name: str, compare) -> Column:
        limit = F.col(f"s.{name}")
        return limit.isNull() | F.coalesce(compare(limit), F.lit(False))

    return (
        bound("min_year", lambda v: F.col("i.filter_year") >= v)
        & bound("max_year", lambda v: F.col("i.filter_year") <= v)
        & bound("min_budget", lambda v: F.col("i.budget") >= v)
        & bound("max_budget", lambda v: F.col("i.budget") <= v)
        & bound("min_runtime", lambda v: F.col("i.runtime") >= v)
        & bound("max_runtime", lambda v: F.col("i.runtime") <= v)
        & bound("budget_tier", lambda v: F.col("i.budget_tier") == v)
        & bound("revenue_tier", lambda v: F.col("i.revenue_tier") == v)
        & bound("sentiment", lambda v: F.col("i.overview_sentiment") == v)
        & bound("min_score", lambda v: F.col("i.production_effectiveness_score") >= v)
    )


def _facet(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), value.cast("string"))


#: The bounds of each axis that the index of ranges has.
_BOUNDS = {"filter_year": ("min_year", "max_year"), "budget": ("min_budget", "max_budget"), "runtime": ("min_runtime", "max_runtime")}
EVERYWHERE = "all"


def _placed(specs: DataFrame, found: list[Axis]) -> DataFrame:
    """The requests with ``facets``, where they look for rows one by one, and ``tops``, the sets of rows of which they take the best as they are.

    With wanted genres a request looks under each of them; else, if it asks for an enriched value, among the enriched rows; else it goes by ranges. A
    range over all values asks for nothing. One range makes a request's rows the union of nodes, so the best of each node are enough, and
    only the cells at its ends are looked through; of several ranges the one of fewest cells gives the nodes to look under. Without any range the request takes the best of all rows."""
    enriched_only = F.coalesce("budget_tier", "revenue_tier", "sentiment", F.col("min_score").cast("string")).isNotNull()
    none = F.array().cast("array<string>")
    ranges = []
    for axis in found:
        low, high = (F.col(name) for name in _BOUNDS[axis.name])
        specs = specs.withColumn(f"_{axis.name}", axis.cover(low, high))
        asked = F.coalesce(low, high).isNotNull()
        asks = asked if axis.has_nulls else asked & ~F.col(f"_{axis.name}.every")
        ranges.append(F.when(asks, F.struct(F.col(f"_{axis.name}.cells").alias("cells"), F.lit(axis.name).alias("axis"), F.col(f"_{axis.name}.whole").alias("whole"), F.col(f"_{axis.name}.parts").alias("parts"))))
    specs = specs.withColumn("_ranges", F.array_sort(F.array_compact(F.array(*ranges)))).withColumn("_best", F.get("_ranges", F.lit(0)))
    by_range = (F.size("wanted") == 0) & ~enriched_only
    one, more = by_range & (F.size("_ranges") == 1), by_range & (F.size("_ranges") > 1)
    facets = (
        F.when(F.size("wanted") > 0, F.transform("wanted", lambda g: _facet("genre", g)))
        .when(enriched_only, F.array(F.lit("enriched")))
        .when(one, F.col("_best.parts")).when(more, F.concat("_best.whole", "_best.parts")).otherwise(none)
    )
    tops = F.when(one, F.col("_best.whole")).when(by_range & (F.size("_ranges") == 0), F.array(F.lit(EVERYWHERE))).otherwise(none)
    return specs.withColumn("facets", facets).withColumn("tops", tops).drop("_ranges", "_best", *(f"_{axis.name}" for axis in found))


def _item_nodes(found: list[Axis]) -> Column:
    return F.flatten(F.array_compact(F.array(*(axis.nodes(F.col(axis.name)) for axis in found))))


def _sort_value(row: str, by: Column) -> Column:
    value = F.lit(None).cast("long")
    for name, column in SORT_COLUMNS.items():
        value = F.when(by == name, F.col(f"{row}{column}").cast("long")).otherwise(value)
    return value


def _salted(rows: DataFrame, salts: int, key: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))


def _repeated(rows: DataFrame, salts: int) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


#: What a request asks of a row, besides its facet and order.
_ASKED = ("wanted", "min_year", "max_year", "min_budget", "max_budget", "min_runtime", "max_runtime", "budget_tier", "revenue_tier", "sentiment", "min_score")
#: Rows of a facet that are looked through together, and how many times as many rows of it the next round looks through.
BLOCK, GROWTH = 512, 8


def _probes(specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different questions of the requests (probe, facet, by, limit and bounds), one for each facet, and (spec_id, limit, probe) of the requests that ask them."""
    asked = specs.withColumn("facet", F.explode("facets")).withColumn("by", F.coalesce("sort_by", F.lit(""))).select("spec_id", "limit", "facet", "by", *_ASKED)
    asked = asked.withColumn("_question", F.to_json(F.struct("facet", "by", *_ASKED)))
    once = asked.groupBy("_question").agg(F.max("limit").alias("limit"), *(F.first(c).alias(c) for c in ("facet", "by", *_ASKED)))
    probes = written(once.withColumn("probe", F.monotonically_increasing_id()), "probes")
    return probes.drop("_question"), asked.select("spec_id", "limit", "_question").join(probes.select("_question", "probe"), "_question").drop("_question")


def _blocks(items: DataFrame, probes: DataFrame, found: list[Axis]) -> tuple[DataFrame, DataFrame]:
    """The rows of each facet in each order that is asked for there, numbered in ``block``s of BLOCK rows, and the ranges of values of each block. No task numbers
    a whole facet: rows are dealt by ranges of the order and numbered there, after as many as the ranges before hold."""
    facets = F.array_compact(F.concat(
        F.transform("genre_keys", lambda g: _facet("genre", g)), F.array(F.when(F.col("overview_sentiment").isNotNull(), F.lit("enriched"))), _item_nodes(found)))
    rows = items.withColumn("facet", F.explode(facets)).join(probes.select("facet", "by").distinct(), "facet").withColumn("_sort", _sort_value("", F.col("by")))
    order = [F.desc_nulls_last("_sort"), F.asc("movie_id")]
    dealt = written(rows.repartitionByRange("facet", "by", *order).withColumn("_dealt", F.spark_partition_id()), "facet-rows")
    sizes = dealt.groupBy("facet", "by", "_dealt").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("facet", "by").orderBy("_dealt").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("facet", "by", "_dealt", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("facet", "by", "_dealt").orderBy(*order)) - 1
    numbered = dealt.withColumn("_inside", inside).join(starts, ["facet", "by", "_dealt"])
    rows = written(numbered.withColumn("block", F.floor((F.col("_before") + F.col("_inside")) / BLOCK)).drop("_dealt", "_inside", "_before"), "facet-blocks")
    values = ("filter_year", "budget", "runtime", "production_effectiveness_score")
    ranges = [f(c).alias(f"{end}_{c}") for c in values for f, end in ((F.min, "least"), (F.max, "most"))]
    return rows, written(rows.groupBy("facet", "by", "block").agg(*ranges), "block-ranges")


def _may_hold() -> Column:
    """Whether the ranges of a block ``b`` leave room for a row that the request ``s`` accepts."""
    holds = F.lit(True)
    for bound, column in {**{low: axis for axis, (low, _) in _BOUNDS.items()}, "min_score": "production_effectiveness_score"}.items():
        holds &= F.col(f"s.{bound}").isNull() | F.coalesce(F.col(f"b.most_{column}") >= F.col(f"s.{bound}"), F.lit(False))
    for column, (_, bound) in _BOUNDS.items():
        holds &= F.col(f"s.{bound}").isNull() | F.coalesce(F.col(f"b.least_{column}") <= F.col(f"s.{bound}"), F.lit(False))
    return holds


def looked_through(items: DataFrame, specs: DataFrame, found: list[Axis], salts: int) -> DataFrame:
    """(spec_id, limit, _sort, movie_id): the best rows that requests meet under each of their facets and accept, up to ``limit``. A row with several wanted genres counts under the first.

    Equal requests are answered once. The rows of a facet are looked through in the order that is asked for, first BLOCK of them, then in each
    round GROWTH times as many, and a request that has its rows asks no further; blocks whose values are all out of bounds are passed over. So a request meets about as many rows as it takes to find
    ``limit`` that it accepts, whatever the facet holds; only one that accepts hardly any row of its facet goes through all of it."""
    probes, links = _probes(specs)
    rows, ranges = _blocks(items, probes, found)
    lasts = ranges.groupBy("facet", "by").agg(F.max("block").alias("_last"))
    open_probes = written(probes.join(lasts, ["facet", "by"]), "open-probes")
    first_common = F.get(F.array_intersect(F.col("s.wanted"), F.col("i.genre_keys")), F.lit(0))
    once = (F.size("s.wanted") == 0) | (F.col("i.facet") == _facet("genre", first_common))
    best = Window.partitionBy("probe").orderBy(F.desc_nulls_last("_sort"), "movie_id")
    at, end, made = 0, 1, []
    while not open_probes.isEmpty():
        same = (F.col("s.facet") == F.col("b.facet")) & (F.col("s.by") == F.col("b.by"))
        near = ranges.where((F.col("block") >= at) & (F.col("block") < end))
        asked = open_probes.alias("s").join(near.alias("b"), same & _may_hold()).select("s.*", "b.block")
        # The first block is the one that all requests of a facet meet.
        spread = salts if at == 0 else 1
        met = (
            _salted(rows.where((F.col("block") >= at) & (F.col("block") < end)), spread, "movie_id").alias("i")
            .join(_repeated(asked, spread).alias("s"), (F.col("i.facet") == F.col("s.facet")) & (F.col("i.by") == F.col("s.by")) & (F.col("i.block") == F.col("s.block"))
                  & (F.col("i.salt") == F.col("s.salt")) & _spec_accepts() & once)
            .select("s.probe", "s.limit", "i._sort", "i.movie_id")
        )
        taken = met.withColumn("_place", F.row_number().over(best)).filter(F.col("_place") <= MAX_LIMIT).filter(F.col("_place") <= F.col("limit"))
        made.append(written(taken.select("probe", "_sort", "movie_id"), "taken"))
        counts = made[-1].groupBy("probe").agg(F.count(F.lit(1)).alias("_taken"))
        left = open_probes.where(F.col("_last") >= end).join(counts, "probe", "left").withColumn("limit", (F.col("limit") - F.coalesce("_taken", F.lit(0))).cast(probes.schema["limit"].dataType))
        open_probes = written(left.where("limit > 0").drop("_taken"), "open-probes")
        at, end = end, end * GROWTH
    every = items.sparkSession.createDataFrame([], "probe long, _sort long, movie_id long") if not made else made[0]
    for part in made[1:]:
        every = every.unionByName(part)
    return links.join(every, "probe").select("spec_id", "limit", "_sort", "movie_id")


def best_of_nodes(items: DataFrame, specs: DataFrame, found: list[Axis], salts: int) -> DataFrame:
    """(spec_id, limit, _sort, movie_id): the best MAX_LIMIT rows of each node that requests take whole, for each sort key asked for there. A
    node's rows are ranked once for all its requests, and every task keeps MAX_LIMIT of them before the shuffle."""
    wanted = specs.select("spec_id", "limit", "sort_by", F.explode("tops").alias("node"))
    asked = wanted.select("node", "sort_by").distinct()
    rows = items.withColumn("node", F.explode(F.array_append(_item_nodes(found), F.lit(EVERYWHERE))))
    met = _salted(rows, salts, "movie_id").join(_repeated(asked, salts), ["node", "salt"]).select("node", "sort_by", _sort_value("", F.col("sort_by")).alias("_sort"), "movie_id")
    best = Window.partitionBy("node", "sort_by").orderBy(F.desc_nulls_last("_sort"), "movie_id")
    tops = met.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= MAX_LIMIT)
    same_sort = F.col("w.sort_by").eqNullSafe(F.col("t.sort_by"))
    return wanted.alias("w").join(tops.alias("t"), (F.col("w.node") == F.col("t.node")) & same_sort & (F.col("t.place") <= F.col("w.limit"))).select(
        "w.spec_id", "w.limit", "t._sort", "t.movie_id")


def refused_requests(specs: DataFrame) -> DataFrame:
    """(spec_id, reject_reason) of the requests that ``search_batch`` does not answer."""
    return judged_requests(specs).filter(~F.col("valid")).select("spec_id", "reject_reason")


def judged_requests(specs: DataFrame) -> DataFrame:
    """The requests with their verdict; one that they already have (from reading JSON) stands beside that on the values."""
    own = "valid" in specs.columns
    earlier = specs.select("*", F.col("valid").alias("_valid"), (F.col("reject_reason") if "reject_reason" in specs.columns else F.lit(None).cast("string")).alias("_reason")) if own else specs
    judged = validate_filters(earlier.drop("valid", "reject_reason"))
    if not own:
        return judged
    return judged.withColumn("valid", F.col("valid") & F.col("_valid")).withColumn("reject_reason", F.coalesce("_reason", "reject_reason")).drop("_valid", "_reason")


def search_batch(catalog: DataFrame, enriched: DataFrame, specs: DataFrame, salts: int = 16, report: bool = False) -> DataFrame:
    """All requests of a table at once: the best ``limit`` rows per ``spec_id``, with ``rank``.

    Requests and rows meet on facets instead of pairwise: on genres, on being enriched, and on the nodes of a dyadic index of years, budgets and
    runtimes (see ``intervals``), whose cells are read before planning. The placed requests are written once, as several joins read them. What has only one range, or none, takes the ready best of whole nodes. A facet may hold a large part of the
    catalog, so its rows are looked through best first until a request has its rows (``looked_through``); what all requests of a facet meet is spread over ``salts`` join keys and the requests repeated per salt. The
    remaining bounds are tested inside the join on narrow rows, each task keeps at most MAX_LIMIT of them per request before the final
    shuffle, and titles and themes are added to the winners only.

    Requests with values out of bounds are not answered; ``refused_requests`` lists them, and with ``report`` each has one row here, with its reason
    as ``error`` and a null rank."""
    judged = judged_requests(specs)
    specs = judged.filter("valid").withColumn("wanted", F.array_distinct(F.transform("genres", F.lower)))
    released = prepare_catalog(catalog).filter(is_released())
    found = axes(released, list(_BOUNDS))
    placed = written(_placed(specs, found), "requests")
    items = with_enrichment(released.select("movie_id", "filter_year", "budget", "revenue", "runtime", "genre_keys"), enriched).drop("themes")
    matched = looked_through(items, placed, found, salts).unionByName(best_of_nodes(items, placed, found, salts))
    best = Window.partitionBy("spec_id").orderBy(F.desc_nulls_last("_sort"), "movie_id")
    winners = (
        matched.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= MAX_LIMIT)
        .filter(F.col("rank") <= F.col("limit"))
        .select("spec_id", "rank", "movie_id")
    )
    facts = prepare_catalog(catalog).select("movie_id", "title", "release_year", "budget", "revenue", "runtime")
    rows = with_enrichment(winners.join(facts, "movie_id"), enriched).select("spec_id", "rank", *RESULT_COLUMNS)
    if not report:
        return rows
    refused = judged.filter(~F.col("valid")).select("spec_id", F.col("reject_reason").alias("error"))
    return rows.withColumn("error", F.lit(None).cast("string")).unionByName(refused, allowMissingColumns=True)
