"""Dyadic index of ranges: an equi-join between values and the ranges that hold them.

The values of an axis are cut into at most 2 ** LEVELS cells of about equal numbers of rows, and the cells are the leaves of a binary tree.
A value has LEVELS + 1 nodes, its cell and all nodes above it; a range is the disjoint union of at most 2 * LEVELS nodes, and of one cell at either
end that it may hold in part. A row and a range that share a node meet; only in the cells at the ends must the bounds be tested.
A value that fills whole cells alone gets a cell of its own, so no range holds it in part."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

LEVELS = 11
#: Edges are found at this many quantiles; each may bring a second edge behind it.
QUANTILES = 1 << (LEVELS - 1)
#: Edges that are looked through at once; two steps find a cell.
BLOCK = 45


@dataclass(frozen=True)
class Axis:
    """A whole-number column, the edges at which its cells start (the first cell is what lies below all of them), and whether it has nulls."""

    name: str
    edges: tuple[int, ...]
    has_nulls: bool

    def _edges(self, step: int = 1) -> Column:
        """The edges, or every ``step``-th of them, as one literal."""
        return F.from_json(F.lit(str(list(self.edges[::step]))), "array<bigint>")

    def cell(self, value: Column) -> Column:
        """Number of the cell of a value: how many edges are at or below it; null for null."""
        value = value.cast("long")
        block = F.size(F.filter(self._edges(BLOCK), lambda e: e <= value))
        part = F.slice(self._edges(), (block - 1) * BLOCK + 1, F.lit(BLOCK))
        inside = (block - 1) * BLOCK + F.size(F.filter(part, lambda e: e <= value))
        return F.when(value.isNull(), None).when(block == 0, 0).otherwise(inside).cast("int")

    def node(self, level: Column, at: Column) -> Column:
        return F.concat_ws(":", F.lit(self.name), level.cast("string"), at.cast("string"))

    def nodes(self, value: Column) -> Column:
        """All nodes that hold a value; null for null."""
        return _bound(self.cell(value), lambda c: F.when(c.isNotNull(), F.transform(
            F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: self.node(k, F.floor(c / F.pow(F.lit(2), k))))))

    def cover(self, low: Column, high: Column) -> Column:
        """A struct for the range of all values from ``low`` to ``high`` (null: without that bound): the nodes that it holds whole, the
        cells that it may hold in part, how many cells it touches, and whether it holds all of them."""
        last = len(self.edges)
        ends = F.struct(F.coalesce(self.cell(low), F.lit(0)).alias("a"), F.coalesce(self.cell(high), F.lit(last)).alias("b"))

        def made(x: Column) -> Column:
            a, b = x["a"], x["b"]
            from_start = low.isNull() | F.coalesce(F.get(self._edges(), a - 1) == low, F.lit(False))
            to_end = high.isNull() | F.coalesce(F.get(self._edges(), b) - 1 == high, F.lit(False))
            p, q = F.when(from_start, a).otherwise(a + 1), F.when(to_end, b + 1).otherwise(b)
            cells = F.array_distinct(F.array_compact(F.array(F.when(~from_start, a), F.when(~to_end, b))))
            return F.struct(
                _bound(F.struct(p.alias("p"), q.alias("q")), self._whole).alias("whole"),
                F.when(a <= b, F.transform(cells, lambda c: self.node(F.lit(0), c))).otherwise(F.array().cast("array<string>")).alias("parts"),
                (b - a + 1).alias("cells"), ((p == 0) & (q == last + 1)).alias("every"))

        return _bound(ends, made)

    def _whole(self, x: Column) -> Column:
        """Nodes of the cells from p up to, but not with, q: on each level what sticks out of the nodes above on either side."""
        def level(k: Column) -> Column:
            size = F.pow(F.lit(2), k)
            left, right = F.ceil(x["p"] / size), F.floor(x["q"] / size)
            found = F.array_compact(F.array(F.when(left % 2 == 1, self.node(k, left)), F.when(right % 2 == 1, self.node(k, right - 1))))
            return F.when(left < right, found).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), level))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def axes(rows: DataFrame, columns: list[str]) -> list[Axis]:
    """Axes of whole-number columns, from one pass; at most QUANTILES numbers for each column come to the driver."""
    shares = F.array(*(F.lit(k / QUANTILES) for k in range(QUANTILES)))
    found = rows.agg(*(F.percentile_approx(F.col(c).cast("long"), shares, 4 * QUANTILES).alias(c) for c in columns),
                     *(F.coalesce(F.bool_or(F.col(c).isNull()), F.lit(False)).alias(f"{c}_null") for c in columns)).first()
    made = []
    for c in columns:
        cuts = found[c] or []
        alone = [v + 1 for v, after in zip(cuts, cuts[1:]) if v == after and v < (1 << 63) - 1]
        made.append(Axis(c, tuple(sorted({*cuts, *alone})), found[f"{c}_null"]))
    return made
