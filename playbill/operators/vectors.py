"""Similar items by embedding: an inverted-file index with multi-probe search and exact cosine on the candidates.

Vectors are brought to length one and equal ones become one entry with its smallest ids, so that copies cost nothing. Centroids are fitted on a sample of at
most SAMPLE entries, drawn from all by hash; every entry then goes to the cell of its nearest centroid, and the cells are stored. A query looks
into the cells whose centroids are nearest to it. Cells are put together to slabs of bounded numbers of entries; a query goes once to each slab with cells
of its choice, however many these are, and meets all entries of them. Slabs and bounded parts of their queries meet in one task each,
which passes on a query's best k only. No pair of vectors, nor of a query and a cell, ever becomes a row.

How many cells a query looks into is read off the data: for CALIBRATION entries, drawn by hash, the true neighbours are found among all entries, and
``probes`` is the least number of cells that holds TARGET of them. Vectors in clear groups need few cells, vectors without any many of them; with ``probes`` at the
number of centroids the search is exact. Work for each query grows with probes * entries / centroids."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from playbill.operators.ranking import top_per_key
from playbill.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = 10
SAMPLE, MOST_CENTROIDS, ROUNDS = 20_000, 4096, 12
CALIBRATION, TARGET = 200, 0.95
FOUND = "vec_id long, similar_id long, score double, cell int"
#: Entries and queries that meet at once.
ENTRY_BLOCK, QUERY_BLOCK = 20_000, 4_000
#: Cosines are compared to so many decimals; equal ones go by id.
DIGITS = 9


def unit(vectors: DataFrame) -> DataFrame:
    """(vec_id, unit) of the vectors that have a direction: no null, non-finite or missing component, not all zero, and of the commonest length."""
    x = F.col("embedding")
    good = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda n, c: n + c.cast("double") * c.cast("double")))
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & x.isNotNull() & good).withColumn("_size", size).where(F.col("_size") > 0)
    common = rows.groupBy(F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").first()
    rows = rows.where(F.size("embedding") == (common["n"] if common else 0))
    return rows.select("vec_id", F.transform(x, lambda c: c.cast("double") / F.col("_size")).alias("unit"))


def entries(units: DataFrame, k: int = K) -> DataFrame:
    """(h1, h2, unit, ids): equal vectors as one entry, with the k + 1 smallest of their ids (a query may be one of them)."""
    keyed = units.withColumns({"h1": F.xxhash64("unit"), "h2": F.xxhash64(F.lit(1), "unit")})
    least = top_per_key(keyed.select("h1", "h2", "vec_id").distinct(), ["h1", "h2"], [F.asc("vec_id")], k + 1)
    ids = least.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return keyed.groupBy("h1", "h2").agg(F.first("unit").alias("unit")).join(ids, ["h1", "h2"])


def _rows(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit_centroids(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of length one by Lloyd rounds; a cell that runs empty takes the row farthest from its centroid."""
    rng = np.random.default_rng(1)
    centroids = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        near = sample @ centroids.T
        cell, best = near.argmax(1), near.max(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, sample)
        empty = np.flatnonzero(np.bincount(cell, minlength=k) == 0)
        sums[empty] = sample[np.argsort(best, kind="stable")[:len(empty)]]
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, sums / np.maximum(length, 1e-300), centroids)
    return centroids


@dataclass
class Index:
    """``cells``: (cell, slab, h1, unit, ids), written; centroids by cell; the cells of each slab; how many cells a query looks into."""
    cells: DataFrame
    centroids: np.ndarray
    slabs: dict[int, np.ndarray]
    probes: int = 0


def build_index(vectors: DataFrame, k: int = K, target: float = TARGET) -> Index:
    """The index of every vector. The number of centroids is four times the root of that of the entries, up to MOST_CENTROIDS."""
    rows = written(entries(unit(vectors), k), "vector-entries")
    n = rows.count()
    if not n:
        return Index(rows.select(F.lit(0).alias("cell"), F.lit(0).alias("slab"), "h1", "unit", "ids"), np.zeros((0, 0)), {})
    share = int((1 << 30) * min(1.0, SAMPLE / n))
    drawn = rows.where(F.pmod("h2", F.lit(1 << 30)) < share).select("unit").toArrow()
    sample = _rows(drawn.column("unit")) if len(drawn) else _rows(rows.limit(1).toArrow().column("unit"))
    centroids = fit_centroids(sample, min(len(sample), MOST_CENTROIDS, int(4 * n ** 0.5) + 1))

    def place(batches):
        for batch in batches:
            cell = np.concatenate([(part @ centroids.T).argmax(1) for part in np.array_split(_rows(batch.column("unit")), 1 + batch.num_rows // 2000)])
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *batch.columns], names=["cell", *batch.schema.names])

    placed = written(rows.mapInArrow(place, "cell int, h1 long, h2 long, unit array<double>, ids array<long>"), "vector-placed")
    blocks = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ENTRY_BLOCK).alias("blocks"))
    cells = placed.join(blocks, "cell").withColumn("block", F.pmod("h2", "blocks").cast("int"))
    # At most MOST_CENTROIDS cells, the largest in blocks: a slab is a run of them with ENTRY_BLOCK entries, and at most as many again by its last block.
    sizes = cells.groupBy("cell", "block").agg(F.count(F.lit(1)).alias("n")).orderBy("cell", "block").toPandas()
    slab = ((sizes["n"].cumsum() - sizes["n"]) // ENTRY_BLOCK).astype("int32")
    runs = rows.sparkSession.createDataFrame(sizes.assign(slab=slab)[["cell", "block", "slab"]], "cell int, block int, slab int")
    slabs = {int(s): np.unique(part.to_numpy()) for s, part in sizes["cell"].groupby(slab)}
    index = Index(written(cells.join(runs, ["cell", "block"]).select("cell", "slab", "h1", "unit", "ids"), "vector-cells"), centroids, slabs)
    drawn = index.cells.where(F.pmod("h1", F.lit(1 << 30)) < int((1 << 30) * min(1.0, CALIBRATION / n))).select(F.get("ids", F.lit(0)).alias("vec_id"), "unit")
    index.probes = calibrated(index, drawn, k, target)
    return index


def calibrated(index: Index, units: DataFrame, k: int, target: float) -> int:
    """The least number of cells, in the order of each query, that holds the share ``target`` of the true neighbours of all of ``units`` (bounded)."""
    asked = {r["vec_id"]: np.argsort(-(index.centroids @ np.array(r["unit"])), kind="stable").tolist() for r in units.collect()}
    places = sorted(asked[r["vec_id"]].index(r["cell"]) for r in _neighbours(index, units, k, len(index.centroids)).collect())
    return 1 + places[min(len(places) - 1, int(target * len(places)))] if places else 1


def similar(index: Index, queries: DataFrame, k: int = K, probes: int | None = None) -> DataFrame:
    """(vec_id, rank, similar_id, score): for each query (vec_id, embedding) the ``k`` others of highest cosine among the probed cells; ties by id."""
    found = _neighbours(index, unit(queries).dropDuplicates(["vec_id"]), k, index.probes if probes is None else probes)
    return found.select("vec_id", F.col("rank").cast("int").alias("rank"), "similar_id", "score")


def _neighbours(index: Index, asked: DataFrame, k: int, probes: int) -> DataFrame:
    """(vec_id, similar_id, score, cell, rank) of the queries (vec_id, unit)."""
    centroids, slabs, probes = index.centroids, index.slabs, min(probes, len(index.centroids))

    def probe(batches):
        for batch in batches:
            near = _rows(batch.column("unit")) @ centroids.T
            chosen = np.zeros(near.shape, bool)
            np.put_along_axis(chosen, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
            for slab, its in slabs.items():
                there = chosen[:, its]
                asks = there.any(1)
                if asks.any():
                    query, cell = np.nonzero(there[asks])
                    ends = np.searchsorted(query, np.arange(int(asks.sum()) + 1)).astype(np.int32)
                    part = batch.filter(pa.array(asks))
                    columns = [*part.columns, pa.array(np.full(part.num_rows, slab, np.int32)), pa.ListArray.from_arrays(ends, its[cell].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "slab", "cells"])

    if not len(centroids):
        return asked.sparkSession.createDataFrame([], f"{FOUND}, rank int")
    looked = written(asked.mapInArrow(probe, "vec_id long, unit array<double>, slab int, cells array<int>"), "vector-queries")
    # The queries of a slab are parted, each part meeting its own copy of the slab's entries.
    parts = looked.groupBy("slab").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int")).toDF("slab", "parts")
    left = looked.join(parts, "slab").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int")).drop("parts")
    right = index.cells.join(parts, "slab").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def table(rows: list[tuple]) -> pa.Table:
        kinds = {"vec_id": pa.int64(), "similar_id": pa.int64(), "score": pa.float64(), "cell": pa.int32()}
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(kinds.items())})

    def best(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        if not len(ours) or not len(theirs):
            return table([])
        q, e = _rows(ours.column("unit")), _rows(theirs.column("unit"))
        ids, mine, asked_cells = theirs.column("ids").to_pylist(), ours.column("vec_id").to_pylist(), ours.column("cells").combine_chunks()
        first = np.array([i[0] for i in ids])
        kinds, of = np.unique(theirs.column("cell").to_numpy(), return_inverse=True)
        by_cell = np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of))[:-1])
        out: list[tuple] = []
        for at in range(0, len(q), 256):
            chosen = [np.flatnonzero(np.isin(kinds, asked_cells[row].values.to_numpy())) for row in range(at, min(at + 256, len(q)))]
            # Queries into many cells of the slab meet all its entries at once, and those of other cells are left out.
            dense = sum(map(len, chosen)) * 8 >= len(chosen) * len(kinds)
            block = np.round(q[at:at + 256] @ e.T, DIGITS) if dense else None
            for row, its in enumerate(chosen):
                if not len(its):
                    continue
                places = None if len(its) == len(kinds) else np.concatenate([by_cell[c] for c in its])
                if dense:
                    s = block[row] if places is None else block[row][places]
                else:
                    s = np.round(e[places] @ q[at + row] if places is not None else e @ q[at + row], DIGITS)
                lead = first if places is None else first[places]
                # k + 1 entries hold k + 1 ids at least, the query's own among them or not.
                order = np.lexsort((lead, -s))[:k + 1] if len(s) <= 4 * k else _leading(s, lead, k + 1)
                entry = order if places is None else places[order]
                found = sorted((-s[j], i, kinds[of[x]]) for j, x in zip(order, entry) for i in ids[x] if i != mine[at + row])[:k]
                out += [(mine[at + row], i, -c, cell) for c, i, cell in found]
        return table(out)

    keys = ["slab", "part"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, FOUND)
    return top_per_key(met, ["vec_id"], [F.desc("score"), F.asc("similar_id")], k)


def _leading(scores: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; of equal ones those of the smallest first id."""
    cut = np.partition(scores, len(scores) - k)[len(scores) - k]
    near = np.flatnonzero(scores >= cut)
    return near[np.lexsort((first[near], -scores[near]))[:k]]


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true neighbours (vec_id, similar_id) that were found."""
    both = truth.join(found.select("vec_id", "similar_id"), ["vec_id", "similar_id"], "left_semi").count()
    return both / max(1, truth.count())
