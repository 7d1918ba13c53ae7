from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from playbill.operators import sampling
from playbill.operators.ranking import magnitude_cell, percent_ranks


def pool(spark, sizes):
    rows, i = [], 0
    for name, size in sizes.items():
        for _ in range(size):
            rows.append((i, name))
            i += 1
    return spark.createDataFrame(rows, "movie_id bigint, primary_genre string").repartition(4)


def largest_remainder(sizes, n):
    total = sum(sizes.values())
    seats = {g: n * c // total for g, c in sizes.items()}
    order = sorted(sizes, key=lambda g: (-(n * sizes[g] % total), g))
    for g in order[: n - sum(seats.values())]:
        seats[g] += 1
    return {g: s for g, s in seats.items() if s}


@pytest.mark.parametrize("sizes, n", [
    ({"a": 50, "b": 30, "c": 20}, 10),
    ({"a": 10, "b": 10, "c": 10}, 10),   # equal remainders
    ({"a": 95, "b": 4, "c": 1}, 5),      # strata without a seat
    ({"a": 3, "b": 2}, 20),              # more seats than rows
    ({f"s{i:02d}": i + 1 for i in range(40)}, 75),
])
def test_allocation(spark, sizes, n):
    got = {r.primary_genre: r.seats for r in sampling.allocate(pool(spark, sizes), "primary_genre", n).collect()}
    assert got == largest_remainder(sizes, n)
    assert sum(got.values()) == n


def drawn(sizes, n, seed):
    ids, i = {}, 0
    for name, size in sizes.items():
        ids[name] = range(i, i + size)
        i += size
    order = lambda m: (hashlib.md5(f"{seed}:{m}".encode()).hexdigest(), m)
    return {m for g, k in largest_remainder(sizes, n).items() for m in sorted(ids[g], key=order)[:k]}


def test_stratified_sample_is_exact(spark):
    sizes = {"hot": 3000, "warm": 500, "rare": 40, "tiny": 1}
    frame = pool(spark, sizes)
    for n in (3, 200, 2000):
        assert {r.movie_id for r in sampling.stratified_sample(frame, n, 42).collect()} == drawn(sizes, n, 42)
    whole = sampling.stratified_sample(frame, 5000, 42).collect()
    assert len(whole) == sum(sizes.values())


def test_large_shares_are_exact(spark):
    n = 2**62
    got = {r.primary_genre: r.seats for r in sampling.allocate(pool(spark, {"a": 3, "b": 1}), "primary_genre", n).collect()}
    assert got == {"a": 3 * 2**60, "b": 2**60}


def test_sample_does_not_depend_on_partitions(spark):
    frame = pool(spark, {"a": 70, "b": 30})
    one = sorted(r.movie_id for r in sampling.stratified_sample(frame.coalesce(1), 13, 1).collect())
    assert one == sorted(r.movie_id for r in sampling.stratified_sample(frame.repartition(8), 13, 1).collect())
    assert one != sorted(r.movie_id for r in sampling.stratified_sample(frame, 13, 2).collect())


def test_few_rows_ignore_strata(spark):
    frame = pool(spark, {f"g{i}": 3 for i in range(10)})
    order = sorted(range(30), key=lambda m: (hashlib.md5(f"42:{m}".encode()).hexdigest(), m))
    assert {r.movie_id for r in sampling.sample(frame, 4, 42).collect()} == set(order[:4])
    assert Counter(r.primary_genre for r in sampling.sample(frame, 10, 42).collect()) == Counter({f"g{i}": 1 for i in range(10)})
    assert sampling.simple_sample(frame, 99, 42).count() == 30


def test_percent_ranks_with_ties_and_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 else f"g{i % 7}", rng.choice([-5, 0, 7, rng.randrange(10**9)]), rng.random() * 10) for i in range(900)]
    rows += [(900, "single", 5, 1.0), (901, "g0", None, 2.0)]
    frame = spark.createDataFrame(rows, "movie_id bigint, g string, a bigint, b double")
    got = {r.movie_id: r for r in percent_ranks(frame, "movie_id", "g", ["a", "b"]).collect()}
    for column, at in (("a", 2), ("b", 3)):
        for row in rows:
            peers = [r[at] for r in rows if r[1] == row[1] and r[at] is not None]
            expected = None if row[at] is None else 0.0 if len(peers) == 1 else sum(p < row[at] for p in peers) / (len(peers) - 1)
            assert got[row[0]][f"{column}_rank"] == expected


def test_cells_are_monotone(spark):
    values = sorted([random.Random(1).uniform(-1e12, 1e12) for _ in range(500)] + [0.0, 1.0, 1.0001, 2.0, -1.0, 1e-9])
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    cells = [r[0] for r in rows.orderBy("i").select(magnitude_cell(F.col("v"))).collect()]
    assert cells == sorted(cells) and math.isfinite(cells[0])
