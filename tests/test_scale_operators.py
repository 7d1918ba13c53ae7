"""Operators that must stay distributed on hot keys and large value ranges: vector search, heavy-key joins, order statistics."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from playbill.operators import baseline, breaks, heavy_keys, profile_report, quantiles, rules, vectors
from playbill.sources.layout import along_curve

VECTORS = "vec_id long, embedding array<float>"


def neighbours_by_hand(rows, k=10):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    good = [(i, v / np.linalg.norm(v)) for i, v in good]
    asked = {i: v for i, v in good if i % 20 == 0}
    return {i: [j for _, j in sorted({(-round(float(v @ w), 9), j) for j, w in good if j != i})[:k]] for i, v in asked.items()}


def vector_rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.3 * rng.normal(size=8)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(400)]  # copies of one vector
    return rows + [(2000, None), (2020, [float("nan")] * 8), (2040, [0.0] * 8), (2060, [1.0] * 3), (None, [1.0] * 8), (2080, [None] * 8)]


@pytest.mark.parametrize("blocks", [(20_000, 4_000), (40, 3)])
def test_similar_vectors(spark, monkeypatch, blocks):
    monkeypatch.setattr(vectors, "ENTRY_BLOCK", blocks[0])
    monkeypatch.setattr(vectors, "QUERY_BLOCK", blocks[1])
    rows = vector_rows()
    frame = spark.createDataFrame(rows, VECTORS).withColumn("cell", F.lit("kept"))
    index = vectors.build_index(frame)
    queries = frame.where("vec_id % 20 = 0")
    truth = neighbours_by_hand(rows)
    exact = {}
    for r in vectors.similar(index, queries, probes=10 ** 9).orderBy("vec_id", "rank").collect():
        exact.setdefault(r.vec_id, []).append(r.similar_id)
    assert exact == truth
    found = {(r.vec_id, r.similar_id) for r in vectors.similar(index, queries).collect()}
    assert index.probes < len(index.centroids) / 2
    assert sum((i, j) in found for i, near in truth.items() for j in near) >= 0.9 * sum(map(len, truth.values()))


def test_queries_go_once_to_a_slab(spark, monkeypatch):
    """Whatever the number of cells that a query looks into, it meets each slab of bounded size as one row."""
    monkeypatch.setattr(vectors, "ENTRY_BLOCK", 100)
    frame = spark.createDataFrame(vector_rows(), VECTORS)
    index = vectors.build_index(frame)
    sizes = [r["count"] for r in index.cells.groupBy("slab").count().collect()]
    assert len(index.centroids) > 4 * len(sizes) and max(sizes) <= 200 and sum(sizes) == 600
    kept = []
    monkeypatch.setattr(vectors, "written", lambda rows, name, write=vectors.written: kept.append(write(rows, name)) or kept[-1])
    found = vectors.similar(index, frame.where("vec_id % 20 = 0"), probes=10 ** 9)
    assert kept[-1].groupBy("vec_id").count().where(F.col("count") > len(sizes)).isEmpty()
    assert "explode(cells" not in found._jdf.queryExecution().toString()


def test_no_vectors(spark):
    frame = spark.createDataFrame([(1, None)], VECTORS)
    assert vectors.similar(vectors.build_index(frame), frame).collect() == []


def test_recall_on_the_given_vectors(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index, queries = vectors.build_index(frame), frame.where("vec_id % 20 = 0")
    assert vectors.recall(vectors.similar(index, queries), vectors.similar(index, queries, probes=10 ** 9)) >= 0.9


def test_heavy_keys_are_exact(spark):
    rng = random.Random(1)
    words = ["the"] * 3000 + ["of"] * 900 + [f"w{rng.randrange(5000)}" for _ in range(6000)] + [None] * 500
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    assert sorted(heavy_keys.heavy_keys(rows, "word", 0.05, 10)) == ["of", "the"]
    assert heavy_keys.heavy_keys(rows, "word", 0.05, 2000) == ["the"] and heavy_keys.heavy_keys(rows, "word") == [] == heavy_keys.heavy_keys(rows.limit(0), "word")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join_equals_a_join(spark, how):
    rng = random.Random(2)
    left = spark.createDataFrame([(rng.choice(["a", "a", "a", "b", "c", "d", None]), i) for i in range(500)], "k string, i int")
    right = spark.createDataFrame([("a", 1), ("c", 2), ("x", 3), (None, 4)], "k string, v int")
    split = heavy_keys.split_join(left, right, "k", ["a", "b"], how)
    assert sorted(map(str, split.collect())) == sorted(map(str, left.join(right, "k", how).collect()))
    with pytest.raises(ValueError):
        heavy_keys.split_join(left, right, "k", ["a"], "full")


def test_a_word_of_every_text_is_not_shuffled(spark, monkeypatch):
    for module in (heavy_keys, rules):
        monkeypatch.setattr(module, "LEAST_ROWS", 100)
    monkeypatch.setattr(rules, "heavy_keys", lambda rows, key: heavy_keys.heavy_keys(rows, key, heavy_keys.SHARE, 100))
    rng = random.Random(4)
    texts = [(i, f"everywhere {' '.join(f'word{rng.randrange(3000)}x' for _ in range(4))} {'good' if i % 3 else 'bad bad'}".replace("0", "o").replace("1", "l"), []) for i in range(900)]
    pool = spark.createDataFrame(texts, "movie_id long, overview string, genre_keys array<string>")
    lexicon = spark.createDataFrame([("good", 1), ("bad", -1), ("everywhere", 0)], "word string, weight int")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for frame in (rules.sentiments_from_lexicon(pool, lexicon), rules.themes(pool)):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "everywhere" in plan
        tones = {r.movie_id: r.overview_sentiment for r in rules.sentiments_from_lexicon(pool, lexicon).collect()}
        assert all(tones[i] == ("positive" if i % 3 else "negative") for i, *_ in texts)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.parametrize("kind", ["continuous", "narrow", "tied", "wide", "few", "one"])
def test_exact_percentiles(spark, kind):
    rng = np.random.default_rng(5)
    values = {"continuous": rng.normal(size=200_000), "narrow": 1.7e9 + rng.random(50_000) * 1e-3, "tied": np.repeat([3.0, 0.0, -7.5], [40_000, 30_000, 20_000]),
              "wide": np.concatenate((10.0 ** rng.uniform(-300, 300, 30_000), -(10.0 ** rng.uniform(-300, 300, 30_000)))), "few": np.array([2.0, 1.0, 9.0]), "one": np.array([4.5])}[kind]
    frame = spark.createDataFrame([(float(v),) for v in [*values, float("nan"), float("inf")]] + [(None,)], "x double")
    shares = (0.0, 0.25, 0.5, 0.9, 0.999, 1.0)
    row = profile_report.describe(frame, "x", shares).first()
    assert row["count"] == len(values) and row["min"] == values.min() and row["max"] == values.max()
    for share in shares:
        assert row[f"p{round(share * 100)}"] == pytest.approx(np.quantile(values, share), rel=1e-9) or round(share * 100) == 100


def test_percentiles_of_a_million_distinct_values(spark):
    frame = spark.range(1_000_000).select((F.pmod(F.col("id") * 7919, F.lit(1_000_003)) / 7).alias("x"))
    values = np.sort((np.arange(1_000_000) * 7919 % 1_000_003) / 7)
    described = profile_report.describe(frame, "x", (0.5, 0.9))
    assert "Percentile" not in described._jdf.queryExecution().executedPlan().toString()
    assert [described.first()[c] for c in ("p50", "p90")] == pytest.approx(np.quantile(values, [0.5, 0.9]).tolist(), rel=1e-12)
    assert profile_report.describe(frame.limit(0), "x", (0.5,)).first()["p50"] is None
    assert quantiles.values_at(frame, "x", [0, 999_999]) == {0: values[0], 999_999: values[-1]}


def scanned(frame) -> int:
    """Rows that the scan below a filter passed on after it skipped row groups."""
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_bounds_skip_row_groups_along_the_curve(spark, tmp_path):
    rng = random.Random(6)
    rows = spark.createDataFrame([(i, rng.choice([None, *range(1950, 2020)]), rng.choice([0, rng.randrange(10 ** 8)]), rng.randrange(300), "Released") for i in range(20_000)],
                                 "movie_id long, filter_year int, budget long, runtime int, status string")
    along_curve(rows, 64).write.parquet(f"{tmp_path}/curve")
    rows.repartition(64, "movie_id").write.parquet(f"{tmp_path}/hashed")
    curve, hashed = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("curve", "hashed"))
    assert sorted(map(str, curve.collect())) == sorted(map(str, rows.collect()))
    # 64 ranges cut each of three axes four times, so a bound on one of them leaves about a quarter, and what lies across its edge.
    for bound in ("filter_year between 1960 and 1965", "budget > 90000000", "runtime < 20", "filter_year > 2010 and budget between 1000000 and 20000000"):
        assert scanned(hashed.where(bound)) == 20_000
        few = scanned(curve.where(bound))
        assert 0 < few <= 20_000 / 2 and few >= hashed.where(bound).count(), (bound, few)
    assert scanned(curve.where("filter_year > 2010 and budget between 1000000 and 20000000")) <= 20_000 / 5


def test_effects(spark, monkeypatch):
    rng = np.random.default_rng(8)
    user, item = rng.normal(0, 0.4, 60), rng.normal(0, 0.6, 40)
    rows = [(int(u), int(m), float(np.clip(3 + user[u] + item[m], 0.5, 5))) for u, m in zip(rng.integers(0, 60, 4000), rng.integers(0, 40, 4000))]
    frame = spark.createDataFrame([*rows, (None, 1, 5.0), (1, 2, None)], "user_id long, movie_id long, rating double")
    mean, items, users = baseline.fit_effects(frame)
    assert mean == pytest.approx(np.mean([r for *_, r in rows]))
    asked = spark.createDataFrame([*rows, (999, 1, 3.0), (1, 999, 3.0), (None, None, 3.0)], "user_id long, movie_id long, actual double")
    effects = baseline.errors("effects", baseline.predict_effects(asked, mean, items, users)).first()
    plain = baseline.errors("mean", asked.withColumn("predicted_rating", F.lit(mean))).first()
    assert effects.n == 4003 and effects.rmse < 0.25 < plain.rmse
    monkeypatch.setattr(baseline, "heavy_keys", lambda rows, key: [1, 2, 3])  # split joins give the same effects
    again = {r.movie_id: r.item_effect for r in baseline.fit_effects(frame)[1].collect()}
    assert again == pytest.approx({r.movie_id: r.item_effect for r in items.collect()})
    mean, items, users = baseline.fit_effects(frame.limit(0))
    assert mean is None and baseline.predict_effects(asked, mean, items, users).where("predicted_rating is not null").isEmpty()


def test_breaks_by_hand():
    rng = random.Random(12)
    for _ in range(60):
        values = sorted(rng.choice([rng.randrange(5), rng.randrange(40), rng.randrange(200, 210)]) for _ in range(rng.randint(1, 40)))
        cells, counts = np.unique(values, return_counts=True)
        medium, high = breaks.two_breaks(cells, counts)
        spread = lambda v: sum((x - sum(v) / len(v)) ** 2 for x in v)
        classes = lambda a, b: ([v for v in values if v < a], [v for v in values if a <= v < b], [v for v in values if v >= b])
        if len(cells) < 3:
            assert [len(set(c)) for c in classes(medium, high)] == ([0, 1, 0] if len(cells) == 1 else [1, 0, 1])
            continue
        least = min(sum(map(spread, classes(a, b))) for a, b in itertools.combinations(cells[1:], 2))
        assert sum(map(spread, classes(medium, high))) == pytest.approx(least, abs=1e-6)


def test_natural_tiers(spark):
    amounts = [10, 12, 11, 1000, 1100, 900, 10 ** 9, 2 * 10 ** 9]
    rows = [(i, "Drama", a, 5) for i, a in enumerate(amounts)] + [(50, "Drama", 0, None), (51, None, 7, 9), (52, "War", 1 << 62, 3), (53, "War", 3, 3)]
    got = {r.movie_id: (r.budget_tier, r.revenue_tier) for r in breaks.tiers_by_breaks(spark.createDataFrame(rows, "movie_id long, g string, budget long, revenue long"), "movie_id", "g", ["budget", "revenue"]).collect()}
    assert [got[i][0] for i in range(8)] == ["low"] * 3 + ["medium"] * 3 + ["high"] * 2 and {got[i][1] for i in range(8)} == {"medium"}
    assert got[50] == (None, None) and got[51] == ("medium", "medium") and (got[52][0], got[53][0]) == ("high", "low")
    cells = spark.createDataFrame([(1 << k,) for k in range(63)] + [((1 << 63) - 1,), (0,), (15,), (17,), (31,), (32,), (33,)], "a long").select("a", breaks.amount_cell(F.col("a")).alias("c")).orderBy("a").collect()
    known = [r.c for r in cells if r.a > 0]
    assert cells[0].c is None and known == sorted(known)
    assert {r.a: r.c for r in cells if r.a in (1, 15, 16, 31, 32, 33)} == {1: 1, 15: 15, 16: 16, 31: 31, 32: 32, 33: 32}
