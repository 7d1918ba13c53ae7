from __future__ import annotations

import json
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from frames import catalog, enriched, movie, ratings, rich
from playbill.contracts import ENRICHED_FIELDS, Field
from playbill.operators import inference
from playbill.operators.inference import run_inference
from playbill.operators.rules import enrich_by_rules, sentiments_from_lexicon, themes
from playbill.plans import enrichment, evaluation, prompts
from playbill.sources.sinks import append_enriched
from playbill.sources.tables import duplicate_keys, enriched_table, prepare_catalog, scan_enriched
from playbill.sources.versions import StaleVersion

EXAMPLE = (Field("seats", "int", required=True), Field("town", "text", required=True))


def answers(texts, **more):
    blocks = [[{"text": t, "reasoning": None}] for t in texts]
    return pd.DataFrame({"content": blocks, "input_tokens": 10, "output_tokens": 5} | more)


def ask(spark, replies, **options):
    """Run one prompt per list of replies; the n-th reply answers the n-th attempt."""
    asked = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(replies)], "movie_id bigint, prompt string")

    def scorer(batch, attempt):
        return answers([json.loads(p)[attempt] for p in batch])

    return {r.movie_id: r for r in run_inference(asked, scorer, EXAMPLE, "m", **options).collect()}


def test_parse_retry_and_give_up(spark):
    good = '{"seats": 40, "town": "Ulm"}'
    got = ask(spark, [
        [good, "", ""],
        ["forty seats in Ulm", good, ""],
        ['{"seats": [3], "town": "Linz"}', '{"seats": 12, "town": "Graz"}', ""],
        ["```json\n" + good + "\n```", "", ""],
        ["<seats>", "town: Ulm", "40"],
    ])
    assert [got[i].status for i in range(5)] == ["ok", "ok", "ok", "ok", "invalid"]
    assert [got[i].attempts for i in range(5)] == [1, 2, 2, 1, 3]
    assert [got[i].seats for i in range(5)] == [40, 40, 12, 40, None]
    assert (got[0].input_tokens, got[1].input_tokens, got[4].output_tokens) == (10, 20, 15)  # every attempt counts
    assert got[4].reject_reason == "not a JSON object" and got[0].model == "m"


def test_retries_can_be_turned_off(spark):
    assert ask(spark, [["no"]], retries=0)[0].attempts == 1


def test_reasoning_blocks_are_skipped(spark):
    asked = spark.createDataFrame([(1, "p")], "movie_id bigint, prompt string")

    def scorer(batch, attempt):
        return pd.DataFrame({"content": [[{"text": None, "reasoning": "hm"}, {"text": '{"seats": 9, "town": "Bern"}', "reasoning": None}]], "input_tokens": 1, "output_tokens": 1})

    assert run_inference(asked, scorer, EXAMPLE, "m").first().seats == 9


def test_only_failing_rows_are_errors(spark):
    """A call with one bad prompt fails as a whole; it is repeated in halves until only the bad rows are left."""
    asked = spark.createDataFrame([(i, f"p{i}") for i in range(100)] * 2, "movie_id bigint, prompt string")

    def picky(batch, attempt):
        if any(p in ("p13", "p77") for p in batch):
            raise ValueError("cannot read this")
        return answers(['{"seats": 1, "town": "a"}'] * len(batch))

    got = {r.movie_id: (r.status, r.attempts) for r in run_inference(asked, picky, EXAMPLE, "m", partitions=2).collect()}
    assert got == {i: ("error" if i in (13, 77) else "ok", 1) for i in range(100)}


def test_refusal_ends_the_run_and_errors_do_not(spark):
    asked = spark.createDataFrame([(1, "p")], "movie_id bigint, prompt string")

    def refuse(batch, attempt):
        raise PermissionError("no access to this model")

    def fail(batch, attempt):
        raise TimeoutError("slow")

    with pytest.raises(PermissionError, match="no access"):
        run_inference(asked, refuse, EXAMPLE, "m")
    row = run_inference(asked, fail, EXAMPLE, "m").first()
    assert row.status == "error" and row.attempts == 1 and "slow" in row.reject_reason


def test_written_answers_are_not_asked_again(spark, tmp_path):
    asked = spark.createDataFrame([(i, "p") for i in range(6)], "movie_id bigint, prompt string").repartition(3)
    calls = str(tmp_path / "calls")

    def scorer(batch, attempt):
        import os

        os.makedirs(calls, exist_ok=True)
        for _ in range(len(batch)):
            open(os.path.join(calls, uuid.uuid4().hex), "w").close()
        return answers(['{"seats": 1, "town": "a"}'] * len(batch))

    run = str(tmp_path / "run")
    first = run_inference(asked.filter("movie_id < 4"), scorer, EXAMPLE, "m", run_dir=run)
    assert first.count() == first.filter("status = 'ok'").count() == 4
    assert len(list((tmp_path / "calls").iterdir())) == 4  # two actions, one call per row
    assert run_inference(asked, scorer, EXAMPLE, "m", run_dir=run).count() == 6
    assert len(list((tmp_path / "calls").iterdir())) == 6
    fewer = run_inference(asked.filter("movie_id = 2"), scorer, EXAMPLE, "m", run_dir=run)
    assert [r.movie_id for r in fewer.collect()] == [2] and len(list((tmp_path / "calls").iterdir())) == 6


def test_a_killed_run_repeats_one_part(spark, tmp_path):
    asked = spark.createDataFrame([(i, f"p{i}") for i in range(120)], "movie_id bigint, prompt string")
    calls, kill = tmp_path / "calls", tmp_path / "kill"
    calls.mkdir()
    kill.touch()

    def scorer(batch, attempt):
        import os

        for prompt in batch:
            if prompt == "p77" and kill.exists():
                os._exit(1)
            open(os.path.join(calls, f"{prompt}-{uuid.uuid4().hex}"), "w").close()
        return answers(['{"seats": 1, "town": "a"}'] * len(batch))

    options = {"run_dir": str(tmp_path / "run"), "partitions": 2, "rows_per_task": 5}
    with pytest.raises(Exception, match="exited unexpectedly|crashed"):
        run_inference(asked, scorer, EXAMPLE, "m", **options)
    before = len(list(calls.iterdir()))
    kill.unlink()
    got = run_inference(asked, scorer, EXAMPLE, "m", **options)
    assert got.filter("status = 'ok'").count() == 120
    made = [p.name.partition("-")[0] for p in calls.iterdir()]
    assert len(set(made)) == 120 and 0 < before < 120
    assert len(made) - 120 <= 25  # a part holds 10 rows on average; the hash deals unevenly


def test_a_part_reads_its_own_prompts(spark, monkeypatch):
    """The prompts of a round lie in a folder for each part, so the parts together read each prompt once; a key given twice is asked once."""
    kept = []
    monkeypatch.setattr(inference, "written", lambda *a, write=inference.written, **k: kept.append(write(*a, **k)) or kept[-1])
    asked = spark.createDataFrame([(i % 60, f"p{i % 60}") for i in range(70)], "movie_id bigint, prompt string")
    got = run_inference(asked, lambda batch, attempt: answers(['{"seats": 1, "town": "a"}'] * len(batch)), EXAMPLE, "m", partitions=2, rows_per_task=5)
    assert {r.movie_id: r.status for r in got.collect()} == dict.fromkeys(range(60), "ok")
    prompts, = kept
    files = [prompts.where(F.col("part") == part).select("key", F.input_file_name().alias("file")).collect() for part in range(6)]
    assert sum(map(len, files)) == 60 and all(f"/part={part}/" in r.file for part, rows in enumerate(files) for r in rows)
    assert "PartitionFilters: [isnotnull(part" in prompts.where("part = 1")._jdf.queryExecution().toString()


def test_a_refused_run_can_be_resumed(spark, tmp_path):
    asked = spark.createDataFrame([(i, "p") for i in range(4)], "movie_id bigint, prompt string")
    run = str(tmp_path / "run")

    def refuse(batch, attempt):
        raise PermissionError("no access")

    def fail(batch, attempt):
        raise TimeoutError("slow")

    def reply(batch, attempt):
        return answers(['{"seats": 1, "town": "a"}'] * len(batch))

    with pytest.raises(PermissionError):
        run_inference(asked, refuse, EXAMPLE, "m", run_dir=run)
    assert {r.status for r in run_inference(asked, fail, EXAMPLE, "m", run_dir=run).collect()} == {"error"}
    got = run_inference(asked, reply, EXAMPLE, "m", run_dir=run).collect()
    assert [(r.movie_id, r.status, r.attempts) for r in sorted(got)] == [(i, "ok", 1) for i in range(4)]


def test_cache_is_used_and_kept(spark, tmp_path):
    path = str(tmp_path / "enriched")
    append_enriched(enriched(spark, [rich(1), rich(9)]), path)
    movies = spark.createDataFrame([(1,), (2,), (3,)], "movie_id bigint")
    seen = []

    def enrich(pool):
        ids = sorted(r.movie_id for r in pool.collect())
        seen.append(ids)
        return enriched(spark, [rich(i, themes=("one",) if i == 3 else ("a", "b", "c")) for i in ids] or [])

    got = sorted(r.movie_id for r in enrichment.enrich_incremental(movies, path, enrich).collect())
    assert seen == [[2, 3]] and got == [1, 2]  # 3 is invalid and stays out
    assert {r.movie_id for r in scan_enriched(spark, path).collect()} == {1, 2, 9}  # 9 was not requested and stays
    enrichment.enrich_incremental(movies.filter("movie_id < 3"), path, enrich)
    assert seen[1] == []


def test_two_writers(spark, tmp_path):
    """Both read the same version; the later one fails cleanly, or takes what is still missing when it enriches."""
    path = str(tmp_path / "enriched")
    append_enriched(enriched(spark, [rich(1)]), path)
    table = enriched_table(spark, path)
    at = table.manifest()
    assert (at.version, at.appends) == (0, ["."])
    first = table.append(enriched(spark, [rich(2), rich(3)]), at)
    with pytest.raises(StaleVersion):
        table.append(enriched(spark, [rich(4)]), at)
    assert table.manifest() == first and {r.movie_id for r in table.read().collect()} == {1, 2, 3}
    assert {r.movie_id for r in table.read(at).collect()} == {1}  # a reader of the older version is not disturbed
    for bad in ([rich(5), rich(5)], [rich(2)], [rich(1), rich(6)]):
        with pytest.raises(ValueError):
            table.append(enriched(spark, bad), first)
    assert table.append(enriched(spark, []), first) == first

    def interrupted(pool):
        now = table.manifest()
        if now == first:
            table.append(enriched(spark, [rich(7, score=1), rich(8, score=1)]), now)
        return enriched(spark, [rich(r.movie_id, score=9) for r in pool.collect()])

    movies = spark.createDataFrame([(i,) for i in (1, 7, 8, 9)], "movie_id bigint")
    got = {r.movie_id: r.production_effectiveness_score for r in enrichment.enrich_incremental(movies, path, interrupted).collect()}
    assert got == {1: 5, 7: 1, 8: 1, 9: 9} and table.manifest().version == 3
    assert {r.movie_id for r in scan_enriched(spark, path).collect()} == {1, 2, 3, 7, 8, 9}


def test_lookups_do_not_shuffle_the_base(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "enriched")
    table = enriched_table(spark, path)
    at = table.append(enriched(spark, [rich(i) for i in range(200)]), table.manifest())
    at = table.compact(4, table.append(enriched(spark, [rich(i) for i in range(200, 300)]), at))
    assert (at.version, at.buckets, at.appends) == (3, 4, [])
    at = table.append(enriched(spark, [rich(300)]), at)
    again = table.compact(4, at)
    requested = spark.createDataFrame([(i,) for i in (5, 250, 300, 301)], "movie_id bigint")
    assert [r.movie_id for r in table.missing(requested, again).collect()] == [301]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for frame in (table.missing(requested, again), table.found(requested, again)):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert sorted(r.movie_id for r in table.found(requested, at).collect()) == [5, 250, 300]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    monkeypatch.setattr(enrichment, "MOST_APPENDS", 1)
    for i in (400, 401, 402):
        enrichment.enrich_incremental(spark.createDataFrame([(i,)], "movie_id bigint"), path, lambda pool: enriched(spark, [rich(r.movie_id) for r in pool.collect()]))
    assert len(table.manifest().appends) <= 1 and table.read().count() == 304


def test_first_enrichment_with_a_scorer(spark, tmp_path):
    movies = catalog(spark, [movie(1), movie(2, budget=0), movie(3, overview=""), movie(4)])
    pool = enrichment.rated_pool(movies, ratings(spark, [(1, 1, 4, 1), (2, 1, 3, 1)]))
    assert sorted(r.movie_id for r in pool.collect()) == [1, 4]
    reply = json.dumps({"overview_sentiment": "neutral", "budget_tier": "low", "revenue_tier": "low", "production_effectiveness_score": 6, "themes": ["a", "b", "c"]})

    def scorer(batch, attempt):
        return answers([reply if "Title: T1" in p else "no" for p in batch])

    step = enrichment.scorer_enrichment(scorer, "m", retries=1)
    got = enrichment.enrich_incremental(pool, str(tmp_path / "new"), step).collect()
    assert [(r.movie_id, r.title, r.input_tokens, r.model) for r in got] == [(1, "T1", 10, "m")]


def test_prompt(spark):
    pool = enrichment.rated_pool(catalog(spark, [movie(1, title="A", budget=1000, revenue=1500, genres="[]")]), ratings(spark, [(1, 1, 4, 1)]))
    assert prompts.enrichment_prompts(pool).first().prompt.startswith(
        "Title: A\nOverview: a text\nGenres: []\nBudget: $1,000\nRevenue: $1,500\nROI: 1.5x\nRuntime: 90 min\nUser ratings: 4.00 avg across 1 user ratings\n\n")


def test_missing_source_fails_early(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scan_enriched(spark, str(tmp_path / "nothing"))


def test_duplicate_keys(spark):
    assert [r.movie_id for r in duplicate_keys(catalog(spark, [movie(1), movie(1), movie(2)]), "movie_id").collect()] == [1]


def test_themes_leave_out_genres_and_common_words(spark):
    texts = {1: "Heist heist Bank drama every", 2: "every garden Garden quiet", 3: "every Storm harbour"}
    pool = prepare_catalog(catalog(spark, [movie(i, overview=t, genres="Drama") for i, t in texts.items()]))
    got = {r.movie_id: r.themes for r in themes(pool).collect()}
    assert got == {1: ["heist", "bank", "every"], 2: ["garden", "quiet", "every"], 3: ["harbour", "storm", "every"]}
    part = themes(pool.filter("movie_id = 1"), pool).collect()
    assert [(r.movie_id, r.themes) for r in part] == [(1, got[1])]


def test_rules(spark):
    pool = prepare_catalog(catalog(spark, [movie(i, budget=10 * i, revenue=1000 - i, overview="alpha beta gamma") for i in range(1, 5)]))
    stats = spark.createDataFrame([(1, 5.0)], "movie_id bigint, avg_rating double")
    tones = spark.createDataFrame([(1, "negative")], "movie_id bigint, overview_sentiment string")
    got = {r.movie_id: r for r in enrich_by_rules(pool, stats, tones).collect()}
    assert [got[i].budget_tier for i in range(1, 5)] == ["low", "medium", "high", "high"]
    assert [got[i].revenue_tier for i in range(1, 5)] == ["high", "high", "medium", "low"]
    assert got[1].production_effectiveness_score == 10 and got[4].production_effectiveness_score == 2
    assert got[1].overview_sentiment == "negative" and got[2].overview_sentiment == "neutral"
    assert got[1].input_tokens == 3 and got[1].output_tokens == 7


def test_run_drift(spark):
    a = enriched(spark, [rich(1), rich(2), rich(3, sentiment=None)])
    b = enriched(spark, [rich(1), rich(2, score=6, themes=("a", "b", "d")), rich(3)])
    got = {r.field: (r.n_drift, r.n_compared) for r in evaluation.run_drift(a, b).collect()}
    assert got == {"overview_sentiment": (1, 3), "budget_tier": (0, 3), "revenue_tier": (0, 3), "production_effectiveness_score": (1, 3),
                   "themes": (1, 3), "all_categorical": (2, 12)}
    rows = {(r.movie_id, r.field): (r.before, r.after) for r in evaluation.drift_rows(a, b).collect()}
    assert rows == {(2, "production_effectiveness_score"): ("5", "6"), (2, "themes"): ("a, b, c", "a, b, d"), (3, "overview_sentiment"): (None, "positive")}


def test_cost_and_hits(spark):
    rows = evaluation.cost_report(enriched(spark, [rich(1, tokens=(1_000_000, 0)), rich(2, tokens=(0, 1_000_000)), rich(3, model="free")]), {"m": (0.07, 0.30)})
    got = {r.model: r for r in rows.collect()}
    assert got["m"].cost == pytest.approx(0.37) and got["m"].cost_per_movie == pytest.approx(0.185) and got["free"].cost is None
    scored = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (2.5,), (3.0,), (None,)], "delta double")
    r = evaluation.prediction_hits(scored).first()
    assert (r.n, r.exact, r.within_1, r.within_2_5, r.mean_delta) == (5, 1, 3, 4, 1.4)


def test_evaluation_pairs(spark):
    movies = catalog(spark, [movie(m) for m in range(1, 31)])
    rows = ratings(spark, [(1, m, 3, m) for m in range(1, 21)] + [(2, m, 4, m) for m in range(1, 20)] + [(3, m, 5, m) for m in range(1, 31)])
    found = evaluation.eval_candidates(rows, movies, enriched(spark, [rich(m) for m in (1, 2, 3, 25, 26, 27, 99)]))
    assert {(r.user_id, r.movie_id) for r in found.collect()} == {(u, m) for u in (1, 3) for m in (1, 2, 3)} | {(3, m) for m in (25, 26, 27)}
    first = {r.movie_id: r.user_id for r in evaluation.first_per_movie(found).collect()}
    assert first == {1: 1, 2: 1, 3: 1, 25: 3, 26: 3, 27: 3}
    scored = evaluation.evaluate_predictions(rows, movies, enriched(spark, [rich(m) for m in (1, 2, 3, 25, 26, 27)])).collect()
    assert len(scored) == 5 and all(r.delta == abs(r.predicted_rating - r.actual) for r in scored)


def test_lexicon(spark):
    texts = spark.createDataFrame([(1, "Good good BAD"), (2, "bad, day"), (3, "plain"), (4, None), (5, "good bad")], "movie_id bigint, overview string")
    lexicon = spark.createDataFrame([("good", 1.0), ("bad", -1.0)], "word string, weight double")
    got = {r.movie_id: r.overview_sentiment for r in sentiments_from_lexicon(texts, lexicon).collect()}
    assert got == {1: "positive", 2: "negative", 3: "neutral", 4: "neutral", 5: "neutral"}
