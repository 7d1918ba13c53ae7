"""Batch inference through a user-supplied scorer, with validated answers and bounded retries."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from playbill.contracts import Field
from playbill.functions.text import answer_text, without_fences
from playbill.operators.validate import read_fields
from playbill.session import new_run_dir, written

# A scorer gets prompts and the attempt number and returns, row by row, ``content`` (a list of blocks
# with ``text`` or ``reasoning``), ``input_tokens`` and ``output_tokens``, and optionally ``error``. PermissionError ends the run.
Scorer = Callable[[pd.Series, int], pd.DataFrame]

ROWS_PER_TASK = 2_000

_ANSWER = "prompt string, content array<struct<text:string,reasoning:string>>, input_tokens bigint, output_tokens bigint, error string, denied boolean, run string"


def clean_answers(answers: DataFrame, content: str = "content") -> DataFrame:
    """Add ``answer``: the text blocks joined, without code fences."""
    return answers.withColumn("answer", without_fences(answer_text(F.col(content))))


def _asked(scorer: Scorer, prompts: pd.Series, attempt: int) -> pd.DataFrame:
    """Scored prompts, in order, with ``error``. A call that fails is repeated in halves, down to the rows that fail."""
    try:
        scored = scorer(prompts, attempt).reset_index(drop=True)
        return scored if "error" in scored else scored.assign(error=None)
    except PermissionError:
        raise
    except Exception as exc:
        if len(prompts) > 1:
            half = len(prompts) // 2
            return pd.concat([_asked(scorer, prompts.iloc[:half], attempt), _asked(scorer, prompts.iloc[half:], attempt)], ignore_index=True)
        return pd.DataFrame({"content": [None], "input_tokens": [0], "output_tokens": [0], "error": [f"{type(exc).__name__}: {exc}"]})


def _asker(scorer: Scorer, attempt: int, run: str):
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refusal, first = None, True
        for batch in batches:
            # A task asks for one row first, so that a refusal costs one call.
            for part in (batch.iloc[:1], batch.iloc[1:]) if first else (batch,):
                if not len(part):
                    continue
                first = False
                out = part[["key", "prompt"]].reset_index(drop=True)
                if refusal is None:
                    try:
                        scored = _asked(scorer, part["prompt"], attempt)
                    except PermissionError as exc:
                        refusal = f"denied: {exc}"
                if refusal is None:
                    out = out.assign(content=scored["content"], input_tokens=scored["input_tokens"],
                                     output_tokens=scored["output_tokens"], error=scored["error"])
                else:
                    out = out.assign(content=None, input_tokens=0, output_tokens=0, error=refusal)
                yield out.assign(denied=refusal is not None, run=run)

    return ask


def _committed(spark, path: str) -> DataFrame | None:
    """Answers of the parts that were written whole: those whose folder Spark has marked as successful."""
    jvm = spark.sparkContext._jvm
    marks = jvm.org.apache.hadoop.fs.Path(f"{path}/*/_SUCCESS")
    found = marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks)
    folders = [str(f.getPath().getParent()) for f in found or []]
    return spark.read.parquet(*folders) if folders else None


def run_inference(
    prompts: DataFrame, scorer: Scorer, fields: Sequence[Field], model: str, retries: int = 2,
    key: str = "movie_id", run_dir: str | None = None, partitions: int | None = None, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Ask for every row of ``prompts`` (``key``, ``prompt``), up to ``1 + retries`` times.

    A round's prompts are rendered and written once, dealt to numbered parts of ``partitions`` tasks of about ``rows_per_task`` rows. The parts are asked one after the
    other, each part's answers being written to a folder of their own that counts only once it is whole: no more calls than a part's are
    in flight, and whatever ends a run costs the answers of one part at most. With the ``run_dir`` of an
    earlier run only rows without a written answer are asked; rows that failed count as unanswered. Turn speculation off for these jobs.
    ``partitions`` is by default one per core. A key that is given twice is asked once.

    Result: ``key``, the fields, ``status`` (ok, invalid, error), ``attempts``, ``reject_reason``,
    tokens summed over all attempts, and ``model``."""
    spark = prompts.sparkSession
    partitions = partitions or spark.sparkContext.defaultParallelism
    run_dir, run = run_dir or new_run_dir(spark, "inference"), uuid.uuid4().hex
    key_type = dict(prompts.dtypes)[key]
    pending, rounds = prompts.select(F.col(key).alias("key"), "prompt").dropDuplicates(["key"]), []
    for attempt in range(retries + 1):
        path = f"{run_dir}/round-{attempt}"
        earlier = _committed(spark, path)
        asked = pending if earlier is None else written(pending, "prompts")
        todo = asked if earlier is None else asked.join(earlier.filter("error is null").select("key"), "key", "left_anti")
        parts = -(-todo.select("key").count() // (partitions * rows_per_task))
        # Each part is read by itself: the prompts of a round are written once and read once, however many parts there are.
        numbered = todo.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(max(1, parts))).cast("int"))
        todo = written(numbered.repartition(max(1, parts), "part") if parts > 1 else numbered, "prompts", by="part")
        for part in range(parts):
            folder = f"{path}/{run}-{part}"
            todo.where(F.col("part") == part).drop("part").repartition(partitions, "key").mapInPandas(_asker(scorer, attempt, run), f"key {key_type}, {_ANSWER}").write.parquet(folder)
            refused = spark.read.parquet(folder).filter("denied").select("error").head(1)
            if refused:
                raise PermissionError(refused[0]["error"])
        answers = _committed(spark, path)
        if answers is None:
            answers = spark.createDataFrame([], f"key {key_type}, {_ANSWER}")
        # Failures of an earlier run are asked again; only this run's failures stand.
        answers = answers.filter(F.col("error").isNull() | (F.col("run") == run))
        if earlier is not None:
            answers = answers.join(asked.select("key"), "key", "left_semi")
        judged = read_fields(
            clean_answers(answers).withColumn("attempt", F.lit(attempt)), F.col("answer"), fields,
            keep=["key", "prompt", "attempt", "input_tokens", "output_tokens", "error"],
        )
        rounds.append(judged.drop("prompt"))
        pending = judged.filter(~F.col("valid") & F.col("error").isNull()).select("key", "prompt")
        if attempt == retries or pending.isEmpty():
            break
    every = rounds[0]
    for judged in rounds[1:]:
        every = every.unionByName(judged)
    last = F.struct(*[F.when(F.col("valid"), F.col(f.name)).alias(f.name) for f in fields], "valid", "error", "reject_reason")
    final = every.groupBy("key").agg(
        F.max_by(last, "attempt").alias("last"), F.count(F.lit(1)).alias("attempts"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    status = (F.when(F.col("last.error").isNotNull(), F.lit("error"))
              .when(F.col("last.valid"), F.lit("ok")).otherwise(F.lit("invalid")))
    return final.select(
        F.col("key").alias(key), *[F.col(f"last.{f.name}").alias(f.name) for f in fields],
        status.alias("status"), "attempts",
        F.coalesce("last.error", F.when(~F.col("last.valid"), F.col("last.reject_reason"))).alias("reject_reason"),
        "input_tokens", "output_tokens", F.lit(model).alias("model"))
