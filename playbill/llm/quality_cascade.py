"""Quality rules as a short-circuit cascade: rules are ordered by the rejections they give per unit of cost.

Each rule reads one or more measures of the text. On a sample of bounded size, drawn from all rows, the share that every rule rejects is counted
and each measure is timed; a rule costs what its measures take. Rules then stand in descending order of rejection per
cost, and a text meets the next rule only if all earlier ones kept it (nested conditionals: Spark evaluates the
dear measures of a later rule only for texts that are still alive). Order changes cost, never the verdict.

Words are ``[^\\x20\\x09-\\x0D]+``. Null is an empty text: no words, so it fails the least length. Repeated rows are judged
alike; an empty table gives no rows and the declared order of rules. Everything is built-in expressions."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from playbill.llm.common import written

# Fixed values of the contract.
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, REPEAT_PERCENT = 50, 50

SAMPLE_ROWS = 2000


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def count_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def count_duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]")))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _windows(w: Column) -> Column:
    """All 3-word windows, joined by a space (which no word holds)."""
    return F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more: windows are sorted with their places behind them, equal neighbours
    give the places, and each place covers three words unless the next one starts earlier."""
    tail = 10
    keyed = F.array_sort(F.transform(windows, lambda v, i: F.concat(v, F.lit("\x01"), F.lpad(i.cast("string"), tail - 1, "0"))))

    def places(keys: Column, bare: Column) -> Column:
        return F.filter(F.transform(keys, lambda s, i: F.when(
            (F.get(bare, i) == F.get(bare, i - 1)) | (F.get(bare, i) == F.get(bare, i + 1)), F.right(s, F.lit(tail - 1)).cast("int"))),
            lambda p: p.isNotNull())

    def bared(keys: Column) -> Column:
        return _let(F.transform(keys, lambda s: F.left(s, F.length(s) - tail)), lambda bare: F.array_sort(places(keys, bare)))

    def length(at: Column) -> Column:
        return F.aggregate(
            F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))), F.lit(0), lambda n, x: n + x)

    return _let(_let(keyed, bared), length)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text; texts without such a window stop at a hash set.
    The word list is bound first: a filter may inline it, and it must not be made again for every window."""
    found = lambda v: F.when(F.size(F.array_distinct(v)) < F.size(v), _covered(v)).otherwise(0)
    return _let(w, lambda x: F.when(F.size(x) < 4, F.lit(0)).otherwise(_let(_windows(x), found))).cast("long")


@dataclass(frozen=True)
class Rule:
    """A text is rejected where ``rejects`` is true. ``measures`` names the columns it reads."""

    name: str
    measures: tuple[str, ...]
    rejects: str


#: A measure that a rule shares with an earlier one is already there, so only the first of them pays for it.
RULES = (
    Rule("too_short", ("n_words",), f"n_words < {LEAST_WORDS}"),
    Rule("symbols", ("n_symbols", "word_chars"), "n_symbols * 10 > word_chars"),
    Rule("word_length", ("n_words", "word_chars"), "word_chars < 2 * n_words or word_chars > 25 * n_words"),
    Rule("shouting", ("n_shouts", "n_words"), "n_shouts * 2 > n_words"),
    Rule("duplicate_lines", ("n_dup_lines", "n_lines"), "n_dup_lines * 2 > n_lines"),
    Rule("repetition", ("n_repeat_words", "n_words"), f"100 * n_repeat_words > {REPEAT_PERCENT} * n_words"),
)


def measures(text: str, words_: str) -> dict[str, Column]:
    """All measures, of a text and its word list."""
    return {
        "n_words": F.size(words_).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": count_symbols(F.col(text)),
        "n_lines": F.size(F.split(text, "\n")).cast("long"),
        "n_dup_lines": count_duplicate_lines(F.col(text)),
        "n_repeat_words": count_repeat_words(F.col(words_)),
        "n_shouts": (F.length(text) - F.length(F.replace(text, F.lit("!!"), F.lit("!")))).cast("long"),
    }


def measured(documents: DataFrame) -> DataFrame:
    """The documents with all measures; the word list is made once for each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.withColumn("_text", text).withColumn("_words", words(F.col("_text")))
    return rows.withColumns(measures("_text", "_words")).drop("_text", "_words")


def sampled(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``sample_rows`` texts drawn from all rows, written; their number does not grow with the table."""
    share = min(1.0, sample_rows / max(1, documents.count()))
    return written(documents.select(F.coalesce("text", F.lit("")).alias("text")).sample(share, 5), "quality-sample")


def timed_costs(sample: DataFrame) -> dict[str, float]:
    """Seconds that each measure takes over the sample beyond what reading it takes; the word list counts where it is needed."""
    def seconds(value: Column) -> float:
        start = time.perf_counter()
        sample.withColumn("_words", words(F.col("text"))).agg(F.sum(value)).collect()
        return time.perf_counter() - start

    every = measures("text", "_words")
    seconds(F.lit(1))
    bare = seconds(F.lit(1))
    return {name: max(1e-3, seconds(value) - bare) for name, value in every.items()}


def cascade_order(documents: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejected share per cost, both estimated on a sample; ties keep the declared order. The sample decides speed only."""
    sample = sampled(documents, sample_rows)
    costs = timed_costs(sample)
    counts = measured(sample).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.expr(r.rejects)).alias(r.name) for r in rules)).first()
    paid: set[str] = set()
    left, ordered = list(rules), []
    while left:
        def gain(r: Rule) -> float:
            return counts[r.name] / max(1, counts.n) / max(1e-3, sum(costs[m] for m in r.measures if m not in paid))

        best = max(left, key=lambda r: (gain(r), -rules.index(r)))
        paid.update(best.measures)
        ordered.append(best)
        left.remove(best)
    return ordered


def verdict(ordered: list[Rule]) -> Column:
    """Name of the first rule that rejects, or null; later rules are not evaluated once one has rejected."""
    out = F.lit(None).cast("string")
    for rule in reversed(ordered):
        out = F.when(F.expr(rule.rejects), F.lit(rule.name)).otherwise(out)
    return out


def judged(documents: DataFrame, rules=RULES) -> DataFrame:
    """The documents with their measures and ``rejected_by``, the first rule of the cascade that rejects each (null: kept)."""
    return measured(documents).withColumn("rejected_by", verdict(cascade_order(documents, rules)))


def kept(documents: DataFrame, rules=RULES) -> DataFrame:
    """The documents that every rule keeps. Only the verdict is asked for, so dear measures are skipped for rejected texts."""
    ordered = cascade_order(documents, rules)
    rows = documents.withColumn("_row", F.struct(*(documents[f"`{c}`"] for c in documents.columns)))
    return measured(rows).where(verdict(ordered).isNull()).select("_row.*")


def digest(documents: DataFrame) -> DataFrame:
    rows = judged(documents.select("doc_id", "text"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & F.col("rejected_by").isNull()).alias("kept"))
