"""Text expressions: trimming, model answers, money and rating phrases, history lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from playbill.functions.numbers import roi, round_even

WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
FENCE = "`" * 3
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def strip_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def answer_text(content: Column) -> Column:
    """Text blocks of a model answer joined in order; blocks without text (reasoning) are skipped."""
    texts = F.filter(F.transform(content, lambda block: block["text"]), lambda text: text.isNotNull())
    return strip(F.array_join(texts, ""))


def without_fences(text: Column) -> Column:
    """Drop every code-fence line, but only from text that starts with a fence."""
    kept = F.filter(F.split(strip(text), LINE_END), lambda line: ~F.startswith(strip(line), F.lit(FENCE)))
    return F.when(F.startswith(strip(text), F.lit(FENCE)), strip(F.array_join(kept, "\n"))).otherwise(strip(text))


def rating_phrase(avg_rating: Column, n_ratings: Column) -> Column:
    stated = F.format_string("%.2f avg across %d user ratings", round_even(avg_rating, 2), F.coalesce(n_ratings, F.lit(0)))
    return F.when(avg_rating.isNull(), F.lit("no user ratings")).otherwise(stated)


def money(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(F.coalesce(amount, F.lit(0)), 0))


def roi_phrase(revenue: Column, budget: Column) -> Column:
    value = roi(revenue, budget)
    return F.when(value.isNull() | (value == 0), F.lit("n/a")).otherwise(F.format_string("%.1fx", round_even(value, 1)))


def runtime_phrase(runtime: Column) -> Column:
    return F.when(runtime.isNull() | (runtime == 0), F.lit("unknown")).otherwise(runtime.cast("string"))


def rated_line(rating: Column, title: Column, names: Column) -> Column:
    """One history line: rating, title and up to three genres. A missing title or genre list is empty, so that no line is lost."""
    shown = F.array_join(F.slice(names, 1, 3), ", ")
    return F.concat(F.lit("  - "), F.coalesce(rating.cast("string"), F.lit("?")), F.lit("/5.0 — "), F.coalesce(title, F.lit("")), F.lit(" ["), F.coalesce(shown, F.lit("")), F.lit("]"))
