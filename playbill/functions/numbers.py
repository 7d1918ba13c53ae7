"""Numeric expressions: unknown amounts, returns, costs, bins and errors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def known(amount: Column) -> Column:
    """Amounts of zero are unknown."""
    return F.nullif(amount, F.lit(0))


def round_even(value: Column, digits: int) -> Column:
    """Round to ``digits`` decimals on the binary value, ties to even: 2.125 gives 2.12 and 2.175, which
    is a little less in binary, gives 2.17."""
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def roi(revenue: Column, budget: Column) -> Column:
    return revenue / known(budget)


def token_cost(input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column) -> Column:
    """Cost of tokens at prices per million."""
    return input_tokens * input_price / F.lit(1e6) + output_tokens * output_price / F.lit(1e6)


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based bin of ``value`` in ``bins`` equal bins over [low, high]; the last bin is closed.
    One single value falls in the bin that is centred on it, as the range then widens by 0.5 each way."""
    position = (
        F.when(high > low, (value - low) / (high - low) * bins)
        .otherwise(F.lit(bins / 2.0))
    )
    return F.least(F.floor(position), F.lit(bins - 1)).cast("int")


def abs_error(predicted: Column, actual: Column) -> Column:
    return F.round(F.abs(predicted - actual), 2)


def half_steps(value: Column, low: float, high: float) -> Column:
    """Round to the nearest 0.5 (ties up) and keep inside [low, high]."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(value * 2 + 0.5) / 2))
