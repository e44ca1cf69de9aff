"""Ratios and means with explicit, engine-independent results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator::double / NULLIF(denominator, 0)``: NULL instead of an error
    (ANSI) or infinity when the denominator is zero."""
    return numerator.cast("double") / F.nullif(denominator, F.lit(0)).cast("double")


def _exact_div(a: Column, b: Column) -> Column:
    """``a div b`` for non-negative BIGINTs below 2**53: ``a - a % b`` is an
    exact multiple of ``b``, so the double quotient is an exact integer."""
    return ((a - a % b) / b).cast("bigint")


def round_mean_half_up(total: Column, count: Column, digits: int = 2) -> Column:
    """``round(total / count, digits)`` with exact half-away-from-zero rounding.

    Works on the integer total, so the result is the decimal rounding of the
    true quotient (numeric semantics), not of its nearest double:
    ``sign(t) * ((|t| * 2 * 10^d + c) div (2c)) / 10^d``. NULL when count is 0.
    """
    scale = 10 ** digits
    c = F.nullif(count, F.lit(0)).cast("bigint")
    whole = _exact_div(F.abs(total).cast("bigint") * (2 * scale) + c, c * 2)
    signed = F.signum(total).cast("bigint") * whole   # integer product: never -0.0
    return signed.cast("double") / F.lit(float(scale))


def ratio_sql(numerator: str, denominator: str) -> str:
    """:func:`ratio` of two columns as SQL text."""
    return f"CAST({numerator} AS DOUBLE) / CAST(nullif({denominator}, 0) AS DOUBLE)"


def round_mean_sql(total: str, count: str, digits: int = 2) -> str:
    """:func:`round_mean_half_up` of two BIGINT columns as SQL text."""
    scale = 10 ** digits
    whole = f"(abs({total}) * {2 * scale} + {count}) div (2 * nullif({count}, 0))"
    return f"CAST(CAST(signum({total}) AS BIGINT) * ({whole}) AS DOUBLE) / {scale}D"
