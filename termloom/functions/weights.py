"""Weighting formulas on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SCORE_DIGITS = 6  # scores are compared and ranked at this precision
FONT_SIZE_MIN = 8
FONT_SIZE_MAX = 50


def inverse_document_frequency(n: Column, df: Column) -> Column:
    """ln(n / df)."""
    return F.log(n.cast("double") / df)


def score(tf: Column, idf: Column) -> Column:
    """tf * idf, and 0 where either side is missing."""
    return F.coalesce(tf * idf, F.lit(0.0))


def rounded(number: Column, digits: int = SCORE_DIGITS) -> Column:
    """`round` of a double, with the same results.

    Spark's own goes through the decimal text of each number, which costs more than
    scoring and ranking it. Here only numbers do that which may be ties: below 1e12 the
    arithmetic is off by less than 2e-4, and a whole number over a power of ten is the
    double next to that decimal.
    """
    scale = 10.0**digits
    raised = number * F.lit(scale) + F.lit(0.5)
    whole = F.floor(raised)
    over = raised - whole
    certain = (raised >= 0.5) & (raised < 1e12) & (over > 1e-3) & (over < 1 - 1e-3)
    return F.when(certain, whole.cast("double") / F.lit(scale)).otherwise(F.round(number, digits))


def ranking_score(tf_idf: Column) -> Column:
    """The score at ranking precision, so that the last bit of `ln` decides nothing."""
    return rounded(tf_idf)


def truncated_weight(tf_idf: Column) -> Column:
    """The score cut to a whole number."""
    return F.floor(ranking_score(tf_idf)).cast("int")


def font_size(weight: Column, smallest: Column, largest: Column) -> Column:
    """Square-root scale of a weight; the largest size if all weights are equal."""
    span = F.sqrt(largest) - F.sqrt(smallest)
    scaled = F.lit(FONT_SIZE_MIN) + (FONT_SIZE_MAX - FONT_SIZE_MIN) * (
        F.sqrt(weight) - F.sqrt(smallest)
    ) / F.nullif(span, F.lit(0.0))
    return F.coalesce(scaled, F.lit(float(FONT_SIZE_MAX)))
