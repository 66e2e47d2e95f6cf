"""Parsing, coercion and missing-value expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marker for a missing measurement, and for an event without a venue.
MISSING_MEASURE = -9999
NO_VENUE_SCORE = -1


def number_or_null(text: Column) -> Column:
    """Text as a finite-or-infinite double; null for text that is no number and for NaN."""
    parsed = F.trim(text.cast("string")).try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def sentinel_to_null(value: Column, sentinel: float = MISSING_MEASURE) -> Column:
    """The sentinel becomes null, so that sums and averages skip it."""
    return F.nullif(value.cast("double"), F.lit(float(sentinel)))


def score_or_zero(score: Column) -> Column:
    """An event without a venue weighs nothing."""
    return F.when(score == NO_VENUE_SCORE, F.lit(0.0)).otherwise(score.cast("double"))


def first_element(array: Column) -> Column:
    """Element 0, null for empty or missing arrays (also under ANSI mode)."""
    return F.get(array, F.lit(0))


def proportional_error(prediction: Column, label: Column) -> Column:
    """|prediction - label| over the label, or over 1 where the label is not positive."""
    divisor = F.when(label > 0, label.cast("double")).otherwise(F.lit(1.0))
    return F.abs(prediction - label) / divisor
