"""Column helpers for text: extraction, ordered de-duplication, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    """Every match of ``pattern`` in order; an empty array when there is none."""
    return F.coalesce(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>")
    )


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """First non-empty match, or null when there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def distinct_ignoring_case(values: Column) -> Column:
    """Drop later case-insensitive repeats, keep the first spelling and the order."""
    lowered = F.transform(values, F.lower)
    return F.filter(
        values, lambda v, i: F.array_position(lowered, F.lower(v)) == (i + 1).cast("bigint")
    )


def words(text: Column) -> Column:
    """Whitespace-separated words without empty strings."""
    return find_all(text, r"\S+")


def word_set(text: Column, min_chars: int = 3) -> Column:
    """Distinct lower-case words of at least ``min_chars`` characters, in first-seen order."""
    return F.array_distinct(find_all(F.lower(text), r"\S{%d,}" % min_chars))


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard similarity of two string sets: both empty 1, one empty 0."""
    both = F.size(F.array_intersect(left, right))
    return (
        F.when((F.size(left) == 0) & (F.size(right) == 0), F.lit(1.0))
        .when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0))
        .otherwise(both / (F.size(left) + F.size(right) - both).cast("double"))
    )


def round_half_up(value: Column, digits: int) -> Column:
    """``floor(x * 10^d + 0.5) / 10^d`` in double arithmetic."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def one_digit(value: Column) -> Column:
    """``value`` (not negative) as text with one digit, rounded by its exact binary value, ties to even.

    ``%.1f`` of Spark rounds the shortest decimal text: 0.85, stored as 0.84999..., becomes 0.9.
    Twenty times the value is 16x + 4x, kept as a sum and its rounding error, so nothing is lost.
    """
    tenths = F.floor(value * F.lit(10.0))
    total = value * F.lit(16.0) + value * F.lit(4.0)
    error = value * F.lit(4.0) - (total - value * F.lit(16.0))
    over = (total - (tenths * 2 + 1).cast("double")) + error
    up = (over > 0) | ((over == 0) & (tenths % 2 == 1))
    tenths = tenths + up.cast("bigint")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as double, null when the whole is zero."""
    return part.cast("double") / F.nullif(whole, F.lit(0)).cast("double")


def split_sentences(text: Column) -> Column:
    """Non-empty pieces between full stops and line breaks, without outer spaces."""
    return find_all(text, r"[^.\n ](?:[^.\n]*[^.\n ])?")
