"""Numeric expressions shared by the layers and the scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAT_RANGE = 1e-9


def clamp01(value: Column) -> Column:
    """Value limited to [0, 1]; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def scale01(value: Column, low: Column, high: Column) -> Column:
    """Position of value between low and high; 0 when the range is flat, null stays null."""
    spread = high - low
    return F.when(value.isNull(), F.lit(None).cast("double")).when(
        spread <= FLAT_RANGE, F.lit(0.0)
    ).otherwise((value - low) / spread)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: sum(v*w) / sum(w), with a divisor of 1 when the weights sum to nothing."""
    total = F.sum(weight)
    return F.sum(value * weight) / F.when(total <= 0, F.lit(1.0)).otherwise(total)


_LOW_BITS = 20


def steady_sum(value: Column, digits: int) -> Column:
    """Aggregate: sum of values taken to ``digits`` decimals, as a double.

    Sums of doubles depend on the order in which tasks deliver them, so means, ranks and
    rounded reports could differ between two runs. Here whole multiples of 10**-digits are
    added, in a high and a low half, which is exact in any order and cannot overflow.
    """
    whole = F.rint(value * F.lit(10.0**digits)).cast("bigint")
    high = F.sum(F.shiftright(whole, _LOW_BITS)).cast("double")
    low = F.sum(whole.bitwiseAND(F.lit((1 << _LOW_BITS) - 1))).cast("double")
    return high * F.lit(float(1 << _LOW_BITS)) + low


def steady_mean(value: Column, digits: int) -> Column:
    """Aggregate: mean of the non-null values by ``steady_sum``; null for none."""
    return steady_sum(value, digits) / F.nullif(F.count(value) * F.lit(10.0**digits), F.lit(0.0))


# Decimals kept when positions (a centimetre) and quality scores are averaged.
POSITION_DIGITS = 7
QUALITY_DIGITS = 6


def share_of(part: Column, whole: Column) -> Column:
    """part / (whole + 1), limited to [0, 1]."""
    return clamp01(part / (whole + F.lit(1.0)))


def sheet_number(raw: Column) -> Column:
    """Number in a spreadsheet cell; suppression marks and blanks give null."""
    text = F.trim(raw)
    # Marks that stand for a missing number.
    missing = text.isin("", "nan", "NaN", "-", "s", "(s)")
    return F.when(~missing, F.regexp_replace(text, "[,$]", "").try_cast("double"))


def sheet_integer(raw: Column) -> Column:
    """Whole number in a text cell, also when written as ``12.0``."""
    return F.trim(raw).try_cast("double").try_cast("bigint")


def fixed_point(value: Column, digits: int, grouped: bool = False) -> Column:
    """Decimal text with a fixed number of digits, half-even like most spreadsheet exports."""
    pattern = ("#,##0" if grouped else "0") + ("." + "0" * digits if digits else "")
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def ramp(value: Column, start: int, step: int) -> Column:
    """Integer colour channel that moves by ``step`` while value goes from 0 to 1."""
    return (F.lit(float(start)) + F.lit(float(step)) * value).cast("int")
