"""Response scales."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def linear(column: Column, low: float, high: float, target_low: float = 0.0, target_high: float = 100.0) -> Column:
    """Min-max rescaling from given source bounds; equal bounds change nothing."""
    value = column.cast("double")
    if high == low:
        return value
    return (value - low) / (high - low) * (target_high - target_low) + target_low


def piecewise(
    column: Column,
    bands: Sequence[tuple[float, float]],
    target_low: float = 0.0,
    target_high: float = 100.0,
) -> Column:
    """Rescale each value by the first band that holds it; other values stay."""
    value = column.cast("double")
    result = value
    for low, high in reversed([b for b in bands if b[0] != b[1]]):
        result = F.when(value.between(low, high), linear(value, low, high, target_low, target_high)).otherwise(result)
    return result


#: Conversions to 0-100: smallest and largest value allowed, and the formula.
_FIXED = {
    "1-5": (1, 5, lambda v: (v - 1) / 4 * 100),
    "1-7": (1, 7, lambda v: (v - 1) / 6 * 100),
    "1-10": (0, 10, lambda v: v * 10),
}


def fixed(column: Column, scale: str) -> Column:
    """A 1-5, 1-7 or 1-10 answer on a 0-100 scale, one decimal, ties to even."""
    return F.rint(_FIXED[scale][2](column.cast("double")) * 10) / 10


def fits(scale: str, low: float | None, high: float | None) -> bool:
    """Whether observed bounds lie on a scale (``nps`` is 0-10)."""
    if low is None or high is None:
        return False
    start, end = (0, 10) if scale == "nps" else _FIXED[scale][:2]
    return low >= start and high <= end


def nps_category(column: Column) -> Column:
    """Promoter from 9, Passive from 7, else Detractor."""
    return F.when(
        column.isNotNull(),
        F.when(column >= 9, "Promoter").when(column >= 7, "Passive").otherwise("Detractor"),
    )
