"""Casts that yield null instead of failing, and dates."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from tablemeld.functions.fixed_values import DATE_PATTERNS

#: Further patterns, tried after the fixed ones.
FURTHER_PATTERNS = ("yyyy-M-d'T'H:m:s", "yyyy M d", "yyyy/M/d", "d MMM yyyy", "MMM d, yyyy")

#: Month-first before day-first, for values that both could read.
AUTO_PATTERNS = (
    "yyyy-M-d", "yyyy-M-d H:m:s", "M/d/yyyy", "d/M/yyyy", "d-M-yyyy", "yyyyMMdd", *FURTHER_PATTERNS,
)


#: Text that is a decimal number.  Checked first: a failed cast costs far more.
_NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"


def to_number(column: Column, from_text: bool = True) -> Column:
    """Text as double; anything but a decimal number is null."""
    if not from_text:
        return column.cast("double")
    return F.when(column.rlike(_NUMBER), column.try_cast("double"))


def to_integer(column: Column, from_text: bool = True) -> Column:
    """Whole numbers as bigint, anything else null."""
    number = to_number(column, from_text)
    whole = F.when(number == F.floor(number), number.try_cast("bigint"))
    return F.coalesce(column.try_cast("bigint"), whole) if from_text else whole


def cast_to(column: Column, target: str, source: str = "string") -> Column:
    """Cast between semantic types; values that do not convert become null."""
    text = source not in ("integer", "float", "boolean", "datetime")
    if target == "integer":
        return column.cast("bigint") if source in ("integer", "boolean") else to_integer(column, text)
    if target == "float":
        return to_number(column, text) if source != "boolean" else column.cast("int").cast("double")
    if target == "boolean":
        return column.try_cast("boolean")
    return column.cast("string")


#: What each pattern letter may hold; rules out most values before they are parsed.
_PARTS = {
    "yyyy": r"\d{4}", "MMM": r"[A-Za-z]{3}", "MM": r"(?:0[1-9]|1[0-2])", "M": r"(?:0?[1-9]|1[0-2])",
    "dd": r"(?:0[1-9]|[12]\d|3[01])", "d": r"(?:0?[1-9]|[12]\d|3[01])",
    "H": r"(?:[01]?\d|2[0-3])", "m": r"[0-5]?\d", "s": r"[0-5]?\d",
}


def _shape(pattern: str) -> str:
    """Regular expression of the values that a date pattern can parse."""
    parts = re.split(r"(yyyy|MMM|MM|M|dd|d|H|m|s)", pattern.replace("'T'", "\0"))
    return "^" + "".join(_PARTS.get(p) or re.escape(p).replace("\0", "T") for p in parts if p) + "$"


def _parsed(text: Column, pattern: str) -> Column:
    """Timestamp by one pattern.  The shape is checked first: a failed parse costs far more."""
    if re.sub(r"yyyy|MMM|MM|M|dd|d|H|m|s|'T'|[-/:., ]", "", pattern):
        return F.try_to_timestamp(text, F.lit(pattern))
    return F.when(text.rlike(_shape(pattern)), F.try_to_timestamp(text, F.lit(pattern)))


def parse_timestamp(column: Column, pattern: str | None = None, patterns: Sequence[str] = AUTO_PATTERNS) -> Column:
    """Text as timestamp by one pattern, or by the first pattern that fits each value."""
    text = F.trim(column)
    if pattern:
        return _parsed(text, pattern)
    return F.coalesce(*[_parsed(text, p) for p in patterns])


def format_date(
    column: Column,
    pattern: str | None = None,
    target: str = "yyyy-MM-dd",
    temporal: bool = False,
) -> Column:
    """Date as text in the target pattern; values that do not parse become null."""
    moment = column if temporal else parse_timestamp(column, pattern)
    return F.date_format(moment, target)


def pattern_counts(column: Column, patterns: Sequence[str] = DATE_PATTERNS) -> dict[str, Column]:
    """How many values each pattern parses, as aggregate expressions."""
    text = F.trim(column)
    return {p: F.count(_parsed(text, p)) for p in patterns}
