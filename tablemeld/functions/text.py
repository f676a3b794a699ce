"""Text cleanup and standard forms."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from tablemeld.functions.names import compact


def strip(column: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


#: Signs that cleaning would change; most short answers hold none of them.
_UNCLEAN = r"[^A-Za-z0-9_.,'\"() ]|  |^ | $"


def clean_text(column: Column, normalize_separators: bool = True) -> Column:
    """ASCII text: no entities, tags or unusual signs, single spaces.

    With ``normalize_separators`` each ``>``, ``-`` or ``/`` becomes ``' > '``.
    Text that ends up empty becomes null.  Text that is clean already takes one
    regular expression instead of four.
    """
    text = F.regexp_replace(column, r"&[a-zA-Z]+;|<[^>]+>", " ")
    # \w is ASCII here, so this drops everything outside ASCII too; \x1c-\x1f are white space
    text = F.regexp_replace(text, r"[^\w\s\x1c-\x1f\-.,'\"/()]", "")
    text = F.trim(F.regexp_replace(text, r"[\s\x1c-\x1f]+", " "))
    if normalize_separators:
        text = F.regexp_replace(text, r"\s*[>\-/]\s*", " > ")
    return F.nullif(F.when(column.rlike(_UNCLEAN), text).otherwise(column), F.lit(""))


_STEPS = {
    "lowercase": F.lower,
    "uppercase": F.upper,
    "strip": strip,
    "replace_special": lambda c: F.regexp_replace(c, r"(?U)[^\w\s]", ""),
}


def standardize(column: Column, operations: Sequence[str] = ("strip",)) -> Column:
    """Apply the named steps in order; unknown names change nothing."""
    for operation in operations:
        column = _STEPS.get(operation, lambda c: c)(column)
    return column


def repair_separator(column: Column) -> Column:
    """``2024 > 06 > 01`` back to ``2024-06-01``."""
    return F.replace(column, F.lit(" > "), F.lit("-"))


def wave_label(column: Column) -> Column:
    """``Wave 1 2024``, ``2024-W1``, ``Q1 2024`` and ``2024Q1`` as ``W1_2024`` / ``Q1_2024``."""
    text = F.upper(F.trim(column))
    leading = r"^(?:WAVE\s*|(W|Q))(\d+)[\s_-]+(\d{4})$"
    trailing = r"^(\d{4})[\s_-]*(W|Q)(\d+)$"
    letter = F.coalesce(F.nullif(F.regexp_extract(text, leading, 1), F.lit("")), F.lit("W"))
    return (
        F.when(
            text.rlike(leading),
            F.concat(letter, F.regexp_extract(text, leading, 2), F.lit("_"), F.regexp_extract(text, leading, 3)),
        )
        .when(
            text.rlike(trailing),
            F.concat(
                F.regexp_extract(text, trailing, 2), F.regexp_extract(text, trailing, 3),
                F.lit("_"), F.regexp_extract(text, trailing, 1),
            ),
        )
        .otherwise(column)
    )


def loosely_equal(name: Column, others: Iterable[str]) -> Column:
    """Whether the name, without case, underscores, hyphens and spaces, equals, contains or lies in one of the others."""
    short = F.lower(F.regexp_replace(name, r"[_\- ]", ""))
    wanted = [F.lit(compact(o)) for o in others]
    return reduce(or_, [short.contains(o) | o.contains(short) for o in wanted], F.lit(False))
