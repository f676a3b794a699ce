"""Value maps and code lists."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column, functions as F

from tablemeld.functions import fixed_values as fv

#: Map entries up to which a literal map beats a broadcast join.
LITERAL_ENTRIES = 200


def literal_map(entries: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(entries.items())])


def lookup(column: Column, entries: Mapping[str, str]) -> Column:
    """Mapped value, null where the key is unknown."""
    if not entries:
        return F.lit(None).cast("string")
    return F.try_element_at(literal_map(entries), column)


def value_map(
    column: Column,
    entries: Mapping[str, str],
    default: str | None = None,
    case_sensitive: bool = True,
) -> Column:
    """Raw value to canonical value; unknown values take the default or pass through."""
    text = column.cast("string")
    found = (
        lookup(text, entries)
        if case_sensitive
        else lookup(F.lower(text), {k.lower(): v for k, v in entries.items()})
    )
    fallback = text if default is None else F.lit(default)
    return F.when(text.isNotNull(), F.coalesce(found, fallback))


def _folded(column: Column) -> Column:
    return F.lower(F.trim(column))


def region_code(column: Column) -> Column:
    """Region code; unknown regions in upper case."""
    key = _folded(column)
    return F.coalesce(lookup(key, fv.REGION_CODES), F.upper(key))


def country_code(column: Column) -> Column:
    """ISO country code; unknown countries in upper case."""
    key = _folded(column)
    return F.coalesce(lookup(key, fv.COUNTRY_CODES), F.upper(key))


def category_code(column: Column) -> Column:
    """Category code; unknown categories in lower case."""
    key = _folded(column)
    return F.coalesce(lookup(key, fv.CATEGORY_CODES), key)


def merge_value_maps(
    user: Mapping[str, Mapping[str, str]],
    defaults: Mapping[str, Mapping[str, str]] = fv.DEFAULT_VALUE_MAPS,
    replace: bool = False,
) -> dict[str, dict[str, str]]:
    """User maps on top of the default maps, entry by entry.

    ``replace=True`` lets a default map take the place of a user map instead.
    """
    merged = {c: dict(m) for c, m in user.items()}
    for column, entries in defaults.items():
        merged[column] = (
            dict(entries) if replace else {**entries, **{k: v for k, v in merged.get(column, {}).items()}}
        )
    return merged
