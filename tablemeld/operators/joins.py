"""Lookup joins whose physical form depends on a checked size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablemeld.columns import ref
from tablemeld.storage import materialize

#: Rows, and bytes of their values, up to which a lookup table is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Heaviest keys that are looked up without a shuffle when the table is large.
HOT_KEYS = 2_000


def _width(table: DataFrame) -> Column:
    """Bytes of a row, about: eight for a number or a time, the text of anything else."""
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType)
    sizes = [
        F.lit(8) if isinstance(f.dataType, fixed) else F.coalesce(F.octet_length(ref(f.name).cast("string")), F.lit(0)) for f in table.schema.fields
    ]
    return reduce(add, sizes, F.lit(0).cast("long"))


def fits_broadcast(table: DataFrame, max_rows: int | None = None) -> bool:
    """Whether a table has at most ``max_rows`` rows and ``BROADCAST_BYTES`` bytes; reads no more rows than it must."""
    limit = BROADCAST_ROWS if max_rows is None else max_rows
    found = table.limit(limit + 1).agg(F.count(F.lit(1)).alias("rows"), F.sum(_width(table)).alias("bytes")).first()
    return found["rows"] <= limit and (found["bytes"] or 0) <= BROADCAST_BYTES


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    weight: str | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Left join to a table with unique keys; columns of ``rows`` first.

    A small table is broadcast.  A large one is joined by shuffle, with two kinds of
    rows kept out of the shuffle because they would pile up in one task: rows with a
    null key (nothing can match) and rows of the heaviest keys by ``weight``, the
    number of rows per key (they meet a bounded broadcast).
    """
    keys = list(keys)
    added = [c for c in table.columns if c not in keys]
    order = [ref(c) for c in (*rows.columns, *added)]
    if fits_broadcast(table, max_rows):
        return rows.join(F.broadcast(table), keys, "left").select(*order)
    if weight is not None:
        # read several times below; also keeps the choice of heaviest keys stable
        table = materialize(table, "lookup")
    no_key = reduce(or_, [ref(k).isNull() for k in keys])
    unmatched = rows.where(no_key).withColumns(
        {c: F.lit(None).cast(table.schema[c].dataType) for c in added}
    )
    keyed = rows.where(~no_key)
    parts = [unmatched]
    if weight is not None:
        hot = F.broadcast(table.orderBy(F.desc(weight), *map(ref, keys)).limit(HOT_KEYS))
        parts.append(keyed.join(hot, keys))
        keyed = keyed.join(hot.select(*map(ref, keys)), keys, "left_anti")
    parts.append(keyed.join(table, keys, "left"))
    return reduce(DataFrame.unionByName, [p.select(*order) for p in parts])


def weighted_lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``lookup_join`` to a table that does not know how heavy its keys are.

    Rows are counted per key (hot keys collapse before the shuffle) only when the
    table is too large to broadcast; keys that no row has are left out on the way.
    """
    if fits_broadcast(table):
        return lookup_join(rows, table, keys)
    counted = rows.groupBy(*map(ref, keys)).agg(F.count(F.lit(1)).alias("__weight"))
    found = counted.join(table, list(keys))
    return lookup_join(rows, found, keys, weight="__weight").drop("__weight")
