"""Before/after comparison of two versions of a table, aligned by key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from tablemeld import columns as cols


def column_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column, change): added, removed or common."""
    left = set(before.columns)
    right = set(after.columns)
    rows = [
        (c, "common" if c in left and c in right else "added" if c in right else "removed")
        for c in dict.fromkeys([*before.columns, *after.columns])
    ]
    return before.sparkSession.createDataFrame(rows, "column string, change string")


def common_columns(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in before.columns if c in after.columns and c not in set(keys)]


def _comparable(df: DataFrame, name: str, as_text: bool) -> Column:
    return cols.as_text(df, name) if as_text else cols.ref(name)


def align(
    before: DataFrame, after: DataFrame, keys: Sequence[str], names: Sequence[str], as_text: bool
) -> DataFrame:
    """Both versions of every key side by side (``{i}_b``, ``{i}_a``), with row counts.

    Both sides are stacked and grouped by key, so a repeated key cannot multiply
    rows: it only shows in ``rows_before`` or ``rows_after``.
    """

    def side(df: DataFrame, is_before: bool) -> DataFrame:
        values = [_comparable(df, c, as_text) for c in names]
        empty = [F.lit(None)] * len(names)
        old, new = (values, empty) if is_before else (empty, values)
        return df.select(
            *map(cols.ref, keys),
            F.lit(int(is_before)).alias("__b"),
            F.lit(int(not is_before)).alias("__a"),
            *[v.alias(f"{i}_b") for i, v in enumerate(old)],
            *[v.alias(f"{i}_a") for i, v in enumerate(new)],
        )

    return (
        side(before, True)
        .unionByName(side(after, False))
        .groupBy(*map(cols.ref, keys))
        .agg(
            F.sum("__b").alias("rows_before"),
            F.sum("__a").alias("rows_after"),
            *[F.max(f"{i}_{s}").alias(f"{i}_{s}") for i in range(len(names)) for s in "ba"],
        )
    )


def _types_differ(before: DataFrame, after: DataFrame, names: Sequence[str]) -> bool:
    return any(
        cols.is_numeric(cols.type_of(before, c)) != cols.is_numeric(cols.type_of(after, c))
        and cols.type_of(before, c) != cols.type_of(after, c)
        for c in names
    )


def compare_tables(
    before: DataFrame, after: DataFrame, keys: Sequence[str], as_text: bool | None = None
) -> DataFrame:
    """Changed values per common column (nulls equal), among rows whose key both sides hold.

    A key that a side holds several times has no row-to-row order: its values are compared
    as counted sets, so that as many rows are compared as the shorter side has, and those
    without an equal value on the other side are changed.  ``as_text`` compares values as
    text; by default only where the types differ.
    """
    before, after = cols.nan_to_null(before), cols.nan_to_null(after)
    names = common_columns(before, after, keys)
    if as_text is None:
        as_text = _types_differ(before, after, names)
    aligned = align(before, after, keys, names, as_text)
    paired = (F.col("rows_before") == 1) & (F.col("rows_after") == 1)
    changed = {
        c: F.count(F.when(paired & ~F.col(f"`{i}_b`").eqNullSafe(F.col(f"`{i}_a`")), 1))
        for i, c in enumerate(names)
    }
    several = (F.col("rows_before") >= 1) & (F.col("rows_after") >= 1) & ~paired
    compared = F.coalesce(F.sum(F.when(several | paired, F.least("rows_before", "rows_after"))), F.lit(0))
    repeated = F.coalesce(F.sum(F.when(several, F.least("rows_before", "rows_after"))), F.lit(0))
    counts = cols.rows_from_aggregate(
        aligned,
        [(c, {"compared": compared, "repeated": repeated, "changed": n}) for c, n in changed.items()],
    )
    equal = _equal_values(before, after, keys, names, aligned.where(several).select(*map(cols.ref, keys)))
    number = F.create_map(*[F.lit(x) for i, c in enumerate(names) for x in (c, i)])
    counts = counts.withColumn("number", number[F.col("column")])
    values_changed = F.col("changed") + F.col("repeated") - F.coalesce("equal", F.lit(0))
    return counts.join(equal, "number", "left").select(
        "column",
        values_changed.alias("values_changed"),
        F.coalesce(
            F.round(values_changed / F.nullif(F.col("compared"), F.lit(0)) * 100, 2), F.lit(0.0)
        ).alias("change_pct"),
    )


def _equal_values(
    before: DataFrame, after: DataFrame, keys: Sequence[str], names: Sequence[str], repeated: DataFrame
) -> DataFrame:
    """(number, equal): values of each column that repeated keys hold on both sides, counted.

    Null keys group with null keys, as in ``align``.
    """
    renamed = repeated.select(*[cols.ref(k).alias(f"__{i}") for i, k in enumerate(keys)])

    def side(df: DataFrame, is_before: bool) -> DataFrame:
        same = [cols.ref(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)]
        rows = df.join(renamed, reduce(and_, same), "left_semi")
        cells = F.array(*[F.struct(F.lit(i).alias("number"), cols.as_text(df, c).alias("value")) for i, c in enumerate(names)])
        return rows.select(*map(cols.ref, keys), F.inline(cells)).withColumn("__b", F.lit(int(is_before)))

    both = side(before, True).unionByName(side(after, False))
    counted = both.groupBy(*map(cols.ref, keys), "number", "value").agg(
        F.count_if(F.col("__b") == 1).alias("b"), F.count_if(F.col("__b") == 0).alias("a")
    )
    return counted.groupBy("number").agg(F.sum(F.least("a", "b")).alias("equal"))


def compare_summary(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows of both sides, keys added, removed, repeated, and column counts."""
    aligned = align(before, after, keys, [], False)
    left, right = set(before.columns), set(after.columns)
    return aligned.agg(
        F.coalesce(F.sum("rows_before"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("rows_after"), F.lit(0)).alias("rows_after"),
        F.count(F.when(F.col("rows_before") == 0, 1)).alias("keys_added"),
        F.count(F.when(F.col("rows_after") == 0, 1)).alias("keys_removed"),
        F.count(F.when((F.col("rows_before") > 1) | (F.col("rows_after") > 1), 1)).alias(
            "repeated_keys"
        ),
        F.lit(len(right - left)).cast("bigint").alias("columns_added"),
        F.lit(len(left - right)).cast("bigint").alias("columns_removed"),
        F.lit(len(left & right)).cast("bigint").alias("columns_common"),
    )


def change_preview(
    before: DataFrame, after: DataFrame, keys: Sequence[str], max_rows: int = 50, as_text: bool = True
) -> DataFrame:
    """Per key of the first ``max_rows`` rows: names of the changed columns.

    The preview is the feature: both sides are cut to their first rows in key order.
    """
    order = [cols.ref(k) for k in keys]
    names = common_columns(before, after, keys)
    aligned = align(
        before.orderBy(*order).limit(max_rows), after.orderBy(*order).limit(max_rows), keys, names, as_text
    )
    flagged = F.array(
        *[
            F.when(~F.col(f"`{i}_b`").eqNullSafe(F.col(f"`{i}_a`")), F.lit(c))
            for i, c in enumerate(names)
        ]
    ).cast("array<string>")
    one_sided = sorted(set(before.columns) ^ set(after.columns))
    changed = F.concat(
        F.filter(flagged, lambda c: c.isNotNull()), F.array(*map(F.lit, one_sided)).cast("array<string>")
    )
    return aligned.select(
        *order, changed.alias("changed_columns"), F.size(changed).cast("bigint").alias("changed_cells")
    )
