"""Distinct values (levels) per column: one shuffle feeds counts, modes and top-k.

``level_counts`` is the only wide step.  Partial aggregation collapses hot values
before the shuffle, and every later step groups by column with a bounded buffer:
counts and modes are plain aggregates, and ``row_number() <= k`` is limited to k
rows per column before its shuffle (WindowGroupLimit).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tablemeld import columns as cols


def level_counts(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(column, value, count) of every distinct non-null value, values as text.

    Whole numbers and doubles are counted as they are, and become text afterwards:
    eight-byte keys hash and shuffle faster than their text.
    """
    df = cols.nan_to_null(df)
    names = list(df.columns if names is None else names)
    whole = [c for c in names if isinstance(cols.type_of(df, c), cols.INTEGRAL)]
    real = [c for c in names if isinstance(cols.type_of(df, c), (T.FloatType, T.DoubleType))]
    other = [c for c in names if c not in whole and c not in real]
    parts = [
        count_values(df, group, value).withColumn("value", F.col("value").cast("string"))
        for group, value in (
            (whole, lambda d, c: cols.ref(c).cast("bigint")),
            (real, cols.as_double),
            (other, cols.as_text),
        )
        if group
    ]
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, value string, count bigint")
    return cols.union_by_name(parts)


def count_values(df: DataFrame, names: Sequence[str], value) -> DataFrame:
    """(column, value, count) with the values in the type that ``value`` gives them."""
    return cols.to_long(df, names, value).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("count")
    )


def _numeric_order():
    """Numbers order as numbers, everything else as text."""
    return F.expr("try_cast(value AS double)")


def level_summary(levels: DataFrame, numeric: Sequence[str] = ()) -> DataFrame:
    """(column, unique_count, mode): ties of the mode go to the smallest value."""
    number = F.when(F.col("column").isin(list(numeric)), _numeric_order())
    order = F.struct((-F.col("count")).alias("c"), number.alias("n"), F.col("value").alias("v"))
    return levels.groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_count"), F.min_by("value", order).alias("mode")
    )


def modes(df: DataFrame, names: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per column as text; a few rows, so it returns to the driver."""
    if not names:
        return {}
    numeric = [c for c in names if cols.is_numeric(cols.type_of(df, c))]
    found = {
        r["column"]: r["mode"] for r in level_summary(level_counts(df, names), numeric).collect()
    }
    return {c: found.get(c) for c in names}


def top_values(levels: DataFrame, k: int | None = 10) -> DataFrame:
    """(column, rank, value, count): the k most frequent values of every column, or all."""
    order = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    ranked = levels.withColumn("rank", F.row_number().over(order)).select("column", "rank", "value", "count")
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def sample_values(levels: DataFrame, k: int = 5) -> DataFrame:
    """(column, sample_values): the k smallest distinct values as an array."""
    order = Window.partitionBy("column").orderBy("value")
    return (
        levels.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .groupBy("column")
        .agg(F.sort_array(F.collect_list("value")).alias("sample_values"))
    )


def distributions(levels: DataFrame, k: int = 5) -> DataFrame:
    """(column, distribution): top-k values and counts as a JSON object."""
    entries = F.sort_array(F.collect_list(F.struct("rank", "value", "count")))
    as_map = F.map_from_entries(
        F.transform(entries, lambda e: F.struct(e["value"].alias("key"), e["count"].alias("value")))
    )
    return top_values(levels, k).groupBy("column").agg(F.to_json(as_map).alias("distribution"))


def allowed_values(levels: DataFrame, max_levels: int) -> DataFrame:
    """(column, values): sorted levels of the columns that have at most ``max_levels``."""
    order = Window.partitionBy("column").orderBy("value")
    return (
        levels.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= max_levels + 1)
        .groupBy("column")
        .agg(F.sort_array(F.collect_list("value")).alias("values"))
        .where(F.size("values") <= max_levels)
    )
