"""Profiles: column statistics, missingness, correlations and descriptive statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from tablemeld import columns as cols
from tablemeld.functions.fixed_values import OUTLIER_STD, SCALE_BANDS
from tablemeld.operators import levels as lv
from tablemeld.operators.counted import Counts
from tablemeld.operators.products import correlation_pairs
from tablemeld.functions.values import lookup
from tablemeld.operators.facts import (
    ColumnFacts, approximate_levels, exact_quantiles, fit_facts, medians,
)

#: Share of distinct values below which a text column counts as categorical.
CATEGORICAL_SHARE = 0.05
#: The looser share used when metadata is generated from data.
GENERATED_CATEGORICAL_SHARE = 0.10

_FACTS_SCHEMA = (
    "ord int, column string, data_type string, kind string, total_count bigint, "
    "non_null_count bigint, null_count bigint, mean double, std double, min double, max double, "
    "median double, avg_length double, max_length int, min_length int"
)


def facts_table(
    df: DataFrame,
    facts: Mapping[str, ColumnFacts],
    median: Mapping[str, float | None] | None = None,
) -> DataFrame:
    """Facts as one row per column."""
    median = median or {}
    rows = [
        (
            i, f.column, cols.type_of(df, f.column).simpleString(), f.kind, f.rows, f.present,
            f.missing, f.mean, f.std, f.low, f.high, median.get(f.column), f.avg_length,
            f.max_length, f.min_length,
        )
        for i, f in enumerate(facts.values())
    ]
    return df.sparkSession.createDataFrame(rows, _FACTS_SCHEMA).coalesce(1)


def inferred_type(kind: Column, unique: Column, present: Column, share: float) -> Column:
    """Semantic type: text with few distinct values per row is categorical."""
    few = (present > 0) & (unique / present < share)
    return F.when((kind == "string") & few, F.lit("categorical")).otherwise(kind)


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100, digits)).otherwise(F.lit(0.0))


def column_statistics(
    df: DataFrame,
    approx: bool = False,
    facts: Mapping[str, ColumnFacts] | None = None,
    categorical_share: float = CATEGORICAL_SHARE,
    quantiles: Mapping[str, Mapping[float, float]] | None = None,
    counts: Counts | None = None,
) -> DataFrame:
    """One row per column: counts, missingness, distinct values, moments, text lengths.

    All of it comes from one counted table, ``counts`` if it is at hand.  ``approx=True`` takes
    distinct counts and medians from fixed-size sketches and writes nothing.
    """
    df = cols.nan_to_null(df)
    if not approx and facts is None and quantiles is None:
        counts = counts or Counts.of(df)
    if counts is not None:
        facts = facts or counts.facts()
    facts = facts or fit_facts(df)
    if counts is not None and not approx:
        middle = {c: q[0.5] for c, q in quantiles.items()} if quantiles else counts.medians()
        unique = counts.distinct()
        table = facts_table(df, facts, middle).withColumn(
            "unique_count", lookup(F.col("column"), {c: str(n) for c, n in unique.items()}).cast("bigint")
        )
    elif approx:
        unique = approximate_levels(df, facts)
        table = facts_table(df, facts, _approx_medians(df, facts)).withColumn(
            "unique_count", lookup(F.col("column"), {c: str(n) for c, n in unique.items()}).cast("bigint")
        )
    else:
        unique = lv.level_counts(df, list(facts)).groupBy("column").agg(
            F.count(F.lit(1)).alias("unique_count")
        )
        middle = {c: q[0.5] for c, q in quantiles.items()} if quantiles else medians(df, facts)
        table = facts_table(df, facts, middle).join(unique, "column", "left").withColumn(
            "unique_count", F.coalesce("unique_count", F.lit(0))
        )
    return table.select(
        "ord",
        "column",
        "data_type",
        inferred_type(
            F.col("kind"), F.col("unique_count"), F.col("non_null_count"), categorical_share
        ).alias("inferred_type"),
        "total_count",
        "non_null_count",
        "null_count",
        pct(F.col("null_count"), F.col("total_count")).alias("null_pct"),
        "unique_count",
        pct(F.col("unique_count"), F.col("non_null_count")).alias("unique_pct"),
        "mean",
        "std",
        "min",
        "max",
        "median",
        "avg_length",
        "max_length",
        "min_length",
    )


def fit_quartiles(
    df: DataFrame, facts: Mapping[str, ColumnFacts]
) -> dict[str, dict[float, float | None]]:
    """Exact quartiles of every numeric column, fitted together."""
    return exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c, f in facts.items() if f.numeric}, facts)


def _approx_medians(df: DataFrame, facts: Mapping[str, ColumnFacts]) -> dict[str, float | None]:
    names = [c for c, f in facts.items() if f.numeric]
    found: dict[str, float | None] = {}
    for group in cols.batches(names, cols.EXPRESSIONS_PER_JOB):
        row = df.agg(
            *[F.percentile_approx(cols.as_double(df, c), 0.5).alias(str(i)) for i, c in enumerate(group)]
        ).first()
        found |= {c: row[i] for i, c in enumerate(group)}
    return found


def _nulls_in_row(df: DataFrame) -> Column:
    return sum((cols.ref(c).isNull().cast("int") for c in df.columns), F.lit(0))


def missing_histogram(df: DataFrame, k: int | None = 10) -> DataFrame:
    """How many rows miss how many fields, the k most frequent counts."""
    df = cols.nan_to_null(df)
    counted = df.groupBy(_nulls_in_row(df).alias("missing_fields")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    ordered = counted.orderBy(F.desc("rows"), F.asc("missing_fields"))
    return ordered if k is None else ordered.limit(k)


def missing_by_column(df: DataFrame) -> DataFrame:
    """Missing count and percentage of every column, in one scan."""
    df = cols.nan_to_null(df)
    total = F.count(F.lit(1))
    return cols.rows_from_aggregate(
        df,
        [(c, {"total": total, "present": F.count(cols.ref(c))}) for c in df.columns],
    ).select(
        "column",
        (F.col("total") - F.col("present")).alias("missing_count"),
        pct(F.col("total") - F.col("present"), F.col("total")).alias("missing_pct"),
    )


def missing_summary(df: DataFrame, k: int = 20) -> DataFrame:
    """Columns with missing values, the k worst first."""
    df = cols.nan_to_null(df)
    return (
        missing_by_column(df)
        .where(F.col("missing_count") > 0)
        .orderBy(F.desc("missing_count"), F.asc("column"))
        .limit(k)
    )


def correlations(df: DataFrame, k: int | None = 10, names: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of numeric column pairs, strongest first, in one scan.

    Rows with a null in a pair are left out of that pair only.  A few pairs are built-in aggregates,
    many come from cross products of the columns.
    """
    df = cols.nan_to_null(df)
    names = list(names or cols.numeric_columns(df))
    pairs = list(combinations(names, 2))
    schema = "column_a string, column_b string, correlation double"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    if len(pairs) > cols.EXPRESSIONS_PER_JOB:
        found = correlation_pairs(df, names)
    else:
        wide = df.agg(*[F.corr(cols.as_double(df, a), cols.as_double(df, b)).alias(str(i)) for i, (a, b) in enumerate(pairs)])
        rows = [
            F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"`{i}`").alias("correlation"))
            for i, (a, b) in enumerate(pairs)
        ]
        found = wide.select(F.inline(F.array(*rows))).where(F.col("correlation").isNotNull() & ~F.isnan("correlation"))
    if k is None:
        return found
    return found.orderBy(F.desc(F.abs("correlation")), "column_a", "column_b").limit(k)


def scale_band(low: Column, high: Column) -> Column:
    """First response-scale band that holds all values, else ``mixed``."""
    band = F.lit(None).cast("string")
    for label, start, end in reversed(SCALE_BANDS):
        band = F.when((low >= start) & (high <= end), F.lit(label)).otherwise(band)
    return F.when(low.isNull(), F.lit("unknown")).otherwise(F.coalesce(band, F.lit("mixed")))


def outlier_condition(value: Column, fact: ColumnFacts, limit: float = OUTLIER_STD) -> Column:
    """|z| above the limit; a zero standard deviation counts as one."""
    if fact.mean is None or fact.std is None:
        return F.lit(False)
    return F.abs((value - fact.mean) / (fact.std or 1.0)) > limit


def descriptive_stats(
    df: DataFrame,
    dataset: str,
    facts: Mapping[str, ColumnFacts] | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Statistics per column: moments, mode, outliers, scale band, top values."""
    df = cols.nan_to_null(df)
    facts = facts or fit_facts(df)
    numeric = [c for c, f in facts.items() if f.numeric]
    levels = lv.level_counts(df, list(facts))
    table = (
        facts_table(df, facts, medians(df, facts))
        .join(lv.level_summary(levels, numeric), "column", "left")
        .join(lv.distributions(levels), "column", "left")
    )
    if numeric:
        outliers = cols.rows_from_aggregate(
            df,
            [
                (
                    c,
                    {
                        "outlier_count": F.count(
                            F.when(outlier_condition(cols.as_double(df, c), facts[c]), 1)
                        )
                    },
                )
                for c in numeric
            ],
        )
        table = table.join(outliers, "column", "left")
    else:
        table = table.withColumn("outlier_count", F.lit(None).cast("bigint"))
    is_number = F.col("kind").isin("integer", "float")
    unique = F.coalesce("unique_count", F.lit(0))
    result = table.select(
        F.lit(dataset).alias("dataset"),
        "ord",
        "column",
        inferred_type(F.col("kind"), unique, F.col("non_null_count"), CATEGORICAL_SHARE).alias(
            "inferred_type"
        ),
        pct(F.col("null_count"), F.col("total_count")).alias("missing_pct"),
        unique.alias("unique_count"),
        "mean",
        "median",
        F.when(is_number, F.expr("CAST(try_cast(mode AS double) AS string)"))
        .otherwise(F.col("mode"))
        .alias("mode"),
        "min",
        "max",
        F.when(is_number & (F.col("non_null_count") == 1), F.lit(0.0))
        .otherwise(F.col("std"))
        .alias("std"),
        "outlier_count",
        F.when(is_number, scale_band(F.col("min"), F.col("max"))).alias("scale_consistency"),
        F.when(~is_number, F.col("distribution")).alias("distribution"),
    )
    if max_rows is None:
        return result
    return result.orderBy("dataset", "ord").limit(max_rows)


def aggregate_summary(df: DataFrame, k: int = 5) -> DataFrame:
    """Compact summary: missing share, range, mean and top-k values per column."""
    df = cols.nan_to_null(df)
    facts = fit_facts(df)
    levels = lv.level_counts(df)
    return (
        facts_table(df, facts)
        .join(lv.distributions(levels, k), "column", "left")
        .select(
            "ord", "column", "data_type", "non_null_count", "null_count",
            pct(F.col("null_count"), F.col("total_count"), 4).alias("null_pct"),
            "min", "max", "mean", F.col("distribution").alias("top_values"),
        )
    )


def source_schema(
    df: DataFrame, labels: DataFrame | None = None, samples: int = 5
) -> DataFrame:
    """Schema extract: type, counts and sample values per column, with variable labels."""
    df = cols.nan_to_null(df)
    facts = fit_facts(df)
    levels = lv.level_counts(df)
    unique = levels.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    table = (
        facts_table(df, facts)
        .join(unique, "column", "left")
        .join(lv.sample_values(levels, samples), "column", "left")
    )
    if labels is not None:
        table = table.join(F.broadcast(labels.select("column", "label")), "column", "left")
    else:
        table = table.withColumn("label", F.lit(None).cast("string"))
    unique_count = F.coalesce("unique_count", F.lit(0))
    return table.select(
        "ord", "column", "data_type",
        inferred_type(F.col("kind"), unique_count, F.col("non_null_count"), CATEGORICAL_SHARE).alias(
            "inferred_type"
        ),
        "non_null_count", "null_count",
        pct(F.col("null_count"), F.col("total_count")).alias("null_pct"),
        unique_count.alias("unique_count"),
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        "min", "max", "mean", "label",
    )


def structural_profile(
    df: DataFrame,
    order_by: Sequence[str],
    sample_rows: int = 5,
    max_levels: int = 20,
) -> dict[str, DataFrame]:
    """Structural scan as tables: head, tail, columns, levels, missing patterns, correlations.

    Tables have no row order, so head and tail follow ``order_by``.
    """
    numeric = F.col("data_type").isin(
        sorted({cols.type_of(df, c).simpleString() for c in cols.numeric_columns(df)} or {""})
    )
    order = [cols.ref(c) for c in order_by]
    levels = lv.level_counts(
        df, [c for c in df.columns if not cols.is_numeric(cols.type_of(df, c))]
    )
    columns = column_statistics(df)
    return {
        "columns": columns.withColumn(
            "scale_range", F.when(numeric, F.col("max") - F.col("min"))
        ).withColumn(
            "std",
            F.when(numeric & (F.col("non_null_count") == 1), F.lit(0.0)).otherwise(F.col("std")),
        ),
        "levels": lv.top_values(levels, max_levels),
        "head": df.orderBy(*order).limit(sample_rows),
        "tail": df.orderBy(*[o.desc() for o in order]).limit(sample_rows),
        "missing_by_row": missing_histogram(df),
        "missing_by_column": missing_by_column(df),
        "correlations": correlations(df),
    }


def percentile_bounds(
    df: DataFrame, names: Sequence[str], probabilities: Sequence[float]
) -> dict[str, dict[float, float | None]]:
    """Exact quantiles of several columns."""
    return exact_quantiles(df, {c: list(probabilities) for c in names}, fit_facts(df, names))
