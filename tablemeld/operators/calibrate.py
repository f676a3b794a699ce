"""Calibration of a source table to a reference per group, and market comparison."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tablemeld import columns as cols
from tablemeld.functions import fixed_values as fv
from tablemeld.operators.joins import lookup_join

_OVERALL = "__overall"


@dataclass(frozen=True)
class Calibration:
    """Group moments of both sides, one row per group."""

    groups: tuple[str, ...]
    columns: tuple[str, ...]
    moments: DataFrame


def calibration_groups(source: DataFrame, reference: DataFrame) -> list[str]:
    return cols.present(fv.CALIBRATION_GROUP_COLUMNS, source, reference)


def shared_numeric(source: DataFrame, reference: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        c for c in cols.numeric_columns(source) if c in reference.columns and c not in set(exclude)
    ]


def _with_groups(df: DataFrame, groups: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(groups)) if groups else (df.withColumn(_OVERALL, F.lit("overall")), [_OVERALL])


def group_moments(df: DataFrame, groups: Sequence[str], names: Sequence[str], prefix: str) -> DataFrame:
    """Rows, means and standard deviations per group (partial aggregation first)."""
    grouped, keys = _with_groups(df, groups)
    wanted = [F.count(F.lit(1)).alias(f"{prefix}_rows")]
    for i, c in enumerate(names):
        number = cols.as_double(df, c)
        wanted += [
            F.avg(number).alias(f"{prefix}_mean_{i}"),
            F.coalesce(F.stddev_samp(number), F.lit(0.0)).alias(f"{prefix}_std_{i}"),
        ]
    return grouped.groupBy(*map(cols.ref, keys)).agg(*wanted)


def fit_calibration(
    source: DataFrame,
    reference: DataFrame,
    groups: Sequence[str],
    names: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    min_rows: int = fv.CALIBRATION_MIN_ROWS,
) -> Calibration:
    """Moments of the groups that have enough rows on both sides.

    Groups with a null key never match, so their rows stay as they are.
    """
    names = list(shared_numeric(source, reference, [*exclude, *groups]) if names is None else names)
    keys = list(groups) or [_OVERALL]
    moments = (
        group_moments(source, groups, names, "s")
        .join(group_moments(reference, groups, names, "r"), keys)
        .where((F.col("s_rows") >= min_rows) & (F.col("r_rows") >= min_rows))
    )
    return Calibration(tuple(groups), tuple(names), moments)


def _shift_only(i: int) -> Column:
    return (F.col(f"s_std_{i}") == 0) | (F.col(f"r_std_{i}") == 0)


def apply_calibration(df: DataFrame, fit: Calibration) -> DataFrame:
    """Move each fitted group to the reference mean and standard deviation.

    A zero standard deviation on either side shifts the mean only.  Rows outside
    fitted groups keep their values.
    """
    keyed, keys = _with_groups(df, fit.groups)
    joined = lookup_join(keyed, fit.moments, keys, weight="s_rows")
    change = {}
    for i, c in enumerate(fit.columns):
        value = cols.as_double(df, c)
        centred = value - F.col(f"s_mean_{i}")
        scaled = F.when(_shift_only(i), centred).otherwise(
            centred / F.nullif(F.col(f"s_std_{i}"), F.lit(0.0)) * F.col(f"r_std_{i}")
        )
        known = F.col(f"s_mean_{i}").isNotNull() & F.col(f"r_mean_{i}").isNotNull()
        change[c] = F.when(known, scaled + F.col(f"r_mean_{i}")).otherwise(value)
    return joined.withColumns(change).select(*map(cols.ref, df.columns)) if change else df


def calibration_report(fit: Calibration) -> DataFrame:
    """One row per fitted group and column: moments of both sides and the method."""
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"s_mean_{i}").alias("source_mean"),
                F.col(f"r_mean_{i}").alias("reference_mean"),
                F.col(f"s_std_{i}").alias("source_std"),
                F.col(f"r_std_{i}").alias("reference_std"),
                F.when(_shift_only(i), "mean_shift").otherwise("mean_std").alias("method"),
            )
            for i, c in enumerate(fit.columns)
        ]
    )
    keys = [cols.ref(k) for k in fit.groups] or [F.col(_OVERALL).alias("group")]
    return fit.moments.select(*keys, F.inline(rows)).where(
        F.col("source_mean").isNotNull() & F.col("reference_mean").isNotNull()
    )


def calibrate(
    source: DataFrame, reference: DataFrame, groups: Sequence[str], exclude: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Calibrated source and its report."""
    fit = fit_calibration(source, reference, groups, exclude=exclude)
    return apply_calibration(source, fit), calibration_report(fit)


def market_comparison(
    historical: DataFrame,
    current: DataFrame,
    candidates: Sequence[str] = fv.MARKET_COLUMNS,
    names: Sequence[str] | None = None,
) -> DataFrame | None:
    """Mean of every shared numeric column per market, for both tables stacked."""
    market = cols.first_present(candidates, historical, current)
    names = list(shared_numeric(historical, current) if names is None else names)
    if market is None or not names:
        return None

    def means(df: DataFrame, dataset: str) -> DataFrame:
        return (
            df.where(cols.ref(market).isNotNull())
            .groupBy(cols.ref(market))
            .agg(*[F.avg(cols.as_double(df, c)).alias(c) for c in names])
            .withColumn("dataset", F.lit(dataset))
        )

    return means(historical, "historical").unionByName(means(current, "current"))
