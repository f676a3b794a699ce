"""Structural validation, quality and harmonization of one table against a schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tablemeld import columns as cols
from tablemeld.functions.fixed_values import VALID_SCHEMA_CONFIDENCE
from tablemeld.operators import match as ma, profile as pr, quality as ql, transform as tf
from tablemeld.operators.counted import Counts
from tablemeld.operators.validate import business_issues
from tablemeld.sources.metadata import MasterSchema


def structural_validation(
    df: DataFrame,
    schema: MasterSchema,
    proposals: DataFrame | None = None,
    threshold: float = VALID_SCHEMA_CONFIDENCE,
    statistics: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Column mappings, drift, type mismatches and the validation row."""
    statistics = pr.source_schema(df) if statistics is None else statistics
    mappings = ma.match_columns(ma.column_table(df), schema)
    if proposals is not None:
        mappings = ma.merge_mappings(mappings, proposals)
    mismatches = ma.type_mismatches(mappings, statistics, schema)
    drift = ma.schema_drift(mappings, schema)
    return {
        "mappings": mappings,
        "drift": drift,
        "type_mismatches": mismatches,
        "validation": ma.validation_result(mappings, drift, mismatches, threshold),
    }


def quality_analysis(df: DataFrame, rule_texts: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Statistics, issues and score of a table."""
    counts = Counts.of(df)
    facts, quantiles = counts.facts(), counts.quartiles()
    statistics = pr.column_statistics(df, facts=facts, quantiles=quantiles, counts=counts)
    extra = business_issues(df, rule_texts) if rule_texts else None
    issues = ql.detect_issues(df, statistics, facts, extra, quantiles)
    return {"statistics": statistics} | ql.quality_report(statistics, issues)


@dataclass(frozen=True)
class HarmonizePlan:
    """Fitted projection to the master schema."""

    sources: Mapping[str, str]
    transforms: Mapping[str, tf.Transform]
    required: tuple[tuple[str, str, str | None], ...]
    order: tuple[str, ...]
    warnings: tuple[str, ...]


def fit_harmonization(
    df: DataFrame,
    pairs: Sequence[tuple[str, str]],
    schema: MasterSchema,
    value_maps: Mapping[str, Mapping[str, str]] | None = None,
    scale_bounds: str = "observed",
    detect_mixed: bool = False,
) -> HarmonizePlan:
    """Choose a transform per mapped column from its facts and the schema."""
    _, sources, warnings = tf.project_mapping(df, pairs)
    transforms = tf.choose_transforms(
        df, sources, schema, value_maps or {}, scale_bounds=scale_bounds, detect_mixed=detect_mixed
    )
    required = tuple((c.name, c.data_type, c.default_value) for c in schema.columns if c.is_required)
    return HarmonizePlan(sources, transforms, required, tuple(schema.names), tuple(warnings))


def apply_harmonization(df: DataFrame, plan: HarmonizePlan) -> DataFrame:
    """One projection to the mapped columns, required columns added, schema order."""
    projected = tf.apply_transforms(df, plan.sources, plan.transforms)
    completed, _ = tf.add_required(projected, plan.required)
    return tf.reorder(completed, plan.order)


def harmonization_summary(before: DataFrame, after: DataFrame, plan: HarmonizePlan) -> DataFrame:
    """One row: records, transforms without losses, and column changes."""
    outcomes = tf.transform_outcomes(before, plan.sources, plan.transforms)
    added = [c for c in after.columns if c not in plan.sources]
    removed = [c for c in before.columns if c not in plan.sources.values()]
    renamed = [f"{s} -> {t}" for t, s in plan.sources.items() if s != t]

    def names(items: list[str]):
        return F.array(*map(F.lit, items)).cast("array<string>")

    done = F.count(F.when(F.col("records_failed") == 0, 1))
    return outcomes.agg(
        F.max("records").alias("input_records"),
        F.max("records").alias("output_records"),
        done.alias("columns_without_failure"),
        F.sum("records_failed").alias("records_failed"),
        (done / F.count(F.lit(1))).alias("confidence_score"),
    ).select(
        "*",
        F.lit(0).cast("bigint").alias("records_dropped"),
        names(added).alias("columns_added"),
        names(removed).alias("columns_removed"),
        names(renamed).alias("columns_renamed"),
        names(list(plan.warnings)).alias("warnings"),
    )


def stringified(df: DataFrame) -> DataFrame:
    """Every column as text, for side-by-side views."""
    return df.select(*[cols.as_text(df, c).alias(c) for c in df.columns])
