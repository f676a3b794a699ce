"""Harmonize one table in a fixed order of steps, as fit and apply.

Order: impute, drop columns and rows, rename, clean text, convert scale, region,
country, date, category, numbers.  Later steps see the result of earlier ones, so
the fit runs the steps once over the data and keeps their parameters; the apply
replays them without looking at the data again.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tablemeld import columns as cols
from tablemeld.functions import fixed_values as fv, names, scales
from tablemeld.operators import impute as im, memory as me, quality as ql, transform as tf
from tablemeld.operators.facts import fit_facts
from tablemeld.operators.profile import column_statistics


@dataclass(frozen=True)
class Options:
    """What to do; the defaults are the reference behaviour."""

    column_strategies: Mapping[str, str] = field(default_factory=dict)
    default_numeric: str = "Replace with MEAN"
    default_text: str = "Replace with 'Unknown'"
    remove_missing_rows: bool = False
    standardize_cols: bool = True
    remove_special: bool = True
    normalize_separators: bool = True
    scale_conversion: str | None = None  # "1-5", "1-7", "1-10" or "nps"
    region_mapping: bool = True
    country_mapping: bool = True
    date_standardize: bool = True
    category_mapping: bool = True
    auto_numeric: bool = True


@dataclass(frozen=True)
class LocalPlan:
    """Fitted steps."""

    options: Options
    impute: im.ImputePlan
    scaled: tuple[str, ...]
    date_patterns: Mapping[str, str]
    numeric: tuple[str, ...]
    log: tuple[tuple[str, str], ...]


def _names(df: DataFrame, options: Options) -> DataFrame:
    if not options.standardize_cols:
        return df
    return tf.standardize_names(df, options.remove_special)


def _cleaned(df: DataFrame, options: Options) -> DataFrame:
    """Accented country names are mapped before cleaning drops their accents."""
    if options.country_mapping:
        df = tf.standardize_codes(df, "country")
    if options.remove_special:
        df = tf.clean_text_columns(df, normalize_separators=options.normalize_separators)
    return df


def _scaled(df: DataFrame, options: Options, names_: tuple[str, ...]) -> DataFrame:
    if not names_:
        return df
    change = {
        c: scales.nps_category(cols.ref(c))
        if options.scale_conversion == "nps"
        else scales.fixed(cols.ref(c), options.scale_conversion)
        for c in names_
    }
    return df.withColumns(change)


def _coded(df: DataFrame, options: Options) -> DataFrame:
    if options.region_mapping:
        df = tf.standardize_codes(df, "region")
    if options.country_mapping:
        df = tf.standardize_codes(df, "country")
    return tf.repair_separators(df) if options.date_standardize else df


def _until_scale(df: DataFrame, options: Options, plan: im.ImputePlan) -> DataFrame:
    return _cleaned(_names(im.apply_plan(df, plan), options), options)


def fit(df: DataFrame, options: Options | None = None) -> LocalPlan:
    """Fit every data-dependent step with a few aggregate jobs."""
    options = options or Options()
    facts = fit_facts(df)
    imputation = im.fit_strategies(
        df, options.column_strategies, options.default_numeric, options.default_text,
        options.remove_missing_rows, facts,
    )
    prepared = _until_scale(df, options, imputation)
    scaled: tuple[str, ...] = ()
    if options.scale_conversion:
        found = fit_facts(prepared, cols.numeric_columns(prepared))
        scaled = tuple(tf.fixed_scale_columns(found, options.scale_conversion))
    coded = _coded(_scaled(prepared, options, scaled), options)
    patterns = tf.fit_dates(coded) if options.date_standardize else {}
    dated = tf.standardize_dates(coded, patterns) if options.date_standardize else coded
    final = tf.standardize_codes(dated, "category") if options.category_mapping else dated
    numeric = tuple(tf.fit_numeric(final)) if options.auto_numeric else ()
    log = [(f"impute:{c}", f.strategy) for c, f in imputation.fills.items()]
    log += [("drop column", c) for c in imputation.drop_columns]
    log += [("remove rows", c) for c in imputation.remove_rows]
    renamed = names.standardized(df.columns, options.remove_special)
    if options.standardize_cols:
        log += [("rename", f"{a} -> {b}") for a, b in zip(df.columns, renamed) if a != b]
    log += [("scale", f"{c}: {options.scale_conversion}") for c in scaled]
    for on, kind, words in (
        (options.region_mapping, "region", fv.REGION_WORDS),
        (options.country_mapping, "country", fv.COUNTRY_WORDS),
        (options.category_mapping, "category", fv.CATEGORY_WORDS),
    ):
        if on:
            log += [
                (kind, c) for c in cols.columns_like(final, words) if cols.is_text(cols.type_of(final, c))
            ]
    log += [("date", f"{c}: {p}") for c, p in patterns.items()]
    log += [("numeric", c) for c in numeric]
    return LocalPlan(options, imputation, scaled, patterns, numeric, tuple(log))


def apply(df: DataFrame, plan: LocalPlan) -> DataFrame:
    """Replay fitted steps; lazy, stateless, works on streams."""
    o = plan.options
    result = _coded(_scaled(_until_scale(df, o, plan.impute), o, plan.scaled), o)
    if o.date_standardize:
        result = tf.standardize_dates(result, plan.date_patterns)
    if o.category_mapping:
        result = tf.standardize_codes(result, "category")
    return tf.to_numeric(result, plan.numeric)


def change_log(spark, plan: LocalPlan) -> DataFrame:
    """(step, detail) in the order of the steps."""
    rows = [(i, s, d) for i, (s, d) in enumerate(plan.log)]
    return spark.createDataFrame(rows, "ord int, step string, detail string")


def harmonize(df: DataFrame, options: Options | None = None) -> DataFrame:
    return apply(df, fit(df, options))


def run(
    df: DataFrame, options: Options | None = None, format_fixes: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Replay learned fixes, harmonize, then score the result and describe its columns."""
    if format_fixes is not None:
        df = me.replay_format_fixes(df, format_fixes)
    plan = fit(df, options)
    harmonized = apply(df, plan)
    return {
        "harmonized": harmonized,
        "changes": change_log(df.sparkSession, plan),
        "score": ql.simple_score(harmonized),
        "columns": column_statistics(harmonized).select(
            "column", "data_type", "null_count",
            F.col("null_pct").alias("null_percentage"), "total_count", "unique_count",
        ),
    }
