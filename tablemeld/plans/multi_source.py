"""Several sources of one subject: harmonize each, calibrate, cross-match, combine."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablemeld.columns import is_numeric, union_by_name
from tablemeld.functions.fixed_values import MARKET_COLUMNS, RECORD_ID_COLUMNS
from tablemeld.functions.values import merge_value_maps
from tablemeld.operators import (
    calibrate as ca, impute as im, levels as lv, match as ma, memory as me, profile as pr,
    validate as va,
)
from tablemeld.plans import reports as rp
from tablemeld.plans.results import Results
from tablemeld.sources.metadata import MasterSchema, value_map_table
from tablemeld.sources.tables import combine, read_statistics, read_table, write_combined
from tablemeld.storage import materialize, path_exists


#: Tables that a run adds to what was learned.
LEARNED = ("datasets", "schema_diffs", "learned_mappings", "level_suggestions")


@dataclass(frozen=True)
class Settings:
    confidence_threshold: float = 0.85
    scale_bounds: str = "observed"
    #: None: the shared market, vendor and wave columns.
    group_columns: Sequence[str] | None = None
    replace_value_maps: bool = False
    #: Keep only the first row-missing flags per data set.
    row_flag_limit: int | None = None
    max_levels: int = 20
    max_statistics_rows: int | None = None


@dataclass(frozen=True)
class SourceResult:
    """One harmonized source; its tables are built on access."""

    raw: DataFrame
    harmonized: DataFrame
    mappings: DataFrame
    imputation: DataFrame
    tables: Mapping[str, DataFrame]


def harmonize_source(
    df: DataFrame,
    name: str,
    schema: MasterSchema,
    value_maps: Mapping[str, Mapping[str, str]],
    rules: Sequence[va.Rule],
    settings: Settings,
) -> SourceResult:
    """Profile, match, harmonize, impute and flag one source."""
    mappings = ma.match_columns(ma.column_table(df), schema)
    plan = rp.fit_harmonization(
        df, ma.mapping_pairs(mappings), schema, value_maps, settings.scale_bounds
    )
    imputed, summary = im.impute_typed(rp.apply_harmonization(df, plan), name)
    harmonized = materialize(imputed, f"harmonized-{name}")

    def flags() -> DataFrame:
        record_id = va.record_id_column(harmonized)
        found = va.missing_flags(harmonized, name).unionByName(
            va.apply_rules(harmonized, rules, name, record_id)
        )
        if record_id is None:
            return found
        return found.unionByName(
            va.row_missing_flags(harmonized, name, record_id, settings.row_flag_limit)
        )

    textual = [f.name for f in df.schema.fields if not is_numeric(f.dataType)]

    def levels() -> DataFrame:
        return lv.top_values(lv.level_counts(df, textual), settings.max_levels)

    tables = Results(
        {
            "flags": flags,
            "profile_columns": lambda: pr.source_schema(df),
            "profile_levels": levels,
            "profile_missing_by_row": lambda: pr.missing_histogram(df),
            "datasets": lambda: me.dataset_row(df, name),
            "schema_diffs": lambda: ma.schema_difference(ma.column_table(df), schema, name),
            "learned_mappings": lambda: me.mapping_rows(mappings, name, settings.confidence_threshold),
            "level_suggestions": lambda: me.level_suggestions(
                lv.level_counts(df, textual), value_map_table(df.sparkSession, value_maps), name
            ),
        }
    )
    return SourceResult(df, harmonized, mappings, summary, tables)


def run(
    sources: Mapping[str, DataFrame],
    schema: MasterSchema,
    value_maps: Mapping[str, Mapping[str, str]] | None = None,
    rules: Sequence[va.Rule] = (),
    baseline: DataFrame | None = None,
    settings: Settings = Settings(),
) -> Results:
    """All result tables of a multi-source run.

    ``sources`` may hold ``historical``, ``current`` and ``incremental``; the
    historical table is calibrated to the current one.
    """
    maps = merge_value_maps(value_maps or {}, replace=settings.replace_value_maps)
    done = {
        name: harmonize_source(df, name, schema, maps, rules, settings) for name, df in sources.items()
    }
    frames = {name: r.harmonized for name, r in done.items()}
    builders: dict[str, Callable[[], DataFrame]] = {}
    paired = "historical" in frames and "current" in frames
    if paired:
        historical, current = frames["historical"], frames["current"]
        groups = settings.group_columns
        if groups is None:
            groups = ca.calibration_groups(historical, current)
        keys = [c.name for c in schema.columns if c.is_key] + list(RECORD_ID_COLUMNS)
        fit = ca.fit_calibration(historical, current, groups, exclude=keys)
        fit = replace(fit, moments=materialize(fit.moments, "moments"))
        frames["historical"] = ca.apply_calibration(historical, fit)
        builders["calibration_report"] = lambda: ca.calibration_report(fit)
        builders["cross_dataset"] = lambda: ma.match_datasets(
            frames["historical"], current, threshold=settings.confidence_threshold
        )
        if ca.market_comparison(frames["historical"], current, MARKET_COLUMNS) is not None:
            builders["market_comparison"] = lambda: ca.market_comparison(
                frames["historical"], current, MARKET_COLUMNS
            )

    def statistics() -> DataFrame:
        found = union_by_name([pr.descriptive_stats(df, name) for name, df in frames.items()])
        if baseline is not None:
            labelled = baseline.withColumn("dataset", F.lit("baseline"))
            found = found.unionByName(labelled, allowMissingColumns=True)
        found = found.orderBy("dataset", "ord")
        return found if settings.max_statistics_rows is None else found.limit(settings.max_statistics_rows)

    def column_mappings() -> DataFrame:
        found = [
            me.mapping_rows(r.mappings, name, settings.confidence_threshold)
            .drop("dataset")
            .withColumn("table_name", F.lit(f"{name}_to_master"))
            for name, r in done.items()
        ]
        if paired:
            found.append(
                results["cross_dataset"]
                .select("source_column", "target_column", "confidence", "status")
                .withColumn("table_name", F.lit("historical_to_current"))
            )
        return union_by_name(found)

    builders |= {
        "combined": lambda: combine(frames),
        "descriptive_stats": statistics,
        "column_mappings": column_mappings,
        "imputation": lambda: union_by_name([r.imputation for r in done.values()]),
    }
    for table in ("flags", *LEARNED):
        builders[table] = lambda t=table: union_by_name([r.tables[t] for r in done.values()])
    for name in done:
        builders[f"{name}_harmonized"] = lambda name=name: frames[name]
    for name, r in done.items():
        for table in ("profile_columns", "profile_levels", "profile_missing_by_row"):
            builders[f"{name}_{table}"] = lambda r=r, t=table: r.tables[t]
    results = Results(builders)
    return results


def run_files(
    spark: SparkSession,
    paths: Mapping[str, str],
    schema: MasterSchema,
    output: str,
    memory: str | None = None,
    incremental_only: bool = False,
    run_id: str | None = None,
    baseline: str | None = None,
    **options: Any,
) -> Results:
    """A run on files: sources are read by extension, the combined table is written to ``output``.

    ``incremental_only`` harmonizes the incremental file alone and appends it to an output that is
    there already, which is neither read nor written again; without one all sources are written.
    What was learned goes to the folder ``memory``, once for each ``run_id``.
    """
    known = path_exists(spark, output)
    if incremental_only and known:
        if "incremental" not in paths:
            raise ValueError("an incremental run needs an incremental file")
        paths = {"incremental": paths["incremental"]}
    sources = {name: read_table(spark, path).data for name, path in paths.items()}
    stored = None if baseline is None else read_statistics(spark, baseline)
    result = run(sources, schema, baseline=stored, **options)
    frames = {name: result[f"{name}_harmonized"] for name in sources}
    write_combined(spark, frames, output, incremental_only)
    if memory is not None:
        remember(result, memory, run_id)
    return result


def remember(result: Mapping[str, DataFrame], folder: str, run: str | None = None) -> None:
    """Append what a run learned to the learned tables; repeated under the id of the run, it counts once."""
    for table in (*LEARNED, "column_mappings"):
        me.append(result[table], folder, table, run)
