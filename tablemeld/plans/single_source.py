"""One source against a master schema: match, assess, harmonize, compare, report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from tablemeld.operators import compare as cp, match as ma, quality as ql
from tablemeld.plans import reports as rp
from tablemeld.plans.results import Results
from tablemeld.sources.metadata import MasterSchema
from tablemeld.sources.tables import read_table, write_report, write_table


def run(
    df: DataFrame,
    schema: MasterSchema,
    value_maps: Mapping[str, Mapping[str, str]] | None = None,
    rule_texts: Sequence[str] = (),
    proposals: DataFrame | None = None,
    keys: Sequence[str] = (),
    scale_bounds: str = "observed",
) -> Results:
    """All result tables of a single-source run.

    ``keys`` are source columns that identify a row; with them the harmonized table
    is compared to the input under the target names.
    """
    structural = rp.structural_validation(df, schema, proposals)
    plan = rp.fit_harmonization(
        df, ma.mapping_pairs(structural["mappings"]), schema, value_maps, scale_bounds
    )
    harmonized = rp.apply_harmonization(df, plan)
    quality = Results({"all": lambda: rp.quality_analysis(df, rule_texts)})
    summary = Results({"all": lambda: rp.harmonization_summary(df, harmonized, plan)})

    def run_row() -> DataFrame:
        confidence = summary["all"].first()["confidence_score"] or 0.0
        return ql.run_summary(quality["all"]["summary"], True, confidence)

    builders = {
        "harmonized": lambda: harmonized,
        **{k: lambda t=t: t for k, t in structural.items()},
        "statistics": lambda: quality["all"]["statistics"],
        "issues": lambda: quality["all"]["issues"],
        "quality": lambda: quality["all"]["summary"],
        "issues_by_type": lambda: quality["all"]["by_type"],
        "harmonization": lambda: summary["all"],
        "run": run_row,
        "leading_issues": lambda: ql.leading_issues(quality["all"]["issues"]),
    }
    targets = {s: t for t, s in plan.sources.items()}
    if keys and all(k in targets for k in keys):
        builders["comparison"] = lambda: cp.compare_tables(
            df.withColumnsRenamed(targets), harmonized, [targets[k] for k in keys]
        )
    return Results(builders)


def run_files(
    spark: SparkSession,
    input_path: str,
    schema: MasterSchema,
    output_path: str,
    report_folder: str,
    value_maps: Mapping[str, Mapping[str, str]] | None = None,
    rule_texts: Sequence[str] = (),
    keys: Sequence[str] = (),
) -> Results:
    """``run`` on a file, with the harmonized table and the reports written out."""
    result = run(read_table(spark, input_path).data, schema, value_maps, rule_texts, keys=keys)
    write_table(result["harmonized"], output_path)
    write_report({k: v for k, v in result.items() if k != "harmonized"}, report_folder)
    return result
