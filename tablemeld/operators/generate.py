"""Metadata generated from data: schema, rules, value maps, dictionary, standards."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tablemeld.functions import names
from tablemeld.functions.fixed_values import DEFAULT_VALUE_MAPS
from tablemeld.operators import levels as lv, profile as pr
from tablemeld.operators.facts import ColumnFacts, fit_facts
from tablemeld.sources.metadata import value_map_table

MAX_LEVELS = 25
MIN_RECORDS = 10


@dataclass(frozen=True)
class GeneratedMetadata:
    """One table per generated document."""

    schema: DataFrame
    rules: DataFrame
    value_maps: DataFrame
    dictionary: DataFrame
    standards: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {
            "master_metadata": self.schema,
            "validation_rules": self.rules,
            "mapping_table": self.value_maps,
            "data_dictionary": self.dictionary,
            "master_dictionary": self.standards,
        }


def described_columns(
    df: DataFrame, max_levels: int = MAX_LEVELS, facts: Mapping[str, ColumnFacts] | None = None
) -> DataFrame:
    """(ord, column, data_type, is_numeric, min, max, allowed_values, sample_values) per column."""
    facts = facts or fit_facts(df)
    levels = lv.level_counts(df, list(facts))
    numeric = F.col("kind").isin("integer", "float")
    unique = levels.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    return (
        pr.facts_table(df, facts)
        .join(unique, "column", "left")
        .join(lv.allowed_values(levels, max_levels), "column", "left")
        .join(lv.sample_values(levels), "column", "left")
        .select(
            "ord",
            "column",
            pr.inferred_type(
                F.col("kind"), F.coalesce("unique_count", F.lit(0)), F.col("non_null_count"),
                pr.GENERATED_CATEGORICAL_SHARE,
            ).alias("data_type"),
            numeric.alias("is_numeric"),
            "min",
            "max",
            F.when(~numeric, F.col("values")).alias("allowed_values"),
            F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        )
    )


def schema_rows(described: DataFrame) -> DataFrame:
    """Master schema rows with observed bounds."""
    return described.select(
        "ord",
        F.col("column").alias("name"),
        F.col("column").alias("canonical_name"),
        "data_type",
        F.col("min").alias("min_value"),
        F.col("max").alias("max_value"),
        F.array().cast("array<string>").alias("aliases"),
    )


def rule_rows(described: DataFrame) -> DataFrame:
    """Validation rules: a record minimum, bounds of numbers, levels of short lists."""
    of_columns = described.where(
        (F.col("is_numeric") & F.col("min").isNotNull()) | F.col("allowed_values").isNotNull()
    ).select(
        "column",
        "min",
        "max",
        "allowed_values",
        F.lit(None).cast("bigint").alias("min_records"),
    )
    of_table = described.sparkSession.createDataFrame([(MIN_RECORDS,)], "min_records bigint")
    return of_columns.unionByName(of_table, allowMissingColumns=True)


def value_map_rows(
    described: DataFrame, defaults: Mapping[str, Mapping[str, str]] = DEFAULT_VALUE_MAPS
) -> DataFrame:
    """Identity entries of short level lists, next to the default maps.

    A default entry keeps its canonical value; identity entries fill the gaps.
    """
    known = value_map_table(described.sparkSession, defaults)
    found = described.where(F.col("allowed_values").isNotNull()).select(
        "column", F.explode("allowed_values").alias("raw")
    )
    new = found.join(F.broadcast(known), ["column", "raw"], "left_anti")
    return known.unionByName(new.withColumn("canonical", F.col("raw")))


def dictionary_rows(described: DataFrame) -> DataFrame:
    return described.select("column", "data_type", "sample_values")


def standard_rows(described: DataFrame) -> DataFrame:
    """Standards: type, bounds or allowed values, and an imputation strategy."""
    return described.where(~F.col("is_numeric") | F.col("min").isNotNull()).select(
        "column", "data_type", "min", "max", "allowed_values",
        F.when(F.col("is_numeric"), "mean").otherwise("mode").alias("impute_strategy"),
    )


def generate_metadata(df: DataFrame, max_levels: int = MAX_LEVELS) -> GeneratedMetadata:
    """All metadata tables of a table; one level shuffle feeds them."""
    described = described_columns(df, max_levels)
    return GeneratedMetadata(
        schema=schema_rows(described),
        rules=rule_rows(described),
        value_maps=value_map_rows(described),
        dictionary=dictionary_rows(described),
        standards=standard_rows(described),
    )


def schema_from_headers(df: DataFrame) -> DataFrame:
    """Master schema rows whose names are snake-case headers and whose alias is the header."""
    rows = [
        (i, names.snake_case(f.name), names.snake_case(f.name), f.dataType.simpleString(), [f.name])
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(
        rows, "ord int, name string, canonical_name string, data_type string, aliases array<string>"
    )


def raw_snapshot(df: DataFrame, dataset: str = "unclean_input") -> dict[str, DataFrame]:
    """The input as it is and its descriptive statistics."""
    return {"raw_input": df, "descriptive_stats": pr.descriptive_stats(df, dataset)}


def standards_of(table: DataFrame) -> dict[str, dict]:
    """Standards rows (one per column) as the dictionary that suggestions need."""
    found = {}
    for r in table.collect():
        spec = {"data_type": r["data_type"], "impute_strategy": r["impute_strategy"]}
        if r["min"] is not None:
            spec |= {"min": r["min"], "max": r["max"]}
        if r["allowed_values"]:
            spec["allowed_values"] = list(r["allowed_values"])
        found[r["column"]] = spec
    return found

