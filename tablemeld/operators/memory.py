"""What was learned: append-only tables with a latest view, and nearest mappings."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablemeld import columns as cols
from tablemeld.functions import fixed_values as fv
from tablemeld.operators import neighbours, transform as tf
from tablemeld.operators.joins import fits_broadcast
from tablemeld.operators.match import UNMAPPED, schema_difference
from tablemeld.sources.metadata import MasterSchema
from tablemeld.sources.segments import Segments

#: Schemas of the learned tables; every row carries its time.
TABLES = {
    "datasets": "dataset string, rows bigint, columns array<string>, timestamp timestamp",
    "schema_diffs": (
        "dataset string, missing_in_source array<string>, extra_in_source array<string>, "
        "timestamp timestamp"
    ),
    "learned_mappings": (
        "dataset string, source_column string, target_column string, confidence double, "
        "status string, timestamp timestamp"
    ),
    "level_suggestions": (
        "dataset string, column string, raw_value string, suggested_value string, status string, "
        "timestamp timestamp"
    ),
    "imputation_overrides": "column string, strategy string, source string, timestamp timestamp",
    "learned_format_fixes": (
        "column string, problem string, fix string, sample_before string, sample_after string, "
        "timestamp timestamp"
    ),
    "column_mappings": (
        "table_name string, source_column string, target_column string, confidence double, "
        "status string, timestamp timestamp"
    ),
}

#: Key of the latest view of each table.
KEYS = {
    "datasets": ("dataset",),
    "schema_diffs": ("dataset",),
    "learned_mappings": ("dataset", "source_column"),
    "level_suggestions": ("dataset", "column", "raw_value"),
    "imputation_overrides": ("column",),
    "learned_format_fixes": ("column", "fix"),
    "column_mappings": ("table_name", "source_column"),
}


def _stored(spark: SparkSession, folder: str, name: str) -> Segments:
    return Segments(spark, f"{folder.rstrip('/')}/{name}", TABLES[name])


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A learned table, from its newest snapshot and the runs since; empty before its first append."""
    return _stored(spark, folder, name).load()


def append(rows: DataFrame, folder: str, name: str, run: str | None = None) -> None:
    """Append rows to a learned table; rows without a time get the current one.

    A run that is repeated under its id replaces its own rows, so a retry counts once.
    """
    if "timestamp" not in rows.columns:
        rows = rows.withColumn("timestamp", F.current_timestamp())
    schema = rows.sparkSession.createDataFrame([], TABLES[name]).schema
    missing = [f for f in schema.fields if f.name not in rows.columns]
    rows = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
    _stored(rows.sparkSession, folder, name).append(rows, run)


def compact(spark: SparkSession, folder: str, name: str, only_latest: bool = False) -> int:
    """Write a snapshot of a learned table, of all its rows or of the last row for each key; returns its version."""
    keep = (lambda rows: latest(rows, KEYS[name])) if only_latest else (lambda rows: rows)
    return _stored(spark, folder, name).compact(keep)


def latest(history: DataFrame, keys: Sequence[str], order: str = "timestamp") -> DataFrame:
    """Last row per key.

    An aggregate, not a window: partial aggregation keeps one row per key and task,
    so a key with a long history costs no more than any other.
    """
    rest = [c for c in history.columns if c not in keys]
    newest = F.max_by(F.struct(*map(cols.ref, rest)), F.struct(cols.ref(order), *map(cols.ref, rest)))
    return (
        history.groupBy(*map(cols.ref, keys))
        .agg(newest.alias("__row"))
        .select(*map(cols.ref, keys), "__row.*")
        .select(*map(cols.ref, history.columns))
    )


def latest_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return latest(load(spark, folder, name), KEYS[name])


# --- rows to learn --------------------------------------------------------------


def dataset_row(df: DataFrame, dataset: str) -> DataFrame:
    names = F.array(*map(F.lit, df.columns)).cast("array<string>")
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(dataset).alias("dataset"), "rows", names.alias("columns")
    )


def mapping_rows(mappings: DataFrame, dataset: str, threshold: float) -> DataFrame:
    """Learned mappings of one run with their status."""
    return mappings.select(
        F.lit(dataset).alias("dataset"),
        "source_column",
        "target_column",
        "confidence",
        F.when(F.col("confidence") >= threshold, "auto").otherwise("review").alias("status"),
    )


def upsert_mappings(existing: DataFrame, updates: DataFrame, table_name: str) -> DataFrame:
    """Column mappings with updates of one table; the latest row per source column stays."""
    new = updates.select(
        F.lit(table_name).alias("table_name"), "source_column", "target_column", "confidence", "status",
        F.col("timestamp") if "timestamp" in updates.columns else F.current_timestamp().alias("timestamp"),
    )
    return latest(existing.unionByName(new), KEYS["column_mappings"])


def confirmed_mappings(spark: SparkSession, decisions: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Mappings that a user confirmed."""
    rows = [
        (source, d["target"], fv.CONFIRMED_CONFIDENCE, "user_confirmed")
        for source, d in decisions.items()
        if d.get("action", "confirm") in ("confirm", "map_to")
        and d.get("target")
        and d["target"] != UNMAPPED
    ]
    return spark.createDataFrame(
        rows, "source_column string, target_column string, confidence double, status string"
    )


def level_suggestions(levels: DataFrame, value_maps: DataFrame, dataset: str) -> DataFrame:
    """Levels that no value map knows, with the trimmed level as suggestion.

    ``levels`` holds (column, value); ``value_maps`` (column, raw, canonical).
    """
    known = value_maps.select("column", F.col("raw").alias("value")).distinct()
    if fits_broadcast(known):
        known = F.broadcast(known)
    return levels.join(known, ["column", "value"], "left_anti").select(
        F.lit(dataset).alias("dataset"),
        "column",
        F.col("value").alias("raw_value"),
        F.trim("value").alias("suggested_value"),
        F.lit("review").alias("status"),
    )


def difference_row(source_columns: DataFrame, schema: MasterSchema, dataset: str) -> DataFrame:
    return schema_difference(source_columns, schema, dataset)


def override_rows(spark: SparkSession, overrides: Mapping[str, str], source: str) -> DataFrame:
    return spark.createDataFrame(
        [(c, s, source) for c, s in overrides.items()], "column string, strategy string, source string"
    )


def replay_overrides(history: DataFrame) -> dict[str, str]:
    """Latest strategy per column, one row each."""
    usable = history.where(F.col("column").isNotNull() & F.col("strategy").isNotNull())
    return {r["column"]: r["strategy"] for r in latest(usable, ["column"]).collect()}


def format_fix_row(
    spark: SparkSession, column: str, problem: str, fix: str,
    sample_before: str | None = None, sample_after: str | None = None,
) -> DataFrame:
    return spark.createDataFrame(
        [(column, problem, fix, sample_before, sample_after)],
        "column string, problem string, fix string, sample_before string, sample_after string",
    )


def replay_format_fixes(df: DataFrame, fixes: DataFrame) -> DataFrame:
    """Repair separators where a learned fix says so.

    A fix applies when its text is about separators or dates: to its own column if
    the table has it, else to all date-like columns.
    """
    found = latest(fixes, KEYS["learned_format_fixes"]).collect()
    columns: dict[str, None] = {}
    for r in found:
        problem = (r["problem"] or "").lower()
        if "separator" in problem or "date" in problem or " > " in (r["fix"] or ""):
            own = [r["column"]] if r["column"] in df.columns else cols.columns_like(df, fv.DATE_WORDS)
            columns.update(dict.fromkeys(own))
    return tf.repair_separators(df, columns) if columns else df


# --- nearest mappings -----------------------------------------------------------

def learnable(mappings: DataFrame) -> DataFrame:
    """Mappings worth remembering: confident and mapped."""
    return mappings.where(
        (F.col("confidence") >= fv.LEARN_CONFIDENCE) & (F.col("target_column") != UNMAPPED)
    )


def memory_rows(mappings: DataFrame, data_type: Column | None = None) -> DataFrame:
    """Memory rows: text of each mapping; rows without source or target are left out."""
    typed = F.lit(None).cast("string") if data_type is None else data_type
    text = F.concat(
        F.col("source_column"), F.lit(" maps to "), F.col("target_column"),
        F.coalesce(F.concat(F.lit(" (type: "), typed, F.lit(")")), F.lit("")),
    )
    return mappings.where(
        (F.coalesce("source_column", F.lit("")) != "")
        & (F.coalesce("target_column", F.lit("")) != "")
        & (F.col("target_column") != UNMAPPED)
    ).withColumn("text", text)


def memory_statistics(memory: DataFrame) -> DataFrame:
    """One row: number of remembered mappings and the similarity threshold."""
    return memory.agg(
        F.count(F.lit(1)).alias("total_mappings"),
        F.lit(fv.MEMORY_SIMILARITY).alias("similarity_threshold"),
    )


def nearest(
    memory: DataFrame,
    queries: DataFrame,
    k: int = 5,
    threshold: float = fv.MEMORY_SIMILARITY,
    memory_id: str = "memory_id",
    query_id: str = "query_id",
    vector: str = "vector",
) -> DataFrame:
    """(query_id, memory_id, distance, similarity, rank): k nearest rows per query.

    Distance is squared L2, similarity 1 / (1 + distance); matches below the threshold are
    left out, so the threshold is a radius.  Rows are found exactly through a tree of cells
    (``neighbours``).  Ties go to the smaller memory id.  Null vectors and vectors with null or
    non-finite components take no part.
    """
    kind = lambda df: "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    named = lambda df, key, name: df.select(cols.ref(key).alias(name), cols.ref(vector).cast(kind(df)).alias("v"))
    radius = math.sqrt(max(0.0, 1 / threshold - 1)) if threshold > 0 else math.inf
    found = neighbours.k_nearest(named(memory, memory_id, "m"), named(queries, query_id, "q"), k, radius)
    return (
        found.withColumn("similarity", 1 / (1 + F.col("distance")))
        .where(F.col("similarity") >= threshold)
        .select(F.col("q").alias(query_id), F.col("m").alias(memory_id), "distance", "similarity", "rank")
    )


def suggest(memory: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """Best remembered mapping per query, if similar enough."""
    return nearest(memory, queries, k=1, **options)
