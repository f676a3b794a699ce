"""Generate the metadata of a raw table and write it next to a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablemeld.operators import generate as ge
from tablemeld.sources import metadata as md
from tablemeld.sources.tables import write_report, write_table


def run(df: DataFrame, max_levels: int = ge.MAX_LEVELS) -> dict[str, DataFrame]:
    """All generated tables, the raw snapshot and its descriptive statistics."""
    return ge.generate_metadata(df, max_levels).tables() | ge.raw_snapshot(df)


def write(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """The raw snapshot as Parquet, everything else as JSON rows."""
    raw = write_table(tables["raw_input"], f"{folder.rstrip('/')}/raw_input", "parquet")
    return [raw, *write_report({k: v for k, v in tables.items() if k != "raw_input"}, folder)]


def write_documents(tables: dict[str, DataFrame], folder: str, name: str = "generated") -> list[str]:
    """The generated schema, value maps and rules as documents that the loaders of a run read.

    They have one entry for each column (and short level list), so they pass through the driver.
    """
    spark, folder = tables["master_metadata"].sparkSession, folder.rstrip("/")
    documents = {
        "master_schema": md.schema_document(md.schema_of(tables["master_metadata"], name)),
        "mapping_tables": md.value_maps_of(tables["mapping_table"]),
        "validation_rules": md.rules_document(md.rules_of(tables["validation_rules"])),
    }
    return [md.save_document(spark, d, f"{folder}/{n}.json") for n, d in documents.items()]
