"""Metadata documents: master schema, value maps, rules, labels, standards.

Documents are small, so they are parsed on the driver; each has a table form.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

try:
    import yaml
except ImportError:  # YAML documents need PyYAML; JSON ones do not
    yaml = None

from tablemeld.operators.validate import Rule
from tablemeld.storage import path_exists


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    canonical_name: str
    data_type: str = "string"
    is_required: bool = False
    is_key: bool = False
    aliases: tuple[str, ...] = ()
    default_value: str | None = None
    min_value: float | None = None
    max_value: float | None = None


@dataclass(frozen=True)
class MasterSchema:
    name: str
    version: str
    columns: tuple[ColumnSpec, ...]

    def column(self, name: str) -> ColumnSpec | None:
        return next((c for c in self.columns if name in (c.name, c.canonical_name)), None)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]


def _bound(value: Any) -> float | None:
    return None if value is None else float(value)


def master_schema(document: Mapping[str, Any]) -> MasterSchema:
    """Master schema of a document; columns may lie below a ``schema`` entry."""
    found = document.get("columns") or document.get("schema", {}).get("columns", [])
    specs = []
    for c in found:
        bounds = c.get("validation_rules") or {}
        name = c.get("name") or c["canonical_name"]
        default = c.get("default_value")
        specs.append(
            ColumnSpec(
                name=name,
                canonical_name=c.get("canonical_name") or name,
                data_type=c.get("data_type", "string"),
                is_required=bool(c.get("is_required", False)),
                is_key=bool(c.get("is_key", False)),
                aliases=tuple(c.get("aliases") or ()),
                default_value=None if default is None else str(default),
                min_value=_bound(bounds.get("min_value")),
                max_value=_bound(bounds.get("max_value")),
            )
        )
    return MasterSchema(
        str(document.get("schema_name", "")), str(document.get("version", "")), tuple(specs)
    )


def schema_table(spark: SparkSession, schema: MasterSchema) -> DataFrame:
    return spark.createDataFrame(
        [
            (
                i, c.name, c.canonical_name, c.data_type, c.is_required, c.is_key,
                list(c.aliases), c.default_value, c.min_value, c.max_value,
            )
            for i, c in enumerate(schema.columns)
        ],
        "ord int, name string, canonical_name string, data_type string, is_required boolean, "
        "is_key boolean, aliases array<string>, default_value string, min_value double, max_value double",
    )


def value_maps(document: Mapping[str, Any]) -> dict[str, dict[str, str]]:
    """``{column: {raw: canonical}}`` parts of a document; other parts are left out."""
    return {
        str(column): {str(k): str(v) for k, v in entries.items()}
        for column, entries in document.items()
        if isinstance(entries, Mapping)
        and not any(isinstance(v, (Mapping, list)) for v in entries.values())
    }


def value_map_table(spark: SparkSession, maps: Mapping[str, Mapping[str, str]]) -> DataFrame:
    return spark.createDataFrame(
        [(c, raw, canonical) for c, m in maps.items() for raw, canonical in m.items()],
        "column string, raw string, canonical string",
    )


def declared_scales(document: Mapping[str, Any]) -> dict[str, list[tuple[str, float, float]]]:
    """Named input scales per column of a ``scale_normalizations`` part."""
    return {
        column: [(s["name"], float(s["min"]), float(s["max"])) for s in spec.get("input_scales", [])]
        for column, spec in document.get("scale_normalizations", {}).items()
    }


def rules(document: Any) -> list[Rule]:
    """Rules of a list, of a ``rules`` entry, or of text lines."""
    if isinstance(document, Mapping):
        document = document.get("rules") or []
    return [Rule.of({"rule": r} if isinstance(r, str) else r) for r in document or []]


def rules_table(spark: SparkSession, found: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame(
        [
            (
                r.column, _bound(r.min), _bound(r.max), list(r.allowed_values), r.required,
                r.min_records, r.max_records, r.text,
            )
            for r in found
        ],
        "column string, min double, max double, allowed_values array<string>, required boolean, "
        "min_records bigint, max_records bigint, rule string",
    )


def schema_of(rows: DataFrame, name: str = "generated", version: str = "1") -> MasterSchema:
    """The master schema of its table form, one row for each column; absent fields take their defaults."""
    fields = {f for f in rows.columns if f in ColumnSpec.__dataclass_fields__}
    found = rows.orderBy("ord").select(*sorted(fields)).collect()
    specs = []
    for r in found:
        given = {k: v for k, v in r.asDict().items() if v is not None}
        specs.append(ColumnSpec(**given | {"aliases": tuple(given.get("aliases", ()))}))
    return MasterSchema(name, version, tuple(specs))


def rules_of(rows: DataFrame) -> list[Rule]:
    """Rules of their table form, the rule of the whole table first."""
    return [Rule.of(r.asDict()) for r in rows.orderBy("column").collect()]


def value_maps_of(rows: DataFrame) -> dict[str, dict[str, str]]:
    """``{column: {raw: canonical}}`` of (column, raw, canonical) rows."""
    found: dict[str, dict[str, str]] = {}
    for r in rows.orderBy("column", "raw").collect():
        found.setdefault(r["column"], {})[r["raw"]] = r["canonical"]
    return found


def schema_document(schema: MasterSchema) -> dict[str, Any]:
    """What ``master_schema`` reads."""
    columns = []
    for c in schema.columns:
        bounds = {k: v for k, v in (("min_value", c.min_value), ("max_value", c.max_value)) if v is not None}
        entry = {
            "name": c.name, "canonical_name": c.canonical_name, "data_type": c.data_type, "is_required": c.is_required,
            "is_key": c.is_key, "aliases": list(c.aliases), "default_value": c.default_value,
        }
        columns.append(entry | ({"validation_rules": bounds} if bounds else {}))
    return {"schema_name": schema.name, "version": schema.version, "columns": columns}


def rules_document(found: Sequence[Rule]) -> dict[str, Any]:
    """What ``rules`` reads."""
    listed = []
    for r in found:
        entry = {
            "column": r.column, "min": r.min, "max": r.max, "allowed_values": list(r.allowed_values) or None,
            "required": r.required or None, "min_records": r.min_records, "max_records": r.max_records, "rule": r.text,
        }
        listed.append({k: v for k, v in entry.items() if v is not None})
    return {"rules": listed}


def labels_table(spark: SparkSession, labels: Mapping[str, str]) -> DataFrame:
    """(column, label) of variable labels."""
    return spark.createDataFrame(list(labels.items()), "column string, label string")


def concept_table(spark: SparkSession, concepts: Mapping[str, str]) -> DataFrame:
    """(column, concept): several columns may share one concept."""
    return spark.createDataFrame(list(concepts.items()), "column string, concept string")


# --- documents on storage -------------------------------------------------------


def read_text(spark: SparkSession, path: str) -> str:
    """A small document from any file system Spark can read."""
    return spark.read.text(path, wholetext=True).first()[0]


def load_document(spark: SparkSession, path: str) -> Any:
    """A JSON or YAML document, or the non-empty lines of any other file."""
    text = read_text(spark, path)
    suffix = path.lower().rsplit(".", 1)[-1]
    if suffix == "json":
        return json.loads(text)
    if suffix in ("yaml", "yml"):
        if yaml is None:
            raise ImportError("reading YAML documents needs PyYAML")
        return yaml.safe_load(text)
    return [line.strip() for line in text.splitlines() if line.strip()]


def save_document(spark: SparkSession, document: Any, path: str) -> str:
    """Write a small document as JSON on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    system = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = system.create(location, True)
    try:
        out.write(bytearray(json.dumps(document, ensure_ascii=False, indent=1).encode()))
    finally:
        out.close()
    return path


def load_named(spark: SparkSession, folder: str, name: str) -> Any:
    """``name.yaml`` of a folder, else ``name.json``."""
    for suffix in ("yaml", "json"):
        path = f"{folder.rstrip('/')}/{name}.{suffix}"
        if path_exists(spark, path):
            return load_document(spark, path)
    raise FileNotFoundError(f"no {name}.yaml or {name}.json in {folder}")


def load_master_schema(spark: SparkSession, folder: str, name: str = "master_schema") -> MasterSchema:
    return master_schema(load_named(spark, folder, name))


def load_value_maps(
    spark: SparkSession, folder: str, name: str = "mapping_tables"
) -> dict[str, dict[str, str]]:
    return value_maps(load_named(spark, folder, name))


def load_rules(spark: SparkSession, path: str | None) -> list[Rule]:
    if not path or not path_exists(spark, path):
        return []
    return rules(load_document(spark, path))
