"""Validation: declarative rules and missingness as flag rows."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from tablemeld import columns as cols
from tablemeld.functions import casts
from tablemeld.functions.fixed_values import RECORD_ID_COLUMNS
from tablemeld.operators.joins import weighted_lookup

FLAG_SCHEMA = "dataset string, record_id string, column string, issue_type string, details string"

#: Allowed values up to which membership is an IN list.
IN_LIST_VALUES = 1_000


@dataclass(frozen=True)
class Rule:
    """A rule about one column, or about the number of records."""

    column: str | None = None
    min: float | None = None
    max: float | None = None
    allowed_values: tuple[str, ...] = ()
    required: bool = False
    min_records: int | None = None
    max_records: int | None = None
    text: str | None = None

    @staticmethod
    def of(document: Mapping[str, Any]) -> Rule:
        return Rule(
            column=document.get("column"),
            min=document.get("min"),
            max=document.get("max"),
            allowed_values=tuple(str(v) for v in document.get("allowed_values") or ()),
            required=bool(document.get("required", False)),
            min_records=document.get("min_records"),
            max_records=document.get("max_records"),
            text=document.get("rule"),
        )


def record_id_column(df: DataFrame) -> str | None:
    return cols.first_present(RECORD_ID_COLUMNS, df)


def _record_id(df: DataFrame, name: str | None) -> Column:
    known = name is not None and name in df.columns
    return (cols.ref(name) if known else F.lit(None)).cast("string")


def _flag(column: str, issue_type: str, details: Column) -> Column:
    return F.struct(
        F.lit(column).alias("column"), F.lit(issue_type).alias("issue_type"), details.alias("details")
    )


def _violations(df: DataFrame, rule: Rule) -> list[Column]:
    value, text = cols.ref(rule.column), cols.as_text(df, rule.column)
    number = casts.to_number(value, cols.is_text(cols.type_of(df, rule.column)))
    found = []
    if rule.required:
        found.append(
            F.when(value.isNull(), _flag(rule.column, "required_missing", F.lit("Required value missing")))
        )
    if rule.min is not None:
        details = F.concat(F.lit("Value "), text, F.lit(f" below min {rule.min}"))
        found.append(F.when(number < rule.min, _flag(rule.column, "below_min", details)))
    if rule.max is not None:
        details = F.concat(F.lit("Value "), text, F.lit(f" above max {rule.max}"))
        found.append(F.when(number > rule.max, _flag(rule.column, "above_max", details)))
    if rule.allowed_values and len(rule.allowed_values) <= IN_LIST_VALUES:
        details = F.concat(F.lit("Value "), text, F.lit(" not in allowed list"))
        found.append(
            F.when(~text.isin(list(rule.allowed_values)), _flag(rule.column, "invalid_value", details))
        )
    return found


def record_flags(
    df: DataFrame, rules: Iterable[Rule], dataset: str, record_id: str | None = None
) -> DataFrame:
    """One flag row per violation: all rules are checked in a single pass."""
    df = cols.nan_to_null(df)
    checked, listed = [], []
    for rule in rules:
        if rule.min_records is not None or rule.max_records is not None:
            continue
        if rule.column is None or rule.column not in df.columns:
            continue
        checked += _violations(df, rule)
        if len(rule.allowed_values) > IN_LIST_VALUES:
            listed.append(rule)
    parts = []
    if checked:
        parts.append(
            df.select(
                F.lit(dataset).alias("dataset"),
                _record_id(df, record_id).alias("record_id"),
                F.inline(F.filter(F.array(*checked), lambda flag: flag.isNotNull())),
            )
        )
    parts += [_outside_list(df, rule, dataset, record_id) for rule in listed]
    if not parts:
        return df.sparkSession.createDataFrame([], FLAG_SCHEMA)
    return cols.union_by_name(parts)


def _outside_list(df: DataFrame, rule: Rule, dataset: str, record_id: str | None) -> DataFrame:
    """Membership in a long list, as a lookup."""
    allowed = df.sparkSession.createDataFrame(
        [(v,) for v in set(rule.allowed_values)], "__value string"
    )
    return members_outside(df, rule.column, allowed, dataset, record_id)


def members_outside(
    df: DataFrame, column: str, allowed: DataFrame, dataset: str, record_id: str | None = None
) -> DataFrame:
    """Flags of the values that a one-column table of allowed values does not hold."""
    allowed = allowed.toDF("__text").distinct()
    details = F.concat(F.lit("Value "), F.col("__text"), F.lit(" not in allowed list"))
    rows = df.where(cols.ref(column).isNotNull()).select(
        _record_id(df, record_id).alias("record_id"), cols.as_text(df, column).alias("__text")
    )
    marked = weighted_lookup(rows, allowed.withColumn("__allowed", F.lit(True)), ["__text"])
    return marked.where(F.col("__allowed").isNull()).select(
        F.lit(dataset).alias("dataset"),
        "record_id",
        F.lit(column).alias("column"),
        F.lit("invalid_value").alias("issue_type"),
        details.alias("details"),
    )


def table_flags(df: DataFrame, rules: Iterable[Rule], dataset: str) -> DataFrame:
    """Flags of the record-count rules: at most one row per rule."""
    none = F.lit(None).cast("string")
    n = F.col("n")
    found = []
    for rule in rules:
        for limit, name, word, broken in (
            (rule.min_records, "min_records", "minimum", lambda v: n < v),
            (rule.max_records, "max_records", "maximum", lambda v: n > v),
        ):
            if limit is not None:
                details = F.format_string(f"Dataset has %d rows, {word} is {int(limit)}", n)
                found.append(
                    F.when(
                        broken(int(limit)),
                        F.struct(
                            F.lit(dataset).alias("dataset"), none.alias("record_id"),
                            none.alias("column"), F.lit(name).alias("issue_type"),
                            details.alias("details"),
                        ),
                    )
                )
                break
    if not found:
        return df.sparkSession.createDataFrame([], FLAG_SCHEMA)
    return df.agg(F.count(F.lit(1)).alias("n")).select(
        F.inline(F.filter(F.array(*found), lambda flag: flag.isNotNull()))
    )


def apply_rules(
    df: DataFrame, rules: Sequence[Rule], dataset: str, record_id: str | None = None
) -> DataFrame:
    """Record flags and record-count flags together."""
    return table_flags(df, rules, dataset).unionByName(record_flags(df, rules, dataset, record_id))


def missing_flags(df: DataFrame, dataset: str) -> DataFrame:
    """One flag per column with missing values: structural if all are missing."""
    df = cols.nan_to_null(df)
    total = F.count(F.lit(1))
    share = F.col("missing") / F.col("total") * 100
    return (
        cols.rows_from_aggregate(
            df, [(c, {"total": total, "missing": total - F.count(cols.ref(c))}) for c in df.columns]
        )
        .where(F.col("missing") > 0)
        .select(
            F.lit(dataset).alias("dataset"),
            F.lit(None).cast("string").alias("record_id"),
            "column",
            F.when(F.col("missing") == F.col("total"), "structural_missing")
            .otherwise("random_missing")
            .alias("issue_type"),
            F.format_string("%.1f%% missing", share).alias("details"),
        )
    )


def row_missing_flags(
    df: DataFrame, dataset: str, record_id: str, limit: int | None = None
) -> DataFrame:
    """One flag per record with missing fields; ``limit`` keeps the first ids only."""
    df = cols.nan_to_null(df)
    nulls = sum((cols.ref(c).isNull().cast("int") for c in df.columns), F.lit(0))
    found = df.select(cols.ref(record_id).alias("id"), nulls.alias("n")).where(F.col("n") > 0)
    if limit is not None:
        found = found.orderBy("id").limit(limit)
    return found.select(
        F.lit(dataset).alias("dataset"),
        F.col("id").cast("string").alias("record_id"),
        F.lit("multiple").alias("column"),
        F.lit("row_missing").alias("issue_type"),
        F.format_string("%d fields missing", F.col("n")).alias("details"),
    )


def range_violations(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows whose value lies outside the range."""
    value = cols.ref(column)
    return df.where((value < low) | (value > high))


# --- rules written as text ------------------------------------------------------

_COLUMN = re.compile(r"column[:\s]+[\"']?(\w+)[\"']?", re.IGNORECASE)
_NUMBER = re.compile(r"(?<![\w.])-?\d+(?:\.\d+)?")


def parse_text_rule(text: str) -> Rule | None:
    """``minimum N records``, ``column: x between a and b``, ``column: x not null``."""
    lower = text.lower()
    named = _COLUMN.search(text)
    rest = text if named is None else text[: named.start()] + " " + text[named.end() :]
    numbers = [float(n) for n in _NUMBER.findall(rest)]
    if re.search(r"\bmin(imum)?\b", lower) and "records" in lower:
        return Rule(min_records=int(numbers[0]), text=text) if numbers else None
    if named is None:
        return None
    if ("range" in lower or "between" in lower) and len(numbers) >= 2:
        return Rule(column=named.group(1), min=numbers[0], max=numbers[1], text=text)
    if "not null" in lower or "required" in lower:
        return Rule(column=named.group(1), required=True, text=text)
    return None


def business_issues(df: DataFrame, texts: Iterable[str]) -> DataFrame:
    """Quality issues of rules written as text, all counted in one scan."""
    by_name = {c.lower(): c for c in df.columns}
    total = F.count(F.lit(1))
    counted, parts = [], []
    for rule in filter(None, map(parse_text_rule, texts)):
        if rule.min_records is not None:
            few = F.when(total < rule.min_records, total).otherwise(F.lit(0))
            counted.append(few)
            parts.append((None, "blocking", f"rule not met: {rule.text}. Found %d records.", None, False))
            continue
        name = by_name.get((rule.column or "").lower())
        if name is None:
            continue
        value = cols.ref(name)
        if rule.required:
            counted.append(total - F.count(value))
            parts.append((name, "blocking", f"rule not met: {name} is required and has %d null values", None, False))
        elif cols.is_numeric(cols.type_of(df, name)):
            counted.append(F.count(F.when((value < rule.min) | (value > rule.max), 1)))
            bounds = f"[{rule.min}, {rule.max}]"
            parts.append((name, "fixable", f"rule not met: {name} has %d values beyond {bounds}", f"Limit them to {bounds}", True))
    schema = (
        "column string, issue_type string, severity string, description string, "
        "affected_rows bigint, affected_pct double, suggested_fix string, is_fixable boolean"
    )
    if not counted:
        return df.sparkSession.createDataFrame([], schema)
    wide = df.agg(total.alias("total"), *[c.alias(f"n{i}") for i, c in enumerate(counted)])
    rows = [
        F.struct(
            F.lit(name).cast("string").alias("column"),
            F.lit("business_rule_violation").alias("issue_type"),
            F.lit(severity).alias("severity"),
            (
                F.format_string(text.replace("%", "%%").replace("%%d", "%d"), F.col(f"n{i}"))
                if "%d" in text
                else F.lit(text)
            ).alias("description"),
            F.col(f"n{i}").alias("affected_rows"),
            (
                F.lit(100.0) if name is None else F.col(f"n{i}") / F.col("total") * 100
            ).alias("affected_pct"),
            F.lit(fix).cast("string").alias("suggested_fix"),
            F.lit(fixable).alias("is_fixable"),
        )
        for i, (name, severity, text, fix, fixable) in enumerate(parts)
    ]
    return wide.select(F.inline(F.array(*rows))).where(F.col("affected_rows") > 0)


def flag_counts(flags: DataFrame) -> DataFrame:
    """Number of flags per dataset, column and issue type."""
    return flags.groupBy("dataset", "column", "issue_type").agg(F.count(F.lit(1)).alias("flags"))
