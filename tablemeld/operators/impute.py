"""Imputation: fitted fill values, strategies, null masks and skip logic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablemeld import columns as cols
from tablemeld.functions.fixed_values import STRATEGY_LABELS
from tablemeld.functions.values import lookup
from tablemeld.operators import levels as lv
from tablemeld.operators.facts import ColumnFacts, fit_facts, fit_skewness, medians
from tablemeld.operators.joins import weighted_lookup
from tablemeld.storage import materialize

KEEP, DROP_COLUMN, REMOVE_ROWS = "Keep missing", "Drop column", "Remove rows"

#: Constant fills by strategy label; the numeric one applies to numbers only, the others to text.
_CONSTANTS = {
    "Replace with 0": 0,
    "Replace with 'Unknown'": "Unknown",
    "Replace with 'Other'": "Other",
    "Replace with 'N/A'": "N/A",
    "Replace with empty ''": "",
}


@dataclass(frozen=True)
class Fill:
    """The fill of one column and where it comes from."""

    strategy: str
    value: Any


@dataclass(frozen=True)
class ImputePlan:
    """Fitted imputation: fills, columns to drop, columns whose nulls remove the row."""

    fills: Mapping[str, Fill]
    drop_columns: tuple[str, ...] = ()
    remove_rows: tuple[str, ...] = ()
    remove_any: bool = False


def fill_expression(df: DataFrame, name: str, value: Any) -> Column:
    """The column with nulls filled; whole numbers widen when the fill is fractional."""
    column, data_type = cols.ref(name), cols.type_of(df, name)
    if value is None:
        return column
    if cols.is_numeric(data_type):
        fractional = float(value) != int(value) if abs(float(value)) < 2**63 else True
        if isinstance(data_type, cols.INTEGRAL) and fractional:
            return F.coalesce(column.cast("double"), F.lit(float(value)))
        return F.coalesce(column, F.lit(value).cast(data_type))
    if isinstance(data_type, T.StringType):
        return F.coalesce(column, F.lit(str(value)))
    filled = F.lit(str(value)).try_cast(data_type)
    if isinstance(data_type, cols.TEMPORAL + (T.BooleanType,)):
        return F.coalesce(column, filled)
    return column


def apply_fills(df: DataFrame, fills: Mapping[str, Fill]) -> DataFrame:
    """Fill nulls by the fitted values; lazy and stateless."""
    df = cols.nan_to_null(df)
    change = {c: fill_expression(df, c, f.value) for c, f in fills.items() if c in df.columns}
    return df.withColumns(change) if change else df


def _missing(facts: Mapping[str, ColumnFacts]) -> list[str]:
    return [c for c, f in facts.items() if f.missing]


def fit_typed(df: DataFrame, facts: Mapping[str, ColumnFacts] | None = None) -> dict[str, Fill]:
    """Type-aware fills of the columns that miss values.

    Numbers: median where |skewness| exceeds 1, else mean.  Others: mode.
    """
    df = cols.nan_to_null(df)
    facts = facts or fit_facts(df)
    gaps = _missing(facts)
    skewed = [c for c, skew in fit_skewness(df, facts, gaps).items() if abs(skew) > 1]
    middle = medians(df, facts, skewed) if skewed else {}
    common = lv.modes(df, [c for c in gaps if not facts[c].numeric])
    fills = {}
    for c in gaps:
        if c in middle:
            fills[c] = Fill("median", middle[c])
        elif facts[c].numeric:
            fills[c] = Fill("mean", facts[c].mean)
        elif facts[c].kind == "boolean":
            fills[c] = Fill("mode", common[c] if common[c] is not None else "false")
        else:
            fills[c] = Fill("mode", common[c] if common[c] is not None else "Unknown")
    return fills


def fill_summary(
    df: DataFrame, dataset: str, fills: Mapping[str, Fill], facts: Mapping[str, ColumnFacts]
) -> DataFrame:
    """(dataset, column, strategy, fill_value, missing_count) per filled column."""
    return df.sparkSession.createDataFrame(
        [
            (dataset, c, f.strategy, None if f.value is None else str(f.value), facts[c].missing)
            for c, f in fills.items()
        ],
        "dataset string, column string, strategy string, fill_value string, missing_count bigint",
    )


def impute_typed(df: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """Type-aware imputation and its summary."""
    df = cols.nan_to_null(df)
    facts = fit_facts(df)
    fills = fit_typed(df, facts)
    return apply_fills(df, fills), fill_summary(df, dataset, fills, facts)


def fit_strategies(
    df: DataFrame,
    strategies: Mapping[str, str] | None = None,
    default_numeric: str = "Replace with MEAN",
    default_text: str = "Replace with 'Unknown'",
    remove_any: bool = False,
    facts: Mapping[str, ColumnFacts] | None = None,
) -> ImputePlan:
    """Fit per-column strategies; columns without one take the default of their type."""
    df = cols.nan_to_null(df)
    facts = facts or fit_facts(df)
    strategies = strategies or {}
    chosen = {
        c: strategies.get(c, default_numeric if facts[c].numeric else default_text)
        for c in _missing(facts)
    }
    middle = medians(
        df, facts, [c for c, s in chosen.items() if s == "Replace with MEDIAN" and facts[c].numeric]
    )
    common = lv.modes(df, [c for c, s in chosen.items() if s == "Replace with MODE"])
    fills = {}
    for c, strategy in chosen.items():
        value = _strategy_value(strategy, facts[c], middle.get(c), common.get(c))
        if value is not None:
            fills[c] = Fill(strategy, value)
    return ImputePlan(
        fills,
        tuple(c for c, s in chosen.items() if s == DROP_COLUMN),
        tuple(c for c, s in chosen.items() if s == REMOVE_ROWS),
        remove_any,
    )


def _strategy_value(
    strategy: str, fact: ColumnFacts, median: float | None, mode: str | None
) -> Any:
    """Fill value of a strategy, None where the strategy does not fit the column's type."""
    if strategy == "Replace with MODE":
        if mode is None:
            return 0 if fact.numeric else "Unknown"
        return _number(mode, fact.kind) if fact.numeric else mode
    if fact.numeric:
        if strategy == "Replace with MEAN":
            return 0 if fact.mean is None else fact.mean
        if strategy == "Replace with MEDIAN":
            return 0 if median is None else median
        return 0 if strategy == "Replace with 0" else None
    value = _CONSTANTS.get(strategy)
    return value if isinstance(value, str) else None


def _number(text: str, kind: str) -> int | float:
    return int(text) if kind == "integer" else float(text)


def apply_plan(df: DataFrame, plan: ImputePlan) -> DataFrame:
    """Fill, drop columns, then drop rows, in this order."""
    df = cols.nan_to_null(df)
    result = apply_fills(df, plan.fills).drop(*plan.drop_columns)
    if plan.remove_rows:
        result = result.dropna(subset=list(plan.remove_rows))
    return result.dropna("any") if plan.remove_any else result


# --- null masks -----------------------------------------------------------------


@dataclass(frozen=True)
class SkipRule:
    """Columns that are legitimately null where every condition column has its value."""

    conditions: Mapping[str, Any]
    then_null: tuple[str, ...]

    def holds(self) -> Column:
        found = F.lit(True)
        for name, value in self.conditions.items():
            found = found & F.coalesce(cols.ref(name) == F.lit(value), F.lit(False))
        return found


def skip_rules(document: Mapping[str, Any]) -> list[SkipRule]:
    """Skip rules of a questionnaire document (``filters``: ``if`` / ``then_null``)."""
    return [SkipRule(dict(f["if"]), tuple(f["then_null"])) for f in document.get("filters", [])]


def valid_null(name: str, rules: Sequence[SkipRule]) -> Column:
    """Whether a null of this column is explained by a skip rule."""
    found = F.lit(False)
    for rule in rules:
        if name in rule.then_null:
            found = found | rule.holds()
    return found


def classify_nulls(df: DataFrame, row_id: str, rules: Sequence[SkipRule]) -> DataFrame:
    """(row_id, column, null_class) of every null cell: valid or uncertain."""
    df = cols.nan_to_null(df)
    names = [c for c in df.columns if c != row_id]
    cells = F.array(
        *[
            F.when(
                cols.ref(c).isNull(),
                F.struct(
                    F.lit(c).alias("column"),
                    F.when(valid_null(c, rules), "valid").otherwise("uncertain").alias("null_class"),
                ),
            )
            for c in names
        ]
    )
    return df.select(
        cols.ref(row_id).alias("row_id"), F.inline(F.filter(cells, lambda x: x.isNotNull()))
    )


_CODES = {"mean", "median", "mode", "zero", "unknown", "other", "keep", "drop", "remove"}


def fit_codes(
    df: DataFrame, strategies: Mapping[str, str], facts: Mapping[str, ColumnFacts] | None = None
) -> dict[str, Fill]:
    """Fills of short strategy codes (mean, median, mode, zero, unknown, other)."""
    names = [c for c in strategies if c in df.columns]
    unknown = {s for s in strategies.values()} - _CODES
    if unknown:
        raise ValueError(f"unknown strategies: {sorted(unknown)}")
    facts = facts or fit_facts(df, names)
    middle = medians(df, facts, [c for c in names if strategies[c] == "median" and facts[c].numeric])
    common = lv.modes(df, [c for c in names if strategies[c] == "mode"])
    fills = {}
    for c in names:
        code, fact = strategies[c], facts[c]
        if code == "mode" and common[c] is not None:
            fills[c] = Fill(code, _number(common[c], fact.kind) if fact.numeric else common[c])
        elif code in ("unknown", "other") and not fact.numeric:
            fills[c] = Fill(code, STRATEGY_LABELS[code].split("'")[1])
        elif fact.numeric and code == "zero":
            fills[c] = Fill(code, 0)
        elif fact.numeric and code in ("mean", "median"):
            value = fact.mean if code == "mean" else middle[c]
            if value is not None:
                fills[c] = Fill(code, value)
    return fills


#: Bits of one word of a row's mask.
MASK_BITS = 62


def cell_masks(masks: Sequence[DataFrame | None], names: Sequence[str], row_id: str) -> DataFrame | None:
    """Long (row_id, column) masks as bits, one row for each row id that any of them lists.

    Bit ``len(masks) * i + k`` says that mask k lists column i; words hold ``MASK_BITS`` of them.
    """
    listed = []
    for k, mask in enumerate(masks):
        if mask is not None:
            bit = lookup(F.col("column"), {c: str(len(masks) * i + k) for i, c in enumerate(names)}).cast("int")
            listed.append(mask.select(F.col("row_id").alias(row_id), bit.alias("__bit")))
    if not listed or not names:
        return None
    words = -(-len(masks) * len(names) // MASK_BITS)
    place = F.expr(f"shiftleft(1L, __bit % {MASK_BITS})")
    return (
        cols.union_by_name(listed).where(F.col("__bit").isNotNull() & cols.ref(row_id).isNotNull()).groupBy(cols.ref(row_id))
        .agg(*[F.bit_or(F.when(F.floor(F.col("__bit") / MASK_BITS) == w, place).otherwise(F.lit(0).cast("long"))).alias(f"__mask{w}") for w in range(words)])
    )


def _masked(bit: int) -> Column:
    word = F.coalesce(F.col(f"__mask{bit // MASK_BITS}"), F.lit(0).cast("long"))
    return word.bitwiseAND(F.lit(1 << bit % MASK_BITS).cast("long")) != 0


def impute_masked(
    df: DataFrame,
    row_id: str,
    strategies: Mapping[str, str],
    valid_nulls: DataFrame | None = None,
    uncertain: DataFrame | None = None,
    keep_valid_nulls: bool = True,
) -> DataFrame:
    """Impute only the cells that the masks allow, then drop rows that must go.

    ``valid_nulls`` and ``uncertain`` are long (row_id, column) tables.  Cells in
    ``valid_nulls`` stay null.  A column that ``uncertain`` mentions is filled only in
    those cells.  ``drop`` and ``remove`` drop rows whose null is not valid.  The masks meet the
    table in one lookup of bits; rows without an id are in no mask and take no part in it.
    """
    df = cols.nan_to_null(df)
    names = [c for c, s in strategies.items() if c in df.columns and s != "keep"]
    fills = fit_codes(df, {c: strategies[c] for c in names})
    masks = [valid_nulls if keep_valid_nulls else None, uncertain]
    bits = cell_masks(masks, names, row_id)
    mentioned: set[str] = set()
    if uncertain is not None:
        mentioned = {
            r["column"]
            for r in uncertain.where(F.col("column").isin(names)).select("column").distinct().collect()
        }
    # written: the check of its size and the lookup both read it
    joined = df if bits is None else weighted_lookup(df, materialize(bits, "masks"), [row_id])

    def flag(k: int, i: int) -> Column:
        return F.lit(False) if masks[k] is None else _masked(len(masks) * i + k)

    change, keep = {}, F.lit(True)
    for i, c in enumerate(names):
        protected = flag(0, i)
        if strategies[c] in ("drop", "remove"):
            keep = keep & (cols.ref(c).isNotNull() | protected)
        elif c in fills:
            allowed = ~protected
            if c in mentioned:
                allowed = allowed & flag(1, i)
            change[c] = F.when(allowed, fill_expression(df, c, fills[c].value)).otherwise(cols.ref(c))
    if change:
        joined = joined.withColumns(change)
    return joined.where(keep).select(*map(cols.ref, df.columns))


def impute_with_skip_logic(
    df: DataFrame, strategies: Mapping[str, str], rules: Sequence[SkipRule]
) -> DataFrame:
    """Masked imputation with the mask computed in place: no join at all."""
    names = [c for c, s in strategies.items() if c in df.columns and s != "keep"]
    fills = fit_codes(df, {c: strategies[c] for c in names})
    change, keep = {}, F.lit(True)
    for c in names:
        protected = valid_null(c, rules)
        if strategies[c] in ("drop", "remove"):
            keep = keep & (cols.ref(c).isNotNull() | protected)
        elif c in fills:
            change[c] = F.when(protected, cols.ref(c)).otherwise(fill_expression(df, c, fills[c].value))
    return (df.where(keep).withColumns(change)) if change else df.where(keep)


def imputation_effect(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per stage: rows and missing cells before and after imputation."""

    def stage(df: DataFrame, name: str) -> DataFrame:
        nulls = sum((F.count(F.when(cols.ref(c).isNull(), 1)) for c in df.columns), F.lit(0))
        return df.agg(
            F.lit(name).alias("stage"),
            F.count(F.lit(1)).alias("rows"),
            nulls.cast("bigint").alias("missing"),
        )

    return stage(before, "before").unionByName(stage(after, "after"))


def columns_needing_imputation(df: DataFrame, uncertain: DataFrame) -> DataFrame:
    """(column, uncertain_count, data_type, is_numeric, missing_count) per column of the mask."""
    df = cols.nan_to_null(df)
    counts = uncertain.groupBy("column").agg(F.count(F.lit(1)).alias("uncertain_count"))
    total = F.count(F.lit(1))
    nulls = cols.rows_from_aggregate(
        df, [(c, {"missing_count": total - F.count(cols.ref(c))}) for c in df.columns]
    )
    types = df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString(), cols.is_numeric(f.dataType)) for f in df.schema.fields],
        "column string, data_type string, is_numeric boolean",
    )
    return (
        counts.join(F.broadcast(types), "column")
        .join(F.broadcast(nulls), "column")
        .select("column", "uncertain_count", "data_type", "is_numeric", "missing_count")
    )


def fallback_fills(facts: Mapping[str, ColumnFacts]) -> dict[str, Fill]:
    """Mean for numbers, ``Unknown`` for text, where values are missing."""
    fills = {}
    for c in _missing(facts):
        if facts[c].numeric:
            if facts[c].mean is not None:
                fills[c] = Fill("mean", facts[c].mean)
        elif facts[c].kind == "string":
            fills[c] = Fill("unknown", "Unknown")
    return fills


def fallback_clean(original: DataFrame, working: DataFrame) -> DataFrame:
    """Fallback fills, only where earlier cleaning did not lower the missing count."""
    before = sum(f.missing for f in fit_facts(original).values())
    facts = fit_facts(working)
    after = sum(f.missing for f in facts.values())
    return apply_fills(working, fallback_fills(facts)) if before and after >= before else working


# --- suggestions ----------------------------------------------------------------

_SUGGESTED = {code: STRATEGY_LABELS[code] for code in ("mean", "median", "mode")}


def dictionary_suggestions(
    df: DataFrame, standards: Mapping[str, Mapping[str, Any]]
) -> DataFrame:
    """Per dictionary column: missing values with a strategy, and standard violations.

    ``standards`` maps a column to its ``data_type``, ``min``/``max`` or
    ``allowed_values``, and ``impute_strategy``.
    """
    schema = (
        "column string, missing bigint, out_of_range bigint, not_allowed bigint, "
        "strategy string, reason string"
    )
    known = [(c, s) for c, s in standards.items() if c in df.columns]
    if not known:
        return df.sparkSession.createDataFrame([], schema)
    counted, strategy, reason = [], F.lit(None), F.lit(None)
    for c, spec in known:
        value, number = cols.ref(c), cols.is_numeric(cols.type_of(df, c))
        outside = F.lit(False)
        if number and "min" in spec and "max" in spec:
            outside = (value < spec["min"]) | (value > spec["max"])
        allowed = [str(v) for v in spec.get("allowed_values") or []]
        invalid = ~cols.as_text(df, c).isin(allowed) if allowed else F.lit(False)
        counted.append(
            (
                c,
                {
                    "missing": F.count(F.lit(1)) - F.count(value),
                    "out_of_range": F.count(F.when(outside, 1)),
                    "not_allowed": F.count(F.when(invalid, 1)),
                },
            )
        )
        code = spec.get("impute_strategy", "mode")
        here = F.col("column") == c
        strategy = F.when(here, _SUGGESTED.get(code, KEEP)).otherwise(strategy)
        reason = F.when(here, f"Dictionary suggests {code} for {spec.get('data_type')}").otherwise(reason)
    some = F.col("missing") > 0
    return cols.rows_from_aggregate(df, counted).select(
        "column", "missing", "out_of_range", "not_allowed",
        F.when(some, strategy).alias("strategy"), F.when(some, reason).alias("reason"),
    )



def reconcile_strategies(proposals: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One strategy per column: the proposal, else the dictionary, else keep.

    Both tables hold (column, strategy); short codes become labels.
    """
    label = F.try_element_at(
        F.create_map(*[F.lit(x) for pair in STRATEGY_LABELS.items() for x in pair]),
        F.lower("strategy"),
    )

    def labelled(table: DataFrame, name: str) -> DataFrame:
        return table.groupBy("column").agg(F.max(F.coalesce(label, "strategy")).alias(name))

    both = labelled(proposals, "proposed").join(labelled(dictionary, "suggested"), "column", "full_outer")
    return both.select(
        "column",
        F.coalesce("proposed", "suggested", F.lit(KEEP)).alias("strategy"),
        F.when(F.col("proposed").isNotNull(), "proposal")
        .when(F.col("suggested").isNotNull(), "dictionary")
        .alias("origin"),
    )
