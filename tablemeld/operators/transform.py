"""Column transforms chosen from data and schema, projections and renames."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from tablemeld import columns as cols
from tablemeld.functions import casts, fixed_values as fv, names, scales, text, values
from tablemeld.operators.facts import ColumnFacts, exact_quantiles, fit_facts
from tablemeld.operators.joins import weighted_lookup
from tablemeld.operators.ranks import FrozenRanks, freeze_ranks, with_frozen_rank, with_percentile_rank

# --- value maps -----------------------------------------------------------------


def map_values(df: DataFrame, column: str, mapping: DataFrame, default: str | None = None) -> DataFrame:
    """Map a column by a (raw, canonical) table; unknown values pass through.

    The map is deduplicated by raw value and broadcast only when its size allows;
    beyond it the heaviest values are still looked up without a shuffle.
    """
    table = mapping.groupBy(F.col("raw").alias("__raw")).agg(F.min("canonical").alias("__canonical"))
    key = cols.ref(column).cast("string")
    joined = weighted_lookup(df.withColumn("__raw", key), table, ["__raw"])
    fallback = key if default is None else F.lit(default)
    mapped = F.when(key.isNotNull(), F.coalesce("__canonical", fallback)).alias(column)
    return joined.select(*[mapped if c == column else cols.ref(c) for c in df.columns])


# --- scales ---------------------------------------------------------------------


@dataclass(frozen=True)
class ScaleFit:
    """How to bring one column to a target scale."""

    low: float
    high: float
    target_low: float
    target_high: float
    method: str = "linear"
    bands: tuple[tuple[float, float], ...] = ()
    #: Percentile ranks of the fitted values; without them a percentile scale ranks its input.
    frozen: FrozenRanks | None = None


#: Set while an increment is transformed: its own ranks would not be those of the fit.
_INCREMENT: ContextVar[bool] = ContextVar("increment", default=False)


@contextmanager
def increments() -> Iterator[None]:
    """Transforms inside refuse percentile scales whose ranks are not frozen."""
    token = _INCREMENT.set(True)
    try:
        yield
    finally:
        _INCREMENT.reset(token)


def freeze_scales(df: DataFrame, fits: Mapping[str, ScaleFit]) -> dict[str, ScaleFit]:
    """The fits, percentile scales with the ranks of ``df``."""
    return {
        c: replace(f, frozen=freeze_ranks(df, c)) if f.method == "percentile" else f for c, f in fits.items()
    }


def fit_scales(
    df: DataFrame,
    targets: Mapping[str, tuple[float, float]],
    facts: Mapping[str, ColumnFacts] | None = None,
    detect_mixed: bool = False,
) -> dict[str, ScaleFit]:
    """Scale parameters of the columns whose observed bounds differ from the target.

    The method is ``percentile`` where the central 98 % of the values covers less
    than 70 % of the range, and ``piecewise`` where several response scales are mixed.
    """
    facts = facts or fit_facts(df, targets)
    needed = [
        c
        for c, (low, high) in targets.items()
        if facts[c].numeric
        and facts[c].low is not None
        and facts[c].high > facts[c].low
        and (facts[c].low, facts[c].high) != (low, high)
    ]
    spread = exact_quantiles(
        df, {c: [0.01, 0.99] for c in needed if facts[c].present >= 5}, facts
    )
    bands = mixed_bands(df, needed, facts) if detect_mixed else {}
    fits = {}
    for c in needed:
        method = "linear"
        if c in spread:
            share = (spread[c][0.99] - spread[c][0.01]) / (facts[c].high - facts[c].low)
            method = "percentile" if share < fv.PERCENTILE_SPREAD else "linear"
        if len(bands.get(c, ())) > 1:
            method = "piecewise"
        low, high = targets[c]
        fits[c] = ScaleFit(facts[c].low, facts[c].high, low, high, method, tuple(bands.get(c, ())))
    return fits


def mixed_bands(
    df: DataFrame, names_: Sequence[str], facts: Mapping[str, ColumnFacts]
) -> dict[str, list[tuple[float, float]]]:
    """Response-scale bands that hold at least 15 % of a column's values, in order."""
    found: dict[str, list[tuple[float, float]]] = {}
    if not names_:
        return found
    rows = cols.rows_from_aggregate(
        df,
        [
            (
                c,
                {
                    label: F.count(F.when(cols.as_double(df, c).between(low, high), 1))
                    for label, low, high in fv.MIXED_BANDS
                },
            )
            for c in names_
        ],
    ).collect()
    for row in rows:
        total = facts[row["column"]].present
        found[row["column"]] = [
            (low, high)
            for label, low, high in fv.MIXED_BANDS
            if total and row[label] / total >= fv.MIXED_BAND_SHARE
        ]
    return found


def scale_expression(column: Column, fit: ScaleFit) -> Column:
    """Linear or piecewise rescaling (percentile ranks need the whole table)."""
    if fit.method == "piecewise":
        return scales.piecewise(column, fit.bands, fit.target_low, fit.target_high)
    return scales.linear(column, fit.low, fit.high, fit.target_low, fit.target_high)


def apply_scales(df: DataFrame, fits: Mapping[str, ScaleFit]) -> DataFrame:
    """Rescale the fitted columns by their methods."""
    plain = {c: scale_expression(cols.ref(c), f) for c, f in fits.items() if f.method != "percentile"}
    result = df.withColumns(plain) if plain else df
    for c, f in fits.items():
        if f.method == "percentile":
            if f.frozen is None and (_INCREMENT.get() or df.isStreaming):
                raise ValueError(f"the percentile scale of {c} has no frozen ranks: freeze it on the fitted table")
            if f.frozen is None:
                result = with_percentile_rank(result, c, "__rank")
            else:
                result = with_frozen_rank(result, c, f.frozen, "__rank")
            scaled = F.col("__rank") * (f.target_high - f.target_low) + f.target_low
            result = result.withColumn(c, scaled).drop("__rank").select(*map(cols.ref, df.columns))
    return result


def fixed_scale_columns(facts: Mapping[str, ColumnFacts], scale: str) -> list[str]:
    """Numeric columns whose observed bounds lie on the scale."""
    return [c for c, f in facts.items() if f.numeric and scales.fits(scale, f.low, f.high)]


def convert_scale(df: DataFrame, scale: str, facts: Mapping[str, ColumnFacts] | None = None) -> DataFrame:
    """Convert every numeric column on the scale: to 0-100, or to categories for ``nps``."""
    facts = facts or fit_facts(df, cols.numeric_columns(df))
    change = scales.nps_category if scale == "nps" else lambda c: scales.fixed(c, scale)
    found = fixed_scale_columns(facts, scale)
    return df.withColumns({c: change(cols.ref(c)) for c in found}) if found else df


# --- dates ----------------------------------------------------------------------


def fit_date_patterns(
    df: DataFrame, names_: Sequence[str], patterns: Sequence[str] = fv.DATE_PATTERNS
) -> dict[str, dict[str, int]]:
    """How many values of each text column each pattern parses (one scan)."""
    if not names_:
        return {}
    rows = cols.rows_from_aggregate(
        df,
        [
            (
                c,
                {"present": F.count(cols.ref(c)), "rows": F.count(F.lit(1))}
                | {f"p{i}": n for i, n in enumerate(casts.pattern_counts(cols.ref(c), patterns).values())},
            )
            for c in names_
        ],
    ).collect()
    return {
        r["column"]: {"present": r["present"], "rows": r["rows"]}
        | {p: r[f"p{i}"] for i, p in enumerate(patterns)}
        for r in rows
    }


def detect_date_pattern(counts: Mapping[str, int], patterns: Sequence[str] = fv.DATE_PATTERNS) -> str | None:
    """First pattern that parses every value."""
    present = counts["present"]
    return next((p for p in patterns if present and counts[p] == present), None)


def fit_dates(df: DataFrame, names_: Sequence[str] | None = None, share: float = 0.5) -> dict[str, str]:
    """Date-like text columns and the pattern that parses most of their values.

    Only columns where more than ``share`` of all rows parse are returned.
    """
    if names_ is None:
        names_ = [c for c in cols.columns_like(df, fv.DATE_WORDS) if cols.is_text(cols.type_of(df, c))]
    chosen = {}
    for c, counts in fit_date_patterns(df, names_, casts.AUTO_PATTERNS).items():
        best = max(casts.AUTO_PATTERNS, key=lambda p: (counts[p], -casts.AUTO_PATTERNS.index(p)))
        if counts[best] > counts["rows"] * share:
            chosen[c] = best
    return chosen


def standardize_dates(df: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """Fitted date columns as ``yyyy-MM-dd`` text; temporal date-like columns too.

    A value that the fitted pattern cannot read is read by the first other pattern that can.
    """
    change = {c: _by_patterns(cols.ref(c), p) for c, p in patterns.items()}
    for c in cols.columns_like(df, fv.DATE_WORDS):
        if isinstance(cols.type_of(df, c), cols.TEMPORAL):
            change[c] = casts.format_date(cols.ref(c), temporal=True)
    return df.withColumns(change) if change else df


def _by_patterns(column: Column, pattern: str) -> Column:
    others = [p for p in casts.AUTO_PATTERNS if p != pattern]
    return F.coalesce(casts.format_date(column, pattern), F.date_format(casts.parse_timestamp(column, None, others), "yyyy-MM-dd"))


def date_losses(df: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """(column, present, by_fitted, by_other, lost) of the fitted date columns."""
    def counts(c: str, p: str) -> dict[str, Column]:
        column, main = cols.ref(c), casts.parse_timestamp(cols.ref(c), p)
        read = _by_patterns(column, p)
        return {
            "present": F.count(column), "by_fitted": F.count(main),
            "by_other": F.count(F.when(main.isNull(), read)), "lost": F.count(F.when(read.isNull(), column)),
        }

    return cols.rows_from_aggregate(df, [(c, counts(c, p)) for c, p in patterns.items()])


def repair_separators(df: DataFrame, names_: Iterable[str] | None = None) -> DataFrame:
    """``' > '`` back to ``'-'`` in date-like text columns."""
    chosen = cols.columns_like(df, fv.DATE_WORDS) if names_ is None else names_
    change = {
        c: text.repair_separator(cols.ref(c))
        for c in chosen
        if c in df.columns and cols.is_text(cols.type_of(df, c))
    }
    return df.withColumns(change) if change else df


# --- code lists, text and numbers -----------------------------------------------


def standardize_codes(df: DataFrame, kind: str, names_: Sequence[str] | None = None) -> DataFrame:
    """Region, country or category codes in text columns named accordingly."""
    words, change = {
        "region": (fv.REGION_WORDS, values.region_code),
        "country": (fv.COUNTRY_WORDS, values.country_code),
        "category": (fv.CATEGORY_WORDS, values.category_code),
    }[kind]
    chosen = cols.columns_like(df, words) if names_ is None else names_
    changed = {c: change(cols.ref(c)) for c in chosen if cols.is_text(cols.type_of(df, c))}
    return df.withColumns(changed) if changed else df


def clean_text_columns(
    df: DataFrame, names_: Sequence[str] | None = None, normalize_separators: bool = True
) -> DataFrame:
    """Cleaned text in every text column."""
    chosen = cols.text_columns(df) if names_ is None else names_
    changed = {c: text.clean_text(cols.ref(c), normalize_separators) for c in chosen}
    return df.withColumns(changed) if changed else df


def fit_numeric(df: DataFrame, share: float = 0.8) -> list[str]:
    """Text columns where more than ``share`` of all rows hold a number."""
    chosen = cols.text_columns(df)
    if not chosen:
        return []
    rows = cols.rows_from_aggregate(
        df,
        [
            (c, {"rows": F.count(F.lit(1)), "numbers": F.count(casts.to_number(cols.ref(c)))})
            for c in chosen
        ],
    ).collect()
    return [r["column"] for r in rows if r["numbers"] > r["rows"] * share]


def to_numeric(df: DataFrame, names_: Sequence[str]) -> DataFrame:
    """Text columns as doubles; values that are not numbers become null."""
    return df.withColumns({c: casts.to_number(cols.ref(c)) for c in names_}) if names_ else df


# --- projections and renames ----------------------------------------------------


def standardize_names(df: DataFrame, remove_special: bool = True) -> DataFrame:
    return df.toDF(*names.standardized(df.columns, remove_special))


def snake_case_names(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snake-case headers, and the (source, standard) table of the renames."""
    standard = [names.snake_case(c) for c in df.columns]
    table = df.sparkSession.createDataFrame(
        list(zip(df.columns, standard)), "source_column string, standard_column string"
    )
    return df.toDF(*standard), table


def deduplicate_names(df: DataFrame) -> DataFrame:
    return df.toDF(*names.deduplicated(df.columns))


def project_mapping(
    df: DataFrame, mapping: Iterable[tuple[str, str | None]]
) -> tuple[DataFrame, dict[str, str], list[str]]:
    """Mapped columns under their target names; first source of a target wins.

    Returns the table, the source of every target, and warnings about the rest.
    """
    sources: dict[str, str] = {}
    warnings = []
    for source, target in mapping:
        if not target or target == "UNMAPPED":
            warnings.append(f"{source} has no target and is left out")
        elif source not in df.columns:
            warnings.append(f"{source} is mapped but the table lacks it")
        elif target in sources:
            warnings.append(f"Target {target} already taken by {sources[target]}: {source}")
        else:
            sources[target] = source
    return df.select(*[cols.ref(s).alias(t) for t, s in sources.items()]), sources, warnings


def apply_decisions(df: DataFrame, decisions: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Rename, keep or drop columns by decision; first source of a target wins."""
    taken: set[str] = set()
    kept = []
    for source in df.columns:
        decision = decisions.get(source, {})
        action, target = decision.get("action", "confirm"), decision.get("target")
        if action == "skip":
            continue
        rename = action in ("confirm", "map_to") and target and target != "UNMAPPED"
        if rename and target not in taken:
            taken.add(target)
            kept.append(cols.ref(source).alias(target))
        else:
            kept.append(cols.ref(source))
    return df.select(*kept)


def reorder(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Columns in the given order, all others after them."""
    first = [c for c in dict.fromkeys(order) if c in df.columns]
    return df.select(*map(cols.ref, first), *[cols.ref(c) for c in df.columns if c not in first])


SPARK_TYPES = {
    "string": "string", "categorical": "string", "integer": "bigint", "float": "double",
    "boolean": "boolean", "datetime": "string",
}


def add_required(df: DataFrame, required: Iterable[tuple[str, str, Any]]) -> tuple[DataFrame, list[str]]:
    """Add absent required columns (name, semantic type, default value)."""
    absent = [(n, t, d) for n, t, d in required if n not in df.columns]
    if not absent:
        return df, []
    added = {
        n: F.lit(None if d is None else str(d)).try_cast(SPARK_TYPES.get(t, "string")) for n, t, d in absent
    }
    return df.withColumns(added), list(added)


# --- named transforms -----------------------------------------------------------


@dataclass(frozen=True)
class Transform:
    """A named column transform with its parameters."""

    kind: str
    options: Mapping[str, Any] = field(default_factory=dict)


def _date_format(column: Column, o: Mapping[str, Any]) -> Column:
    return casts.format_date(
        column, o.get("source_pattern"), o.get("target_pattern", "yyyy-MM-dd"), o.get("temporal", False)
    )


_REGISTRY: dict[str, Callable[[Column, Mapping[str, Any]], Column]] = {
    "scale_normalize": lambda c, o: scale_expression(c, o["fit"]),
    "value_map": lambda c, o: values.value_map(
        c, o["entries"], o.get("default"), o.get("case_sensitive", True)
    ),
    "type_cast": lambda c, o: casts.cast_to(c, o["target"], o.get("source", "string")),
    "date_format": _date_format,
    "string_standardize": lambda c, o: text.standardize(c, o.get("operations", ("strip",))),
    "identity": lambda c, o: c,
}


def register_transform(name: str, build: Callable[[Column, Mapping[str, Any]], Column]) -> None:
    """Make a transform available by name; ``build`` gets the column and its options."""
    _REGISTRY[name] = build


def transform_column(column: Column, transform: Transform) -> Column:
    """The transformed column.

    ``custom`` evaluates an SQL expression (option ``sql``) over the table's columns.
    """
    if transform.kind == "custom":
        return F.expr(transform.options["sql"])
    if transform.kind not in _REGISTRY:
        raise ValueError(f"unknown transform: {transform.kind}")
    return _REGISTRY[transform.kind](column, transform.options)


def _needs_ranks(transform: Transform) -> bool:
    return transform.kind == "scale_normalize" and transform.options["fit"].method == "percentile"


def apply_transforms(
    df: DataFrame, sources: Mapping[str, str], transforms: Mapping[str, Transform]
) -> DataFrame:
    """One projection: each target column from its source through its transform.

    Percentile scales follow as lookup joins.
    """
    selected = []
    ranked = {}
    for target, source in sources.items():
        transform = transforms.get(target, Transform("identity"))
        if _needs_ranks(transform):
            ranked[target] = transform.options["fit"]
            selected.append(cols.ref(source).alias(target))
        else:
            selected.append(transform_column(cols.ref(source), transform).alias(target))
    return apply_scales(df.select(*selected), ranked)


def choose_transforms(
    df: DataFrame,
    sources: Mapping[str, str],
    schema: Any,
    value_maps: Mapping[str, Mapping[str, str]],
    facts: Mapping[str, ColumnFacts] | None = None,
    scale_bounds: str = "observed",
    detect_mixed: bool = False,
) -> dict[str, Transform]:
    """A transform per target column: value map, scale, date, cast, then text strip.

    ``scale_bounds="declared"`` leaves columns alone whose values already lie inside
    the target scale.
    """
    facts = facts or fit_facts(df, list(dict.fromkeys(sources.values())))
    scaled, dated = {}, []
    for target, source in sources.items():
        spec = schema.column(target)
        if target in value_maps or spec is None:
            continue
        if facts[source].numeric and spec.min_value is not None and spec.max_value is not None:
            inside = facts[source].low is not None and (
                facts[source].low >= spec.min_value and facts[source].high <= spec.max_value
            )
            if not (scale_bounds == "declared" and inside):
                scaled[source] = (spec.min_value, spec.max_value)
        elif _is_date(spec.data_type) and facts[source].kind == "string":
            dated.append(source)
    fits = fit_scales(df, scaled, facts, detect_mixed) if scaled else {}
    patterns = fit_date_patterns(df, dated)
    chosen = {}
    for target, source in sources.items():
        spec = schema.column(target)
        kind = facts[source].kind
        wanted = spec.data_type if spec is not None else "string"
        if target in value_maps:
            chosen[target] = Transform("value_map", {"entries": value_maps[target]})
        elif spec is not None and source in fits:
            chosen[target] = Transform("scale_normalize", {"fit": fits[source]})
        elif _is_date(wanted) or kind == "datetime":
            options = {"temporal": kind == "datetime"}
            if source in patterns:
                options["source_pattern"] = detect_date_pattern(patterns[source])
            chosen[target] = Transform("date_format", options)
        elif spec is None or wanted in (kind, "categorical"):
            chosen[target] = Transform("string_standardize" if kind == "string" else "identity")
        else:
            chosen[target] = Transform("type_cast", {"target": wanted, "source": kind})
    return chosen


def _is_date(data_type: str) -> bool:
    return "date" in data_type.lower()


def transform_outcomes(
    df: DataFrame, sources: Mapping[str, str], transforms: Mapping[str, Transform]
) -> DataFrame:
    """Per column: values transformed and values lost (present before, null after)."""
    done = apply_row_transforms(df, sources, transforms)
    return cols.rows_from_aggregate(
        done,
        [
            (
                target,
                {
                    "source_column": F.max(F.lit(source)),
                    "transformation": F.max(F.lit(transforms[target].kind)),
                    "records": F.count(F.lit(1)),
                    "records_failed": F.count(
                        F.when(F.col(f"`{i}_before`").isNotNull() & F.col(f"`{i}_after`").isNull(), 1)
                    ),
                },
            )
            for i, (target, source) in enumerate(sources.items())
        ],
    )


def apply_row_transforms(
    df: DataFrame, sources: Mapping[str, str], transforms: Mapping[str, Transform]
) -> DataFrame:
    """Before and after value of every column (``{i}_before``, ``{i}_after``) in one projection."""
    pairs = []
    for i, (target, source) in enumerate(sources.items()):
        transform = transforms[target]
        after = (
            cols.ref(source) if _needs_ranks(transform) else transform_column(cols.ref(source), transform)
        )
        pairs += [cols.ref(source).alias(f"{i}_before"), after.alias(f"{i}_after")]
    return df.select(*pairs)


def transform_samples(
    df: DataFrame, source: str, transform: Transform, order_by: Sequence[str], k: int = 5
) -> DataFrame:
    """The first k (original, transformed) pairs in key order."""
    return (
        df.where(cols.ref(source).isNotNull())
        .orderBy(*map(cols.ref, order_by))
        .limit(k)
        .select(
            F.lit(source).alias("column"),
            F.lit(transform.kind).alias("transformation"),
            cols.ref(source).cast("string").alias("original"),
            transform_column(cols.ref(source), transform).cast("string").alias("transformed"),
        )
    )


def harmonize_column(column: Column, entries: Mapping[str, str] | None = None) -> Column:
    """One column: mapped by the entries, or stripped text without any."""
    return values.value_map(column, entries) if entries else text.standardize(column)
