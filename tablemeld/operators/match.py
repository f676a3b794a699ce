"""Schema matching: rule-based, by similarity across data sets, drift and merging.

Column names and types are metadata.  Names of the master schema become literals of
one projection over the (column) table, so matching needs no join; row data is only
touched by the aggregates that describe columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tablemeld import columns as cols
from tablemeld.functions import fixed_values as fv, names
from tablemeld.functions.values import lookup
from tablemeld.operators import levels as lv, partners
from tablemeld.operators.facts import ColumnFacts, fit_facts
from tablemeld.operators.profile import facts_table
from tablemeld.sources.metadata import MasterSchema
from tablemeld.storage import materialize

UNMAPPED = "UNMAPPED"


def column_table(df: DataFrame) -> DataFrame:
    """(ord, source_column) of a table."""
    return df.sparkSession.createDataFrame(
        list(enumerate(df.columns)), "ord int, source_column string"
    )


def confidence_level(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.9, "high")
        .when(confidence >= 0.7, "medium")
        .when(confidence >= 0.5, "low")
        .otherwise("uncertain")
    )


def _candidate(target: Column, confidence: float, reason: Column) -> Column:
    return F.when(
        target.isNotNull(),
        F.struct(target.alias("target"), F.lit(confidence).alias("confidence"), reason.alias("reason")),
    )


def match_columns(source_columns: DataFrame, schema: MasterSchema) -> DataFrame:
    """One mapping per source column: exact, normalized, alias, then partial name match."""
    source = F.col("source_column")
    lower = F.lower(source)
    normal = F.translate(lower, " -", "__")
    by_name = {c.name.lower(): c.name for c in schema.columns}
    by_canonical = {c.canonical_name.lower(): c.name for c in schema.columns}
    by_alias = {a.lower(): c.name for c in schema.columns for a in c.aliases}
    alias = lookup(lower, by_alias)
    partial = F.coalesce(
        *[
            F.when(F.lit(low).contains(normal) | normal.contains(F.lit(low)), F.lit(name))
            for low, name in by_name.items()
        ],
        F.lit(None).cast("string"),
    )
    best = F.coalesce(
        _candidate(lookup(lower, by_name), 1.0, F.lit("same name")),
        _candidate(lookup(normal, by_canonical), 0.95, F.lit("same name after normalization")),
        _candidate(alias, 0.90, F.format_string("%s is listed as an alias of %s", source, alias)),
        _candidate(partial, 0.70, F.format_string("%s and %s share part of the name", source, partial)),
        F.struct(
            F.lit(UNMAPPED).alias("target"),
            F.lit(0.0).alias("confidence"),
            F.lit("no rule applies").alias("reason"),
        ),
    )
    return source_columns.withColumn("__best", best).select(
        "ord",
        "source_column",
        F.col("__best.target").alias("target_column"),
        F.col("__best.confidence").alias("confidence"),
        confidence_level(F.col("__best.confidence")).alias("confidence_level"),
        (F.col("__best.target") != UNMAPPED).alias("is_auto_mapped"),
        (F.col("__best.confidence") < fv.REVIEW_BELOW).alias("requires_review"),
        F.col("__best.reason").alias("reason"),
    )


def mapping_pairs(mappings: DataFrame) -> list[tuple[str, str]]:
    """(source, target) pairs in source order; one row per column of a table."""
    return [
        (r["source_column"], r["target_column"])
        for r in mappings.orderBy("ord").select("source_column", "target_column").collect()
    ]


def merge_mappings(rules: DataFrame, proposals: DataFrame) -> DataFrame:
    """Rule mappings and proposals (source_column, target_column, confidence, reason).

    The higher confidence wins; rules win ties unless they found nothing.
    """
    theirs = (
        proposals.where(F.col("source_column") != "")
        .select(
            "source_column",
            F.coalesce("target_column", F.lit(UNMAPPED)).alias("p_target"),
            F.coalesce(F.col("confidence"), F.lit(0.0)).alias("p_confidence"),
            F.col("reason").alias("p_reason"),
        )
        .groupBy("source_column")
        .agg(
            F.max_by(F.struct("p_target", "p_confidence", "p_reason"), "p_confidence").alias("p")
        )
    )
    joined = rules.join(theirs, "source_column", "full_outer")
    keep_rule = F.col("p").isNull() | (
        (F.col("target_column") != UNMAPPED) & (F.col("confidence") >= F.col("p.p_confidence"))
    )
    keep_rule = F.coalesce(keep_rule, F.lit(False))
    confidence = F.when(keep_rule, F.col("confidence")).otherwise(F.col("p.p_confidence"))
    return joined.select(
        "ord",
        "source_column",
        F.when(keep_rule, F.col("target_column")).otherwise(F.col("p.p_target")).alias("target_column"),
        confidence.alias("confidence"),
        confidence_level(confidence).alias("confidence_level"),
        F.when(keep_rule, F.col("is_auto_mapped")).otherwise(confidence >= fv.REVIEW_BELOW).alias("is_auto_mapped"),
        (confidence < fv.REVIEW_BELOW).alias("requires_review"),
        F.when(keep_rule, F.col("reason")).otherwise(F.col("p.p_reason")).alias("reason"),
    )


def schema_drift(
    mappings: DataFrame, schema: MasterSchema, ambiguous: Sequence[str] = ()
) -> DataFrame:
    """One row: missing required and extra columns, drift score and severity."""
    required = [c.name for c in schema.columns if c.is_required]
    expected = len(set(schema.names))
    mapped = F.collect_set(F.when(F.col("target_column") != UNMAPPED, F.col("target_column")))
    extra = F.sort_array(F.collect_list(F.when(F.col("target_column") == UNMAPPED, F.col("source_column"))))
    found = mappings.agg(
        F.count(F.lit(1)).alias("source_columns"), mapped.alias("mapped"), extra.alias("extra_columns")
    )
    missing = F.sort_array(
        F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), F.col("mapped"))
    )
    widest = F.greatest(F.lit(expected), F.col("source_columns"))
    score = F.lit(1.0) - F.size("mapped") / widest if expected else F.lit(0.0)
    return found.select(
        missing.alias("missing_columns"),
        "extra_columns",
        F.array(*map(F.lit, ambiguous)).cast("array<string>").alias("ambiguous_columns"),
        score.alias("drift_score"),
    ).withColumn(
        "drift_severity",
        F.when((F.size("missing_columns") > 0) | (F.col("drift_score") > 0.3), "blocking")
        .when((F.size("ambiguous_columns") > 0) | (F.col("drift_score") > 0.1), "fixable")
        .otherwise("ignorable"),
    )


def type_mismatches(mappings: DataFrame, source_types: DataFrame, schema: MasterSchema) -> DataFrame:
    """Mapped columns whose inferred type differs from the expected one.

    ``source_types`` holds (column, inferred_type).
    """
    expected = lookup(F.col("target_column"), {c.name: c.data_type for c in schema.columns})
    types = source_types.select(F.col("column").alias("source_column"), "inferred_type")
    return (
        mappings.where(F.col("target_column") != UNMAPPED)
        .join(types, "source_column")
        .select(
            "source_column", "target_column",
            F.col("inferred_type").alias("source_type"), expected.alias("expected_type"),
        )
        .where(F.col("source_type") != F.col("expected_type"))
    )


def validation_result(
    mappings: DataFrame, drift: DataFrame, mismatches: DataFrame | None = None,
    threshold: float = fv.VALID_SCHEMA_CONFIDENCE,
) -> DataFrame:
    """One row: mean confidence, validity and messages."""
    one = F.lit(1).alias("__k")
    confidence = mappings.agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence_score"))
    facts = [confidence.select(F.lit("c").alias("k"), F.struct("confidence_score").alias("c"))]
    facts.append(drift.select(F.lit("d").alias("k"), F.struct("missing_columns", "drift_severity").alias("d")))
    if mismatches is not None:
        message = F.format_string(
            "Type mismatch for '%s': expected %s, got %s",
            F.col("source_column"), F.col("expected_type"), F.col("source_type"),
        )
        facts.append(
            mismatches.agg(F.sort_array(F.collect_list(message)).alias("w")).select(
                F.lit("w").alias("k"), F.struct("w").alias("w")
            )
        )
    merged = cols.union_by_name(facts).groupBy(one).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("c", "d", "w")[: len(facts)]]
    )
    missing = F.col("d.missing_columns")
    errors = F.when(
        F.size(missing) > 0,
        F.array(F.concat(F.lit("Missing required columns: "), F.array_join(missing, ", "))),
    ).otherwise(F.array().cast("array<string>"))
    warnings = F.col("w.w") if mismatches is not None else F.array().cast("array<string>")
    return merged.select(
        F.col("c.confidence_score").alias("confidence_score"),
        (
            (F.size(missing) == 0)
            & (F.col("d.drift_severity") != "blocking")
            & (F.col("c.confidence_score") >= threshold)
        ).alias("is_valid"),
        errors.alias("validation_errors"),
        warnings.alias("validation_warnings"),
    )


def schema_difference(source_columns: DataFrame, schema: MasterSchema, dataset: str) -> DataFrame:
    """One row: master columns missing in the source and extra source columns."""
    master = F.array(*map(F.lit, sorted(set(schema.names)))).cast("array<string>")
    return source_columns.agg(F.collect_set("source_column").alias("source")).select(
        F.lit(dataset).alias("dataset"),
        F.sort_array(F.array_except(master, F.col("source"))).alias("missing_in_source"),
        F.sort_array(F.array_except(F.col("source"), master)).alias("extra_in_source"),
    )


# --- similarity across data sets ------------------------------------------------


@F.pandas_udf(T.DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of column names: metadata rows, never data rows."""
    return pd.Series([names.similarity(x, y) for x, y in zip(a, b)], dtype=float)


def column_pairs(
    source: DataFrame,
    target: DataFrame,
    source_facts: Mapping[str, ColumnFacts],
    target_facts: Mapping[str, ColumnFacts],
) -> DataFrame:
    """Every (source column, target column) pair with the moments of both sides."""
    spark: SparkSession = source.sparkSession

    def side(df: DataFrame, facts: Mapping[str, ColumnFacts], p: str) -> DataFrame:
        return facts_table(df, facts).select(
            F.col("ord").alias(f"{p}_ord"), F.col("column").alias(f"{p}_column"),
            F.col("kind").isin("integer", "float").alias(f"{p}_numeric"),
            F.col("non_null_count").alias(f"{p}_present"),
            F.col("mean").alias(f"{p}_mean"), F.col("std").alias(f"{p}_std"),
        )

    pairs = spark.createDataFrame(
        [(s, list(target_facts)) for s in source_facts], "s_column string, targets array<string>"
    ).select("s_column", F.explode("targets").alias("t_column"))
    return pairs.join(F.broadcast(side(source, source_facts, "s")), "s_column").join(
        F.broadcast(side(target, target_facts, "t")), "t_column"
    )


#: Columns of either side whose sets are kept as bits at once.
SET_COLUMNS = 256


def column_sets(source: DataFrame, s_names: Sequence[str], target: DataFrame, t_names: Sequence[str]) -> DataFrame:
    """(source_set, target_set, values): how many distinct values exactly these columns hold.

    A value's columns are bits, so each value is one row, whatever the number of columns that hold
    it, and values of equal sets collapse to a count.  Sets are arrays of column numbers.
    """
    def placed(df: DataFrame, names_: Sequence[str], first: int) -> DataFrame:
        number = lookup(F.col("column"), {c: str(first + i) for i, c in enumerate(names_)}).cast("int")
        return lv.level_counts(df, names_).select("value", number.alias("bit"))

    s_words, t_words = (-(-len(n) // 64) for n in (s_names, t_names))
    bits = placed(source, s_names, 0).unionByName(placed(target, t_names, 64 * s_words))
    mask = F.expr("shiftleft(1L, bit % 64)")
    words = [f"w{k}" for k in range(s_words + t_words)]
    held = bits.groupBy("value").agg(*[F.bit_or(F.when(F.floor(F.col("bit") / 64) == k, mask).otherwise(F.lit(0).cast("long"))).alias(w) for k, w in enumerate(words)])

    def members(mine: Sequence[str], count: int) -> Column:
        numbers = F.sequence(F.lit(0), F.lit(count - 1))
        words_ = F.array(*map(F.col, mine))
        return F.filter(numbers, lambda i: F.get(words_, F.floor(i / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(i, F.lit(64)))) != 0)

    sets = held.groupBy(*words).agg(F.count(F.lit(1)).alias("values"))
    return sets.select(members(words[:s_words], len(s_names)).alias("source_set"), members(words[s_words:], len(t_names)).alias("target_set"), "values")


def level_overlap(source: DataFrame, target: DataFrame, pairs: DataFrame) -> DataFrame:
    """(s_column, t_column, jaccard) of the distinct values of the given column pairs.

    Pairs are made from the sets of columns that hold the same values (``column_sets``), not from
    values, so a value that all columns hold costs one row.
    """
    spark, sides = source.sparkSession, pairs.select("s_column", "t_column").collect()
    if not sides:
        return spark.createDataFrame([], "s_column string, t_column string, jaccard double")
    found = []
    for s_names in cols.batches(sorted({r[0] for r in sides}), SET_COLUMNS):
        for t_names in cols.batches(sorted({r[1] for r in sides}), SET_COLUMNS):
            sets = column_sets(source, s_names, target, t_names)
            # number -1 stands for a side as a whole: its pairs are the sizes of the other side's columns
            either = lambda c: F.explode(F.array_append(c, F.lit(-1)))
            counted = materialize(
                sets.select(either(F.col("source_set")).alias("s"), "target_set", "values").select("s", either(F.col("target_set")).alias("t"), "values")
                .groupBy("s", "t").agg(F.sum("values").alias("values")),
                "overlap",
            )
            size_s = counted.where("t = -1").select("s", F.col("values").alias("s_levels"))
            size_t = counted.where("s = -1").select("t", F.col("values").alias("t_levels"))
            named = lambda number, names_: lookup(number.cast("string"), {str(i): c for i, c in enumerate(names_)})
            shared = counted.where("s >= 0 and t >= 0").join(F.broadcast(size_s), "s").join(F.broadcast(size_t), "t")
            found.append(shared.select(
                named(F.col("s"), s_names).alias("s_column"), named(F.col("t"), t_names).alias("t_column"),
                (F.col("values") / (F.col("s_levels") + F.col("t_levels") - F.col("values"))).alias("jaccard"),
            ))
    return pairs.select("s_column", "t_column").join(cols.union_by_name(found), ["s_column", "t_column"], "left").withColumn(
        "jaccard", F.coalesce("jaccard", F.lit(0.0))
    )


def _closeness(a: Column, b: Column) -> Column:
    return 1 - F.least(F.abs(a - b) / (F.abs(a) + F.abs(b) + 1e-6), F.lit(1.0))


def distribution_similarity(source: DataFrame, target: DataFrame) -> DataFrame:
    """Similarity of the value distributions of all column pairs, three decimals.

    Numbers: closeness of mean and standard deviation.  Otherwise: overlap of levels.
    """
    source_facts, target_facts = fit_facts(source), fit_facts(target)
    pairs = column_pairs(source, target, source_facts, target_facts)
    both = F.col("s_numeric") & F.col("t_numeric")
    overlap = level_overlap(source, target, pairs.where(~both))
    moments = (
        _closeness(F.col("s_mean"), F.col("t_mean")) + _closeness(F.col("s_std"), F.col("t_std"))
    ) / 2
    value = F.when(both, F.coalesce(moments, F.lit(0.0))).otherwise(F.col("jaccard"))
    some = (F.col("s_present") > 0) & (F.col("t_present") > 0)
    return pairs.join(F.broadcast(overlap), ["s_column", "t_column"], "left").select(
        "s_ord",
        F.col("s_column").alias("source_column"),
        "t_ord",
        F.col("t_column").alias("target_column"),
        F.when(some, F.round(value, 3)).otherwise(F.lit(0.0)).alias("distribution_similarity"),
    )


def match_datasets(
    source: DataFrame,
    target: DataFrame,
    source_labels: Mapping[str, str] | None = None,
    target_labels: Mapping[str, str] | None = None,
    threshold: float = 0.8,
    one_to_one: bool = False,
) -> DataFrame:
    """Best target column per source column by name, label and distribution.

    Confidence is half name, a fifth label, the rest distribution similarity.  Names are only
    compared where their letters still allow the best confidence (``partners``).  With
    ``one_to_one`` a target keeps only its best source.
    """
    def label(column: str, labels: Mapping[str, str] | None) -> Column:
        return F.coalesce(lookup(F.col(column), labels or {}), F.lit(""))

    labelled = bool(source_labels and target_labels)
    pairs = distribution_similarity(source, target).withColumns({
        "source_label": label("source_column", source_labels if labelled else None),
        "target_label": label("target_column", target_labels if labelled else None),
    })
    # the rows of one source column are as many as the target has columns
    by_name, by_label, by_values = partners.WEIGHTS
    best = pairs.groupBy("source_column").applyInPandas(partners.best_of_source, partners.BEST).withColumn(
        "confidence", F.round(by_name * F.col("name") + by_label * F.col("label") + by_values * F.col("distribution_similarity"), 3)
    )
    if one_to_one:
        per_target = Window.partitionBy("target_column").orderBy(F.desc("confidence"), "s_ord")
        best = best.withColumn("rank", F.row_number().over(per_target)).where(F.col("rank") == 1)
    return best.select(
        F.col("s_ord").alias("ord"),
        "source_column",
        "target_column",
        "confidence",
        F.when(F.col("confidence") >= threshold, "auto").otherwise("review").alias("status"),
        F.round("name", 3).alias("name_similarity"),
        F.round("label", 3).alias("label_similarity"),
        "distribution_similarity",
    )
