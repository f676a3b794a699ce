"""Column references, type families and the long (column, value) form of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)

#: Aggregate expressions per job; wide surveys are split so that generated code
#: stays below the JVM method limit.
EXPRESSIONS_PER_JOB = 200


def ref(name: str) -> Column:
    """A column by its literal name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def base_type(data_type: T.DataType) -> str:
    """Semantic type that the storage type alone decides."""
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, INTEGRAL):
        return "integer"
    if isinstance(data_type, FRACTIONAL):
        return "float"
    if isinstance(data_type, TEMPORAL):
        return "datetime"
    if isinstance(data_type, T.StringType):
        return "string"
    return "unknown"


def is_numeric(data_type: T.DataType) -> bool:
    """Numbers only: booleans are treated as categories."""
    return isinstance(data_type, INTEGRAL + FRACTIONAL)


def is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.StringType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def columns_like(df: DataFrame, keywords: Iterable[str]) -> list[str]:
    """Columns whose lower-cased name contains one of the keywords."""
    words = [w.lower() for w in keywords]
    return [c for c in df.columns if any(w in c.lower() for w in words)]


def type_counts(df: DataFrame) -> DataFrame:
    """Number of columns per storage type."""
    types = df.sparkSession.createDataFrame(
        [(f.dataType.simpleString(),) for f in df.schema.fields], "data_type string"
    )
    return types.groupBy("data_type").agg(F.count(F.lit(1)).alias("columns"))


def first_present(candidates: Sequence[str], *frames: DataFrame) -> str | None:
    """First candidate column that every frame has."""
    return next((c for c in candidates if all(c in df.columns for df in frames)), None)


def present(candidates: Sequence[str], *frames: DataFrame) -> list[str]:
    """Candidate columns that every frame has."""
    return [c for c in candidates if all(c in df.columns for df in frames)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Treat floating-point NaN as a missing value."""
    if not any(isinstance(f.dataType, (T.FloatType, T.DoubleType)) for f in df.schema.fields):
        return df
    return df.select(
        *[
            F.when(~F.isnan(ref(f.name)), ref(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.FloatType, T.DoubleType))
            else ref(f.name)
            for f in df.schema.fields
        ]
    )


def as_text(df: DataFrame, name: str) -> Column:
    """The value as text, with both zeros written alike."""
    column = ref(name)
    if isinstance(type_of(df, name), (T.FloatType, T.DoubleType)):
        column = F.when(column == 0, F.lit(0.0)).otherwise(column)
    return column.cast("string")


def as_double(df: DataFrame, name: str) -> Column:
    return ref(name).cast("double")


def to_long(df: DataFrame, names: Sequence[str], value: Callable[[DataFrame, str], Column]) -> DataFrame:
    """One (column, value) row per non-null cell; all values must have one type."""
    wide = df.select(*[value(df, c).alias(c) for c in names])
    return wide.unpivot([], [ref(c) for c in names], "column", "value").where(
        F.col("value").isNotNull()
    )


def batches(items: Sequence, size: int) -> list[list]:
    return [list(items[i : i + size]) for i in range(0, len(items), max(size, 1))]


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL with columns lined up by name; absent columns become null."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def rows_from_aggregate(df: DataFrame, per_column: Sequence[tuple[str, dict]]) -> DataFrame:
    """Aggregate a table once and turn the result into one row per column.

    ``per_column`` lists ``(column name, {field: aggregate expression})`` with the
    same fields for every column.  Wide tables are split into several aggregates;
    each one reads only its own columns.
    """
    if not per_column:
        raise ValueError("no columns to aggregate")
    fields = list(per_column[0][1])
    size = max(1, EXPRESSIONS_PER_JOB // max(len(fields), 1))
    parts = []
    for group in batches(per_column, size):
        wide = df.agg(
            *[
                expressions[field].alias(f"{i}_{j}")
                for i, (_, expressions) in enumerate(group)
                for j, field in enumerate(fields)
            ]
        )
        rows = F.array(
            *[
                F.struct(
                    F.lit(name).alias("column"),
                    *[F.col(f"`{i}_{j}`").alias(field) for j, field in enumerate(fields)],
                )
                for i, (name, _) in enumerate(group)
            ]
        )
        parts.append(wide.select(F.inline(rows)))
    return union_by_name(parts)
