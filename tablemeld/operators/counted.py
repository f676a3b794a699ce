"""One counted table that answers for all columns, and merges with that of more rows.

A table of cells is counted once by (column, value), missing cells included.  Everything that a
fit asks is then an aggregate or a prefix sum over the counts: sizes, moments, text lengths,
distinct values, modes, top values, quantiles and percentile ranks.  Quantiles of
all columns together come from bucket sizes: the range around each wanted rank is cut to equal
buckets, whose prefix sums say in which one the rank lies, until few values are left.

Counts of two tables add up, so a fit on a table and its increments is the fit on all their
rows, and no row is read again: ``CountStore`` keeps the counts of every increment.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tablemeld import columns as cols
from tablemeld.operators import levels as lv, ranks
from tablemeld.operators.facts import ColumnFacts
from tablemeld.sources.segments import Segments
from tablemeld.storage import materialize

#: A value is in the one field that fits its type; a missing cell has none.
SCHEMA = "column string, whole bigint, real double, text string, count bigint"
KEYS = ("column", "whole", "real", "text")
#: Buckets that a range is cut into, rounds of cutting, and values that are then summed up one by one.
BUCKETS, ROUNDS, PICKED = 4_096, 4, 200_000
#: Counted values that one task of a sort by ranges holds.
VALUES_PER_TASK = 500_000
_LARGEST = sys.float_info.max


@dataclass(frozen=True)
class _Bracket:
    """Bounds around a rank, the rows below them and the distinct values between them."""

    low: float
    high: float
    below: int
    values: int


def _present() -> Column:
    return F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("text").isNotNull()


def _field(kind: T.DataType) -> str:
    if isinstance(kind, cols.INTEGRAL):
        return "whole"
    return "real" if isinstance(kind, (T.FloatType, T.DoubleType)) else "text"


def count_cells(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Counts of all cells; one scan and shuffle for each kind of value, keys as short as its type."""
    values = {"whole": lambda c: cols.ref(c).cast("bigint"), "real": lambda c: cols.as_double(df, c), "text": lambda c: cols.as_text(df, c)}
    parts = []
    for field, value in values.items():
        group = [c for c in names if _field(cols.type_of(df, c)) == field]
        if group:
            cells = df.select(*[value(c).alias(c) for c in group]).unpivot([], [cols.ref(c) for c in group], "column", field)
            parts.append(cells.groupBy("column", field).agg(F.count(F.lit(1)).alias("count")))
    if not parts:
        return df.sparkSession.createDataFrame([], SCHEMA)
    empty = {f.name: F.lit(None).cast(f.dataType) for f in df.sparkSession.createDataFrame([], SCHEMA).schema if f.name in values}
    return cols.union_by_name([p.withColumns({k: v for k, v in empty.items() if k not in p.columns}).select(*KEYS, "count") for p in parts])


class Counts:
    """The written counts of a table's columns and what follows from them."""

    def __init__(self, table: DataFrame, types: Mapping[str, T.DataType]):
        self.table, self.types = table, dict(types)
        decimals = [c for c, t in self.types.items() if isinstance(t, T.DecimalType)]
        exact = F.when(F.col("column").isin(decimals), F.expr("try_cast(text AS double)"))
        self._number = F.coalesce(F.col("whole").cast("double"), F.col("real"), *([exact] if decimals else []))

    @classmethod
    def of(cls, df: DataFrame, names: Iterable[str] | None = None) -> Counts:
        df = cols.nan_to_null(df)
        names = list(df.columns if names is None else names)
        return cls(materialize(count_cells(df, names), "counts"), {c: cols.type_of(df, c) for c in names})

    def merge(self, other: Counts) -> Counts:
        """The counts of both tables' rows; a column that one table lacks has the other's."""
        return Counts(materialize(summed(self.table.unionByName(other.table)), "counts"), merged_types(self.types, other.types))

    # --- one row for each column, on the driver ----------------------------------

    @cached_property
    def _rows(self) -> dict[str, dict]:
        """Sizes, sums and bounds of every column, by one aggregate."""
        count, length, number = F.col("count"), F.length("text"), self._number
        found = self.table.groupBy("column").agg(
            F.sum("count").alias("rows"),
            F.sum(F.when(_present(), count)).alias("present"),
            F.count(F.when(_present(), 1)).alias("distinct"),
            F.sum(number * count).alias("sum"),
            F.min(number).alias("low"),
            F.max(number).alias("high"),
            F.sum(length * count).alias("letters"),
            F.min(length).alias("min_length"),
            F.max(length).alias("max_length"),
        )
        return {r["column"]: r.asDict() for r in found.collect()}

    @cached_property
    def _spread(self) -> dict[str, tuple[float, float, float]]:
        """Mean, and second and third central moments (sums).

        Sums about a first mean say by how much it is off, which matters for long numbers.
        """
        means = {c: r["sum"] / r["present"] for c, r in self._rows.items() if r["sum"] is not None}
        if not means:
            return {}
        middle = self.table.sparkSession.createDataFrame(list(means.items()), "column string, mean double")
        off = self._number - F.col("mean")
        found = self.table.filter(self._number.isNotNull()).join(F.broadcast(middle), "column").groupBy("column").agg(
            F.sum(F.col("count") * off).alias("m1"), F.sum(F.col("count") * off * off).alias("m2"), F.sum(F.col("count") * off * off * off).alias("m3")
        )
        spread = {}
        for c, m1, m2, m3 in found.collect():
            n = self._rows[c]["present"]
            d = m1 / n
            spread[c] = means[c] + d, max(0.0, m2 - n * d * d), m3 - 3 * d * m2 + 2 * n * d**3
        return spread

    def facts(self) -> dict[str, ColumnFacts]:
        """As ``fit_facts`` finds them in the rows."""
        found = {}
        for name, kind in self.types.items():
            row, base = self._rows.get(name, {}), cols.base_type(kind)
            n = row.get("present") or 0
            fact = {"column": name, "kind": base, "rows": row.get("rows") or 0, "present": n}
            if base in ("integer", "float") and n:
                mean, m2, _ = self._spread[name]
                fact |= {"mean": mean, "std": math.sqrt(m2 / (n - 1)) if n > 1 else None, "low": row["low"], "high": row["high"]}
            elif base == "string" and n:
                fact |= {"avg_length": row["letters"] / n, "min_length": row["min_length"], "max_length": row["max_length"]}
            found[name] = ColumnFacts(**fact)
        return found

    def distinct(self) -> dict[str, int]:
        return {c: self._rows[c]["distinct"] if c in self._rows else 0 for c in self.types}

    def modes(self) -> dict[str, str | None]:
        """Most frequent value per column as text; ties go to the smallest value."""
        order = F.struct((-F.col("count")).alias("c"), self._number.alias("n"), F.col("text").alias("t"))
        found = self.table.filter(_present()).groupBy("column").agg(F.min_by(value_text(), order).alias("mode")).collect()
        return dict.fromkeys(self.types) | {r["column"]: r["mode"] for r in found}

    def skewness(self) -> dict[str, float]:
        """Bias-corrected skewness; 0 where fewer than three values exist or none differ."""
        found = {}
        for c, (_, m2, m3) in self._spread.items():
            n = self._rows[c]["present"]
            if n >= 3:
                found[c] = m3 / n / (m2 / n) ** 1.5 * math.sqrt(n * (n - 1)) / (n - 2) if m2 > 0 else 0.0
        return found

    def quantiles(self, wanted: Mapping[str, Sequence[float]]) -> dict[str, dict[float, float | None]]:
        """Exact, linearly interpolated quantiles of numeric columns."""
        result: dict[str, dict[float, float | None]] = {c: dict.fromkeys(p) for c, p in wanted.items()}
        place = {(c, p): p * (self._rows[c]["present"] - 1) for c, shares in wanted.items() for p in shares if self._numeric(c)}
        values = self._at_ranks({(c, r) for (c, _), x in place.items() for r in (math.floor(x), math.ceil(x))})
        for (c, p), x in place.items():
            below, above = values[c, math.floor(x)], values[c, math.ceil(x)]
            result[c][p] = below if below == above else below + (above - below) * (x - math.floor(x))
        return result

    def _numeric(self, name: str) -> bool:
        return name in self._rows and self._rows[name]["sum"] is not None

    def _numbers(self, names: Sequence[str]) -> DataFrame:
        """(column, number, count); infinite numbers as the largest ones, so that ranges can be divided."""
        number = F.greatest(F.lit(-_LARGEST), F.least(F.lit(_LARGEST), self._number))
        return self.table.filter(F.col("column").isin(list(names)) & self._number.isNotNull()).select("column", number.alias("number"), "count")

    def _at_ranks(self, wanted: set[tuple[str, int]]) -> dict[tuple[str, int], float]:
        """Values at 0-based ranks of columns.

        Every round cuts the range around each rank to equal buckets, whose sizes are one small
        aggregate for all columns, and their prefix sums say in which one the rank lies.  When few
        values are left they are summed up one by one; ranges that do not shrink go to ``_sorted_ranks``.
        """
        bound = lambda x: max(-_LARGEST, min(_LARGEST, x))
        brackets = {(c, r): _Bracket(bound(self._rows[c]["low"]), bound(self._rows[c]["high"]), 0, self._rows[c]["distinct"]) for c, r in wanted}
        for _ in range(ROUNDS):
            wide = {t: b for t, b in brackets.items() if b.values > PICKED}
            if not wide:
                break
            brackets |= self._narrowed(wide)
        few = {t: b for t, b in brackets.items() if b.values <= PICKED}
        found = self._picked(few) | self._sorted_ranks(set(brackets) - set(few))
        endless = {c for c, _ in wanted if math.inf in (-self._rows[c]["low"], self._rows[c]["high"])}
        return {(c, r): math.copysign(math.inf, x) if c in endless and abs(x) == _LARGEST else x for (c, r), x in found.items()}

    def _in_brackets(self, brackets: Mapping[tuple[str, int], _Bracket]) -> tuple[DataFrame, list[tuple[str, _Bracket]]]:
        """Numbers in the brackets (bracket, low, high, ranks), and what the brackets are; targets of one bracket share it."""
        shared: dict[tuple[str, _Bracket], list[int]] = {}
        for (c, r), b in brackets.items():
            shared.setdefault((c, b), []).append(r - b.below)
        rows = [(i, c, b.low, b.high, sorted(ranks_)) for i, ((c, b), ranks_) in enumerate(shared.items())]
        table = self.table.sparkSession.createDataFrame(rows, "bracket int, column string, low double, high double, ranks array<bigint>")
        numbers = self._numbers(sorted({c for c, _ in brackets}))
        return numbers.join(F.broadcast(table), "column").filter("number between low and high"), list(shared)

    def _narrowed(self, brackets: Mapping[tuple[str, int], _Bracket]) -> dict[tuple[str, int], _Bracket]:
        """The bucket of each target as its new bracket."""
        numbers, order = self._in_brackets(brackets)
        span = F.col("high") / 2 - F.col("low") / 2
        bucket = F.when(span > 0, F.least(F.lit(BUCKETS - 1), F.floor((F.col("number") / 2 - F.col("low") / 2) / span * BUCKETS))).otherwise(0)
        sizes = numbers.groupBy("bracket", bucket.alias("bucket")).agg(
            F.sum("count").alias("held"), F.min("number").alias("lo"), F.max("number").alias("hi"), F.count(F.lit(1)).alias("values"), F.max("ranks").alias("ranks")
        )
        before = Window.partitionBy("bracket").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        placed = sizes.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0))).withColumn("rank", F.explode("ranks"))
        found = {}
        for r in placed.filter("rank >= before and rank < before + held").collect():  # one row for each target
            c, b = order[r["bracket"]]
            found[c, r["rank"] + b.below] = _Bracket(r["lo"], r["hi"], b.below + r["before"], r["values"])
        return found

    def _picked(self, brackets: Mapping[tuple[str, int], _Bracket]) -> dict[tuple[str, int], float]:
        """Targets among few values, by running sums."""
        if not brackets:
            return {}
        numbers, order = self._in_brackets(brackets)
        upto = Window.partitionBy("bracket").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
        running = numbers.withColumn("upto", F.sum("count").over(upto)).withColumn("rank", F.explode("ranks")).filter("upto > rank")
        found = {}
        for r in running.groupBy("bracket", "rank").agg(F.min("number").alias("number")).collect():
            c, b = order[r["bracket"]]
            found[c, r["rank"] + b.below] = r["number"]
        return found

    def _sorted_ranks(self, wanted: set[tuple[str, int]]) -> dict[tuple[str, int], float]:
        """Targets in whole columns: one sort by ranges for all of them, the sizes of the ranges give the ranks before each."""
        if not wanted:
            return {}
        spark, names = self.table.sparkSession, sorted({c for c, _ in wanted})
        width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(self._rows[c]["distinct"] for c in names) // VALUES_PER_TASK))
        ranged = self._numbers(names).repartitionByRange(width, "column", "number")
        placed = materialize(ranged.withColumn("part", F.spark_partition_id()), "ranges")
        sizes = placed.groupBy("column", "part").agg(F.sum("count").alias("held"))
        before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
        targets = F.broadcast(spark.createDataFrame(sorted(wanted), "column string, rank bigint"))
        chosen = sizes.join(targets, "column").filter("rank >= before and rank < before + held").select("column", "part", "before", "rank")
        # one row for each wanted rank
        upto = Window.partitionBy("column", "part").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
        running = placed.join(F.broadcast(chosen.select("column", "part").distinct()), ["column", "part"]).withColumn("upto", F.sum("count").over(upto))
        met = running.join(F.broadcast(chosen), ["column", "part"]).filter(F.col("before") + F.col("upto") > F.col("rank"))
        return {(r["column"], r["rank"]): r["number"] for r in met.groupBy("column", "rank").agg(F.min("number").alias("number")).collect()}

    def medians(self) -> dict[str, float | None]:
        return {c: q[0.5] for c, q in self.quantiles({c: [0.5] for c, f in self.facts().items() if f.numeric}).items()}

    def quartiles(self) -> dict[str, dict[float, float | None]]:
        return self.quantiles({c: [0.25, 0.5, 0.75] for c, f in self.facts().items() if f.numeric})

    # --- tables -------------------------------------------------------------------

    def levels(self) -> DataFrame:
        """(column, value, count) of every distinct present value, values as text."""
        return self.table.filter(_present()).select("column", value_text().alias("value"), "count")

    def top_values(self, k: int | None = 10) -> DataFrame:
        return lv.top_values(self.levels(), k)

    def percentile_ranks(self, column: str) -> DataFrame:
        """(column, row_count, percentile_rank) per distinct number of a column."""
        counted = self._numbers([column]).select(F.col("number").alias("value"), F.col("count").alias("row_count"))
        return ranks.ranked_levels(counted, column, self.distinct()[column])


def value_text() -> Column:
    return F.coalesce(F.col("whole").cast("string"), F.col("real").cast("string"), "text")


def summed(counts: DataFrame) -> DataFrame:
    """Counts of one row for each value again."""
    return counts.groupBy(*KEYS).agg(F.sum("count").alias("count"))


def merged_types(*several: Mapping[str, T.DataType]) -> dict[str, T.DataType]:
    """Types of all columns; numbers widen, a column that is text in one table and a number in another is refused."""
    merged: dict[str, T.DataType] = {}
    for types in several:
        for name, kind in types.items():
            old = merged.setdefault(name, kind)
            if old == kind:
                continue
            if "text" in (_field(old), _field(kind)) and _field(old) != _field(kind):
                raise ValueError(f"column {name} is {old.simpleString()} and {kind.simpleString()}")
            merged[name] = T.DoubleType() if "real" in (_field(old), _field(kind)) else T.LongType() if _field(kind) == "whole" else T.StringType()
    return merged


class CountStore:
    """Counts of a table and its increments in a folder.

    Every increment is counted once, under the id of its run: a run that is repeated replaces its
    own counts.  ``counts`` adds up the last snapshot and the increments since, ``compact`` writes
    that sum as the next snapshot.  History rows are not read.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.segments = Segments(spark, folder, f"{SCHEMA}, types string")

    def add(self, df: DataFrame, run: str) -> None:
        """Count an increment; its column types lie beside its counts."""
        df = cols.nan_to_null(df)
        marker = self.spark.createDataFrame([(df.schema.json(),)], "types string").select(*[F.lit(None).alias(c) for c in (*KEYS, "count")], "types")
        self.segments.append(count_cells(df, df.columns).withColumn("types", F.lit(None).cast("string")).unionByName(marker), run)

    def _merged(self, rows: DataFrame) -> DataFrame:
        kept = summed(rows.filter("types is null").select(*KEYS, "count")).withColumn("types", F.lit(None).cast("string"))
        kinds = rows.filter("types is not null").select(*KEYS, "count", "types").distinct()
        return kept.unionByName(kinds)

    def compact(self) -> None:
        self.segments.compact(self._merged)

    def counts(self) -> Counts:
        rows = self.segments.load()
        schemas = [T.StructType.fromJson(json.loads(r["types"])) for r in rows.filter("types is not null").select("types").distinct().orderBy("types").collect()]
        types = merged_types(*({f.name: f.dataType for f in s} for s in schemas))
        return Counts(materialize(summed(rows.filter("types is null").select(*KEYS, "count")), "counts"), types)
