"""Per-column facts from one scan, and exact quantiles that never hold a whole column.

Facts are a handful of numbers per column, so they return to the driver and become
literals of later plans.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window, functions as F

from tablemeld import columns as cols

#: Distinct values up to which one aggregation buffer may hold a whole value -> count map.
MAX_LEVELS = 200_000
#: Accuracy of the approximate quantiles that bracket an exact one.
BRACKET_ACCURACY = 2_000
#: Sketches in one aggregation buffer.
SKETCHES_PER_JOB = 50


@dataclass(frozen=True)
class ColumnFacts:
    column: str
    kind: str
    rows: int
    present: int
    mean: float | None = None
    std: float | None = None
    low: float | None = None
    high: float | None = None
    avg_length: float | None = None
    min_length: int | None = None
    max_length: int | None = None

    @property
    def missing(self) -> int:
        return self.rows - self.present

    @property
    def missing_pct(self) -> float:
        return 100.0 * self.missing / self.rows if self.rows else 0.0

    @property
    def numeric(self) -> bool:
        return self.kind in ("integer", "float")


def fit_facts(df: DataFrame, names: Iterable[str] | None = None) -> dict[str, ColumnFacts]:
    """Counts, moments and text lengths in one scan, all inside generated code."""
    df = cols.nan_to_null(df)
    names = list(df.columns if names is None else names)
    facts: dict[str, ColumnFacts] = {}
    for group in cols.batches(names, cols.EXPRESSIONS_PER_JOB // 8):
        wanted = [F.count(F.lit(1)).alias("rows")]
        for i, name in enumerate(group):
            wanted += [e.alias(f"{i}_{k}") for k, e in _fact_expressions(df, name).items()]
        row = df.agg(*wanted).first()
        for i, name in enumerate(group):
            values = {
                k: row[f"{i}_{k}"] for k in _fact_expressions(df, name)
            }
            facts[name] = ColumnFacts(
                column=name,
                kind=cols.base_type(cols.type_of(df, name)),
                rows=row["rows"],
                **values,
            )
    return facts


def _fact_expressions(df: DataFrame, name: str) -> dict:
    column = cols.ref(name)
    kind = cols.base_type(cols.type_of(df, name))
    found = {"present": F.count(column)}
    if kind in ("integer", "float"):
        number = column.cast("double")
        found |= {
            "mean": F.avg(number),
            "std": F.stddev_samp(number),
            "low": F.min(column).cast("double"),
            "high": F.max(column).cast("double"),
        }
    elif kind == "string":
        size = F.length(column)
        found |= {
            "avg_length": F.avg(size),
            "min_length": F.min(size),
            "max_length": F.max(size),
        }
    return found


def approximate_levels(df: DataFrame, names: Iterable[str]) -> dict[str, int]:
    """Distinct values per column from fixed-size sketches."""
    df, found = cols.nan_to_null(df), {}
    for group in cols.batches(list(names), cols.EXPRESSIONS_PER_JOB):
        row = df.agg(
            *[F.approx_count_distinct(cols.ref(c)).alias(str(i)) for i, c in enumerate(group)]
        ).first()
        found |= {c: row[i] for i, c in enumerate(group)}
    return found


def fit_skewness(df: DataFrame, facts: Mapping[str, ColumnFacts], names: Iterable[str]) -> dict[str, float]:
    """Bias-corrected skewness; 0 where fewer than three values exist or none differ."""
    df = cols.nan_to_null(df)
    names = [c for c in names if facts[c].numeric and facts[c].present >= 3]
    found = dict.fromkeys(names, 0.0)
    for group in cols.batches(names, cols.EXPRESSIONS_PER_JOB):
        row = df.agg(
            *[F.skewness(cols.as_double(df, c)).alias(str(i)) for i, c in enumerate(group)]
        ).first()
        for i, c in enumerate(group):
            n = facts[c].present
            if row[i] is not None and not math.isnan(row[i]):
                found[c] = row[i] * math.sqrt(n * (n - 1)) / (n - 2)
    return found


def exact_quantiles(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    facts: Mapping[str, ColumnFacts],
    max_levels: int = MAX_LEVELS,
) -> dict[str, dict[float, float | None]]:
    """Exact, linearly interpolated quantiles.

    Columns with few levels are counted by value and weighted by the built-in
    ``percentile`` (its buffer holds one entry per level).  For the others an approximate quantile brackets the wanted
    rank, a count places the bracket exactly, and the bracket is narrowed until the
    levels inside it fit one buffer.
    """
    df = cols.nan_to_null(df)
    result: dict[str, dict[float, float | None]] = {
        c: dict.fromkeys(probabilities) for c, probabilities in wanted.items()
    }
    filled = [c for c, probabilities in wanted.items() if probabilities and facts[c].present]
    long = [c for c in filled if facts[c].present > max_levels]
    levels = approximate_levels(df, long)
    many = [c for c in long if levels[c] > max_levels]
    few = [c for c in filled if c not in many]
    if few:
        shares = sorted({float(p) for c in few for p in wanted[c]})
        counted = cols.to_long(df, few, cols.as_double).groupBy("column", "value").agg(
            F.count(F.lit(1)).alias("count")
        )
        quantiles = F.percentile("value", F.array(*map(F.lit, shares)), F.col("count"))
        for row in counted.groupBy("column").agg(quantiles.alias("quantiles")).collect():
            at = dict(zip(shares, row["quantiles"]))
            result[row["column"]] = {p: at[float(p)] for p in wanted[row["column"]]}
    if many:
        ranks = {}
        for c in many:
            last = facts[c].present - 1
            for p in wanted[c]:
                ranks[c, math.floor(p * last)] = None
                ranks[c, math.ceil(p * last)] = None
        values = _order_statistics(df, list(ranks), {c: facts[c].present for c in many}, max_levels)
        for c in many:
            last = facts[c].present - 1
            for p in wanted[c]:
                below, above = values[c, math.floor(p * last)], values[c, math.ceil(p * last)]
                share = p * last - math.floor(p * last)
                result[c][p] = below if share == 0 else below + (above - below) * share
    return result


@dataclass(frozen=True)
class _Bracket:
    """Bounds that hold a wanted rank, the rows below them and the rows inside."""

    low: float
    high: float
    below: int
    inside: int
    #: The last round cut less than half of the rows: the next one halves the range of numbers.
    stalled: bool = False


def _order_statistics(
    df: DataFrame, targets: list[tuple[str, int]], sizes: Mapping[str, int], max_levels: int
) -> dict[tuple[str, int], float]:
    """Values at 0-based ranks of a column, by exact counting inside narrowing brackets.

    A round is an aggregate of approximate bounds and one of exact counts, for a bounded
    number of targets at a time.  A rank outside of the bounds leaves the rest of the
    bracket, so every round narrows it.  In a bracket of at most ``BRACKET_ACCURACY`` rows
    the sketch is exact, and a bracket that keeps most of its rows is halved by its numbers.
    """
    found: dict[tuple[str, int], float] = {}
    final: dict[tuple[str, int], _Bracket] = {}
    state = {t: _Bracket(-math.inf, math.inf, 0, sizes[t[0]]) for t in targets}
    while state:
        bounds = _bounds(df, state)
        counts = _count_brackets(df, bounds)
        for t, (low, high) in bounds.items():
            old, (below, inside) = state[t], counts[t]
            if t[1] < below:
                new = _Bracket(old.low, math.nextafter(low, -math.inf), old.below, below - old.below)
            elif t[1] >= below + inside:
                up = below + inside
                new = _Bracket(math.nextafter(high, math.inf), old.high, up, old.below + old.inside - up)
            else:
                new = _Bracket(low, high, below, inside)
            state[t] = replace(new, stalled=2 * new.inside > old.inside)
        crowded = {t: (b.low, b.high) for t, b in state.items() if b.inside > max_levels and b.low < b.high}
        levels = _count_levels(df, crowded)
        for t, b in list(state.items()):
            if b.low == b.high:
                found[t] = b.low
                del state[t]
            elif b.inside <= max_levels or levels[t] <= max_levels:
                final[t] = state.pop(t)
    return found | _pick(df, final)


def _ordered(x: float) -> int:
    """Doubles as integers in the same order."""
    bits = struct.unpack("<q", struct.pack("<d", x))[0]
    return bits if bits >= 0 else -(bits & 0x7FFFFFFFFFFFFFFF)


def _from_ordered(n: int) -> float:
    return struct.unpack("<d", struct.pack("<q", n if n >= 0 else -n - (1 << 63)))[0]


def _bounds(
    df: DataFrame, state: Mapping[tuple[str, int], _Bracket]
) -> dict[tuple[str, int], tuple[float, float]]:
    """Bounds around each rank inside its bracket; targets that share a bracket share one sketch."""
    found, shared = {}, {}
    for t, b in state.items():
        if b.stalled and b.inside > BRACKET_ACCURACY:
            found[t] = (b.low, _from_ordered((_ordered(b.low) + _ordered(b.high)) // 2))
        else:
            shared.setdefault((t[0], b), []).append(t)
    for group in cols.batches(list(shared.items()), SKETCHES_PER_JOB):
        wanted = []
        for i, ((name, b), members) in enumerate(group):
            margin = 0.0 if b.inside <= BRACKET_ACCURACY else 2.0 / BRACKET_ACCURACY
            shares = []
            for t in members:
                position = (t[1] - b.below + 0.5) / b.inside
                shares += [max(0.0, position - margin), min(1.0, position + margin)]
            value = _inside(df, name, b.low, b.high)
            wanted.append(F.percentile_approx(value, shares, BRACKET_ACCURACY).alias(str(i)))
        row = df.agg(*wanted).first()
        for i, (_, members) in enumerate(group):
            found |= {t: (row[i][2 * j], row[i][2 * j + 1]) for j, t in enumerate(members)}
    return found


def _count_brackets(
    df: DataFrame, bounds: Mapping[tuple[str, int], tuple[float, float]]
) -> dict[tuple[str, int], tuple[int, int]]:
    """Exact (rows below, rows inside) of each bracket."""
    found = {}
    for group in cols.batches(list(bounds.items()), cols.EXPRESSIONS_PER_JOB // 2):
        wanted = []
        for i, (t, (low, high)) in enumerate(group):
            value = cols.as_double(df, t[0])
            wanted += [
                F.count(F.when(value < low, 1)).alias(f"{i}_below"),
                F.count(F.when(value.between(low, high), 1)).alias(f"{i}_inside"),
            ]
        row = df.agg(*wanted).first()
        found |= {t: (row[f"{i}_below"], row[f"{i}_inside"]) for i, (t, _) in enumerate(group)}
    return found


def _count_levels(
    df: DataFrame, bounds: Mapping[tuple[str, int], tuple[float, float]]
) -> dict[tuple[str, int], int]:
    """Approximate distinct values inside each bracket."""
    found = {}
    for group in cols.batches(list(bounds.items()), SKETCHES_PER_JOB):
        row = df.agg(
            *[
                F.approx_count_distinct(_inside(df, t[0], low, high)).alias(str(i))
                for i, (t, (low, high)) in enumerate(group)
            ]
        ).first()
        found |= {t: row[i] for i, (t, _) in enumerate(group)}
    return found


def _inside(df: DataFrame, name: str, low: float, high: float):
    value = cols.as_double(df, name)
    return F.when(value.between(low, high), value)


def _pick(df: DataFrame, brackets: Mapping[tuple[str, int], _Bracket]) -> dict[tuple[str, int], float]:
    """The values at the wanted ranks, by running sums over the few levels inside their brackets."""
    found = {}
    for group in cols.batches(list(brackets.items()), SKETCHES_PER_JOB):
        cells = F.array(
            *[
                F.struct(
                    F.lit(i).alias("target"), F.lit(t[1] - b.below).alias("rank"),
                    _inside(df, t[0], b.low, b.high).alias("value"),
                )
                for i, (t, b) in enumerate(group)
            ]
        )
        levels = (
            df.select(F.inline(F.filter(cells, lambda c: c["value"].isNotNull())))
            .groupBy("target", "rank", "value").agg(F.count(F.lit(1)).alias("rows"))
        )
        upto = Window.partitionBy("target").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        picked = levels.withColumn("upto", F.sum("rows").over(upto)).where("upto > rank")
        for row in picked.groupBy("target").agg(F.min("value").alias("value")).collect():
            found[group[row["target"]][0]] = row["value"]
    return found


def medians(
    df: DataFrame, facts: Mapping[str, ColumnFacts], names: Iterable[str] | None = None
) -> dict[str, float | None]:
    names = [c for c in (facts if names is None else names) if facts[c].numeric]
    found = exact_quantiles(df, {c: [0.5] for c in names}, facts)
    return {c: found[c][0.5] for c in names}
