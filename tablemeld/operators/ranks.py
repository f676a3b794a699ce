"""Percentile ranks (average rank of ties over the number of values) at any size.

A rank needs the number of smaller values.  Values are counted first, so ties
collapse; when the distinct values are many they are cut into buckets of bounded
size, the bucket totals give offsets, and a running sum inside each bucket does the
rest.  Rows meet their rank through a lookup join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablemeld.columns import ref
from tablemeld.operators.joins import lookup_join
from tablemeld.storage import materialize

#: Distinct values that one task may sort.
LEVELS_PER_TASK = 500_000
#: Most bucket edges taken at once.
MAX_BUCKETS = 10_000


def percentile_ranks(df: DataFrame, column: str, levels_per_task: int = LEVELS_PER_TASK) -> DataFrame:
    """(value column, row_count, percentile_rank) per distinct non-null value."""
    value = ref(column)
    counted = (
        df.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("row_count"))
    )
    distinct = df.agg(F.approx_count_distinct(value)).first()[0]
    return ranked_levels(counted, column, distinct, levels_per_task)


def ranked_levels(counted: DataFrame, column: str, distinct: int, levels_per_task: int = LEVELS_PER_TASK) -> DataFrame:
    """The same from (value, row_count) of about ``distinct`` values."""
    if distinct <= levels_per_task:
        ordered = counted.withColumn("bucket", F.lit(0))
    else:
        counted = materialize(counted, "levels")
        ordered = counted.withColumn("bucket", _bucket_of(counted, distinct, levels_per_task))
    totals = ordered.groupBy("bucket").agg(F.sum("row_count").alias("bucket_rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    offsets = totals.select(
        "bucket",
        F.coalesce(F.sum("bucket_rows").over(before), F.lit(0)).alias("offset"),
        F.sum("bucket_rows").over(everything).alias("total"),
    )
    inside = Window.partitionBy("bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum("row_count").over(inside) + F.col("offset")
    return (
        ordered.join(F.broadcast(offsets), "bucket")
        .withColumn("percentile_rank", (running - (F.col("row_count") - 1) / 2) / F.col("total"))
        .select(F.col("value").alias(column), "row_count", "percentile_rank")
    )


def _bucket_of(counted: DataFrame, distinct: int, levels_per_task: int) -> Column:
    """Bucket number of a value, from edges that split the distinct values evenly."""
    buckets = min(MAX_BUCKETS, distinct // levels_per_task + 2)
    shares = [i / buckets for i in range(1, buckets)]
    edges = np.unique(
        counted.agg(F.percentile_approx(F.col("value").cast("double"), shares, 10 * MAX_BUCKETS)).first()[0]
    )

    return _count_at_most(F.col("value").cast("double"), edges.tolist())


def _count_at_most(value: Column, edges: Sequence[float]) -> Column:
    """How many of the sorted edges are at most the value, by halving."""
    if not edges:
        return F.lit(0)
    listed = F.array(*map(F.lit, edges))
    start = F.struct(F.lit(0).alias("low"), F.lit(len(edges)).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        up = F.get(listed, middle) <= value
        return F.when(s["low"] >= s["high"], s).when(
            up, F.struct((middle + 1).alias("low"), s["high"].alias("high"))
        ).otherwise(F.struct(s["low"].alias("low"), middle.alias("high")))

    steps = F.sequence(F.lit(1), F.lit(len(edges).bit_length() + 1))
    return F.aggregate(steps, start, halve, lambda s: s["low"])


def with_percentile_rank(df: DataFrame, column: str, name: str = "percentile_rank") -> DataFrame:
    """The table with each value's percentile rank; nulls have none."""
    ranks = percentile_ranks(df, column)
    return lookup_join(df, ranks, [column], weight="row_count").drop("row_count").withColumnRenamed(
        "percentile_rank", name
    )


#: Edges that stand in for values which the fitted table did not have.
FROZEN_EDGES = 1_000


@dataclass(frozen=True)
class FrozenRanks:
    """Ranks of a fitted column: every value with its rank, and edges for values it lacked."""

    ranks: DataFrame
    edges: tuple[float, ...]
    shares: tuple[float, ...]


def freeze_ranks(df: DataFrame, column: str) -> FrozenRanks:
    """Percentile ranks of a column, written to the shared folder; at most ``FROZEN_EDGES`` edges return."""
    ranks = materialize(percentile_ranks(df, column), "ranks")
    group = F.floor(F.col("percentile_rank") * FROZEN_EDGES)
    # a value's rank plus half of its rows: the share of rows that are not above it
    sums = ranks.agg(F.sum("row_count").alias("n")).first()["n"] or 1
    upto = F.col("percentile_rank") + (F.col("row_count") - 1) / 2 / sums
    rows = ranks.groupBy(group.alias("g")).agg(F.max(ref(column).cast("double")).alias("edge"), F.max(upto).alias("share")).collect()
    rows = sorted((r["edge"], r["share"]) for r in rows)
    return FrozenRanks(ranks, tuple(e for e, _ in rows), tuple(s for _, s in rows))


def with_frozen_rank(df: DataFrame, column: str, frozen: FrozenRanks, name: str = "percentile_rank") -> DataFrame:
    """The table with the rank that each value has in the fitted table.

    A value the fitted table lacked gets the share of fitted rows up to the edge below it.
    """
    known = lookup_join(df, frozen.ranks, [column], weight="row_count").drop("row_count")
    below = _count_at_most(ref(column).cast("double"), frozen.edges)
    share = F.coalesce(F.get(F.array(*map(F.lit, frozen.shares)), below - 1), F.lit(0.0)) if frozen.edges else F.lit(0.0)
    rank = F.when(ref(column).isNotNull(), F.coalesce("percentile_rank", share))
    return known.withColumn("percentile_rank", rank).withColumnRenamed("percentile_rank", name)
