"""Comparison of two tables without keys and without an order of rows.

Rows that both tables hold are cancelled by 128-bit prints, which are all that is shuffled for
them.  Of what is left, rows are paired that agree in all but a few cells: a row's print without
some columns is an inverted list of the rows that agree in all others, and the rows of the two
tables in one list are paired off by their place in it, never crossed.  Sets of columns are taken in
turn, the fewest and first columns before others: a count says which lists have rows of both tables,
and only their rows are shuffled.  A set is done when it is passed, so no round is repeated.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablemeld import columns as cols
from tablemeld.operators.joins import lookup_join
from tablemeld.storage import materialize

#: Rows of a list whose places one task gives out; larger lists are numbered in parts.
ROWS_PER_TASK = 500_000
#: Sets of columns whose lists are counted in one job.
SUBSETS_AT_ONCE = 32
_ID, _LIST = ["p1", "p2"], ["k1", "k2"]


def _printed(df: DataFrame, names: list[str]) -> DataFrame:
    """The common columns, the hashes of their cells (two of 64 bits for each) and the print of the row."""
    texts = [cols.as_text(df, c).alias(f"t{i}") for i, c in enumerate(names)]
    cell = lambda i, seed: F.xxhash64(F.lit(seed), F.lit(i), F.coalesce(f"t{i}", F.lit("")), F.col(f"t{i}").isNull()).alias(f"c{seed}_{i}")
    hashed = df.select(F.struct(*map(cols.ref, names)).alias("row"), *texts).select("row", *[cell(i, seed) for seed in (1, 2) for i in range(len(names))])
    lane = lambda seed: [F.col(f"c{seed}_{i}") for i in range(len(names))]
    lanes = [F.array(*lane(seed)).alias(f"h{seed}") for seed in (1, 2)]
    return hashed.select("row", *lanes, *[reduce(Column.bitwiseXOR, lane(seed), F.lit(0).cast("long")).alias(f"p{seed}") for seed in (1, 2)])


def _left_over(printed: DataFrame, left: DataFrame, sign: int) -> DataFrame:
    """Rows of one table that the other does not cancel: (p1, p2, copy, h1, h2, row)."""
    mine = left.where(F.col("balance") * sign > 0)
    met = lookup_join(printed, mine, _ID).where("balance is not null")
    one = met.groupBy(*_ID).agg(F.first(F.struct("h1", "h2", "row")).alias("one"), F.abs(F.max("balance")).alias("copies"))
    return one.select(*_ID, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"), "one.*")


def _keyed(open_: DataFrame, subsets: dict[int, tuple[int, ...]]) -> DataFrame:
    """(side, id, subset, k1, k2): the lists of every row, its print without the columns of each subset."""
    without = lambda seed, s: reduce(Column.bitwiseXOR, [F.get(f"h{seed}", F.lit(i)) for i in s], F.col(f"p{seed}")).alias(f"k{seed}")
    lists = F.array(*[F.struct(F.lit(i).alias("subset"), without(1, s), without(2, s)) for i, s in subsets.items()])
    return open_.select("side", F.struct(*_ID, "copy").alias("id"), F.inline(lists))


def _met(open_: DataFrame, subsets: dict[int, tuple[int, ...]]) -> DataFrame:
    """(subset, k1, k2, n): lists that have rows of both tables, with their rows."""
    of = lambda side: F.sum((F.col("side") == side).cast("long"))
    lists = _keyed(open_, subsets).groupBy("subset", "k1", "k2").agg(of(1).alias("gone"), of(-1).alias("come"))
    return lists.where("gone > 0 and come > 0").select("subset", "k1", "k2", (F.col("gone") + F.col("come")).alias("n"))


def _placed(rows: DataFrame, largest: int) -> DataFrame:
    """Rows (side, id, k1, k2, n) with their place in the list's rows of their table.

    A list of more than ``ROWS_PER_TASK`` rows is numbered in parts, by hash, with the sizes of the parts before as offsets.
    """
    ranked = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy("id"))
    if largest <= ROWS_PER_TASK:
        return rows.repartition(F.col("k1"), F.col("k2")).withColumn("place", ranked(*_LIST, "side"))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / ROWS_PER_TASK)).alias("part")
    rows = materialize(rows.select("*", part), "lists")
    key = [*_LIST, "side"]
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.where(F.col("n") > ROWS_PER_TASK).groupBy(*key, "part").agg(F.count(F.lit(1)).alias("held"))
    offsets = materialize(parts.select(*key, "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset")), "offsets")
    numbered = lookup_join(rows.withColumn("place", ranked(*key, "part")), offsets, [*key, "part"])
    return numbered.withColumn("place", F.col("place") + F.coalesce("offset", F.lit(0))).drop("part", "offset")


def _pairs_of(rows: DataFrame, largest: int, subset: int) -> DataFrame:
    """(subset, before, after): rows of the two tables with one place in one list."""
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("id")))
    pairs = _placed(rows, largest).groupBy(*_LIST, "place").agg(of(1).alias("before"), of(-1).alias("after"))
    return pairs.where("before is not null and after is not null").select(F.lit(subset).alias("subset"), "before", "after")


def _paired(open_: DataFrame, subsets: list[tuple[int, ...]]) -> tuple[DataFrame | None, DataFrame]:
    """Pairs (subset, before, after) and the rows that have no partner.

    Subsets are taken in turn, the smallest first: each pairs off all its lists, so none is met twice.
    """
    pairs = []
    numbered = list(enumerate(subsets))
    starts = [k for k in range(len(subsets)) if k == 0 or len(subsets[k]) > len(subsets[k - 1])]
    for start, stop in zip(starts, [*starts[1:], len(subsets)], strict=True):
        for at in range(start, stop, SUBSETS_AT_ONCE):
            some = dict(numbered[at:min(stop, at + SUBSETS_AT_ONCE)])
            met = materialize(_met(open_, some), "met")
            largest = {r["subset"]: r["n"] for r in met.groupBy("subset").agg(F.max("n").alias("n")).collect()}
            taken = None
            for subset in sorted(largest):
                lists = met.where(F.col("subset") == subset).select(*_LIST, "n")
                keyed = _keyed(open_, {subset: some[subset]}).select("side", "id", *_LIST)
                rows = lookup_join(keyed, lists, _LIST, weight="n").where("n is not null")
                if taken is not None:
                    rows = rows.join(taken, ["side", "id"], "left_anti")
                found = materialize(_pairs_of(rows, largest[subset], subset), "pairs")
                pairs.append(found)
                both = found.select(F.lit(1).alias("side"), F.col("before").alias("id")).unionByName(found.select(F.lit(-1).alias("side"), F.col("after").alias("id")))
                taken = both if taken is None else taken.unionByName(both)
            if taken is not None:
                gone = taken.select("side", "id.*")
                open_ = materialize(open_.join(gone, ["side", *_ID, "copy"], "left_anti"), "open")
    return (cols.union_by_name(pairs) if pairs else None), open_


def row_changes(before: DataFrame, after: DataFrame, most_changed: int = 2) -> DataFrame:
    """(change, columns, before, after): rows changed, removed and added, each copy a row.

    Rows are compared in the columns that both tables have, as text.  A changed row agrees with its
    partner in all but at most ``most_changed`` columns, which ``columns`` names; a row without a partner
    is removed or added, whatever its cells.  Equal rows are interchangeable.
    """
    names = [c for c in before.columns if c in after.columns]
    if not 0 <= most_changed < max(1, len(names)):
        raise ValueError("rows must agree in one column at least")
    old, new = (_printed(cols.nan_to_null(df).select(*map(cols.ref, names)), names) for df in (before, after))
    both = old.select(*_ID, F.lit(1).alias("n")).unionByName(new.select(*_ID, F.lit(-1).alias("n")))
    left = materialize(both.groupBy(*_ID).agg(F.sum("n").alias("balance")).where("balance <> 0"), "left")
    gone, come = materialize(_left_over(old, left, 1), "gone"), materialize(_left_over(new, left, -1), "come")
    fields = ["p1", "p2", "copy", "h1", "h2"]
    open_ = gone.select(F.lit(1).alias("side"), *fields).unionByName(come.select(F.lit(-1).alias("side"), *fields))
    subsets = [s for size in range(1, most_changed + 1) for s in combinations(range(len(names)), size)]
    pairs, alone = _paired(materialize(open_, "open"), subsets) if subsets else (None, open_)
    content = lambda df, name: df.select(F.struct(*_ID, "copy").alias(f"{name}_id"), F.col("row").alias(name))
    listed, no_columns = F.array(*map(F.lit, names)), F.array().cast("array<string>")
    only = lambda side: alone.where(F.col("side") == side).select(*_ID, "copy")
    none = lambda df, name: F.lit(None).cast(df.schema["row"].dataType).alias(name)
    parts = [
        gone.join(only(1), [*_ID, "copy"]).select(F.lit("removed").alias("change"), no_columns.alias("columns"), F.col("row").alias("before"), none(come, "after")),
        come.join(only(-1), [*_ID, "copy"]).select(F.lit("added").alias("change"), no_columns.alias("columns"), none(gone, "before"), F.col("row").alias("after")),
    ]
    if pairs is not None:
        numbers = F.get(F.array(*[F.array(*map(F.lit, s)) for s in subsets]), F.col("subset"))
        named = pairs.select(F.transform(numbers, lambda i: F.get(listed, i)).alias("columns"), F.col("before").alias("before_id"), F.col("after").alias("after_id"))
        parts.append(named.join(content(gone, "before"), "before_id").join(content(come, "after"), "after_id").select(F.lit("changed").alias("change"), "columns", "before", "after"))
    return reduce(DataFrame.unionByName, parts)


def change_counts(changes: DataFrame) -> DataFrame:
    """(change, column, rows): rows removed and added, and changed rows for each column that changed."""
    return changes.select("change", F.explode_outer("columns").alias("column")).groupBy("change", "column").agg(F.count(F.lit(1)).alias("rows"))
