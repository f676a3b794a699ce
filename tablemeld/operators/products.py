"""Correlations of very many columns from masked cross products, in one scan of the table.

For columns i and j over the rows where both are present, six sums are enough: rows, the sums and
squared sums of either, and the products.  With gaps as zeros and a mask of what is present, all
of them are matrix products of a batch of rows.  Tasks add up one set of matrices for each pair of
column blocks, and the sets are summed as a tree, so that no task gathers those of all others.

Numbers are taken less one value of their column, found in a bounded sample of rows: that decides
how many digits cancel, not what is computed.  Nulls, NaN and infinite values count as missing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablemeld import columns as cols
from tablemeld.session import importable
from tablemeld.storage import materialize

#: Columns of a block, sets of matrices that a task sums, and rows that are looked at for the values to subtract.
BLOCK, FAN_IN, SAMPLE = 128, 64, 1_000
#: Columns whose matrices one task holds (about 24 bytes for each of their pairs); wider tables take a scan for each pair of such groups.
GROUP = 2_048
#: Share of a sum of squares below which what is left of it is rounding.
ROUNDING = 1e-13

_SETS = "i int, j int, part int, data binary"


def _middle_values(df: DataFrame) -> np.ndarray:
    """One present value of every column, in the middle of a few rows; 0 where they have none."""
    rows = np.array([[np.nan if x is None else x for x in r] for r in df.limit(SAMPLE).collect()], float).reshape(-1, len(df.columns))
    found = np.zeros(rows.shape[1])
    for c in range(rows.shape[1]):
        values = np.sort(rows[np.isfinite(rows[:, c]), c])
        if len(values):
            found[c] = values[len(values) // 2]
    return found


def _matrix(batch: pa.RecordBatch, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values less the middle ones, zero where missing, and the mask of what is present."""
    x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(batch.num_columns)]).astype(float)
    mask = np.isfinite(x)
    return np.where(mask, x - middle, 0.0), mask.astype(float)


def _block_pairs(count: int, left: range, right: range) -> list[tuple[int, int]]:
    """Pairs of blocks with a column of either group in order."""
    blocks = lambda span: range(span.start // BLOCK, -(-min(span.stop, count) // BLOCK))
    return [(i, j) for i in blocks(left) for j in blocks(right) if i <= j]


def _sums(df: DataFrame, pairs: Sequence[tuple[int, int]], middle: np.ndarray) -> DataFrame:
    """(i, j, part, data): the six matrices of each pair of blocks from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x, m = _matrix(batch, middle)
            xx = x * x
            for i, j in pairs:
                a, b = slice(i * BLOCK, (i + 1) * BLOCK), slice(j * BLOCK, (j + 1) * BLOCK)
                found = np.stack([m[:, a].T @ m[:, b], x[:, a].T @ m[:, b], m[:, a].T @ x[:, b], xx[:, a].T @ m[:, b], m[:, a].T @ xx[:, b], x[:, a].T @ x[:, b]])
                total[i, j] = total[i, j] + found if (i, j) in total else found
        part = TaskContext.get().partitionId()
        for (i, j), sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([part], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["i", "j", "part", "data"])

    return df.mapInArrow(run, _SETS)


def _added(sets: pd.DataFrame) -> pd.DataFrame:
    total = np.frombuffer(sets["data"].iloc[0]).copy()
    for data in sets["data"].iloc[1:]:
        total += np.frombuffer(data)
    return pd.DataFrame({"i": sets["i"].iloc[:1], "j": sets["j"].iloc[:1], "part": sets["part"].iloc[:1] // FAN_IN, "data": [total.tobytes()]})


def _tree_summed(sets: DataFrame) -> DataFrame:
    """One set of matrices for each pair of blocks."""
    sets = materialize(sets, "products")
    left = (sets.agg(F.max("part")).first()[0] or 0) + 1
    while left > 1:
        sets = sets.groupBy("i", "j", F.floor(F.col("part") / FAN_IN).alias("group")).applyInPandas(lambda key, rows: _added(rows), _SETS)
        left = -(-left // FAN_IN)
    return sets


def _correlated(names: Sequence[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                a, b = names[r.i * BLOCK:(r.i + 1) * BLOCK], names[r.j * BLOCK:(r.j + 1) * BLOCK]
                n, x, y, xx, yy, xy = np.frombuffer(r.data).reshape(6, len(a), len(b))
                with np.errstate(invalid="ignore", divide="ignore"):
                    vx, vy = xx - x * x / n, yy - y * y / n
                    vx, vy = np.where(vx > ROUNDING * xx, vx, 0.0), np.where(vy > ROUNDING * yy, vy, 0.0)
                    found = np.clip((xy - x * y / n) / np.sqrt(vx * vy), -1, 1)
                ok = np.isfinite(found) & ((r.i < r.j) | (np.arange(len(a))[:, None] < np.arange(len(b))[None, :]))
                i, j = np.nonzero(ok)
                yield pd.DataFrame({"column_a": np.array(a, object)[i], "column_b": np.array(b, object)[j], "correlation": found[ok]})

    return run


def correlation_pairs(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column_a, column_b, correlation) of all pairs of numeric columns that have one, over the rows where both are present."""
    importable(df.sparkSession)
    names = list(names)
    wide = df.select(*[cols.as_double(df, c).alias(f"c{k}") for k, c in enumerate(names)])
    middle, groups = _middle_values(wide), [range(at, at + GROUP) for at in range(0, len(names), GROUP)]
    parts = []
    for k, left in enumerate(groups):
        for right in groups[k:]:
            summed = _tree_summed(_sums(wide, _block_pairs(len(names), left, right), middle))
            parts.append(summed.select("i", "j", "data").mapInPandas(_correlated(names), "column_a string, column_b string, correlation double"))
    return cols.union_by_name(parts)
