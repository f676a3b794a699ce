"""Arrow batches cut by the size of their texts, and the columns that an operator keeps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Bytes of text that a step works on at a time; a longer text is worked on alone.
STEP = 2 << 20


def plain_strings(values: pa.Array) -> pa.Array:
    """Strings with 32-bit offsets, null as empty."""
    return pc.fill_null(values.cast(pa.string()), "")


def steps(batch: pa.RecordBatch, column: int, size: int = STEP) -> Iterator[pa.RecordBatch]:
    """Slices of a batch in order, each with at most ``size`` bytes in one text or binary column, or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def kept_columns(df: DataFrame, replaced: list[str]) -> list[str]:
    """Columns of a frame but those named like one of ``replaced`` (compared without case)."""
    gone = {c.lower() for c in replaced}
    return [c for c in df.columns if c.lower() not in gone]


def with_inputs(df: DataFrame, kept: list[str], inputs: dict[str, Column]) -> DataFrame:
    """The kept columns, then inputs of an Arrow function under names that need not be free."""
    return df.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(f"input {n}") for n, c in inputs.items()])


def schema_of(df: DataFrame, kept: int, made: dict[str, str]) -> str:
    """Schema text of the first ``kept`` columns and the made ones."""
    fields = [*((f.name, f.dataType.simpleString()) for f in df.schema.fields[:kept]), *made.items()]
    return ", ".join(f"`{n}` {t}" for n, t in fields)
