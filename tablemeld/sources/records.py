"""CSV records with line breaks in quotes, read by many tasks from one file.

A line ends a record if the number of quotes from the start of the file to its end is even, and a
doubled quote counts as two.  So a split only needs the parity of the quotes before it: one
aggregate counts them for each split, sums over the splits of a file give the parity at its start,
and each task joins the lines of its split to records.  What is left at either end of a split, the
parts of a record that splits cut, are few rows, which meet in a group of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablemeld.operators.joins import lookup_join
from tablemeld.session import importable
from tablemeld.storage import materialize

_SPLIT = ["file_path", "start"]


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    meta = F.col("_metadata")
    text = spark.read.text(path, lineSep="\n")
    return text.select("value", *[meta[c].alias(c) for c in ("file_path", "file_name", "file_size")], meta["file_block_start"].alias("start"))


def _parities(lines: DataFrame) -> DataFrame:
    """(file_path, start, odd, cut): whether a split starts within quotes, and whether a record crosses either end."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.groupBy(*_SPLIT).agg((F.sum(quotes) % 2).alias("quotes"))
    before = Window.partitionBy("file_path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    return counted.select(*_SPLIT, odd.cast("int").alias("odd"), ((odd == 1) | ((odd + F.col("quotes")) % 2 == 1)).alias("cut"))


def _joined(lines: pa.Array, odd: int) -> tuple[pa.Array, pa.Array, int]:
    """Whole records of lines, the lines after the last of them, and the parity there."""
    quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
    parity = (odd + np.cumsum(quotes)) % 2
    ends = np.flatnonzero(parity == 0) + 1
    cut = int(ends[-1]) if len(ends) else 0
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), lines.slice(0, cut))
    return pc.binary_join(lists, "\n"), lines.slice(cut), int(parity[-1]) if len(parity) else odd


def _regroup(fragments: bool):
    """Records of each split; with ``fragments`` instead what is left of records at its ends, in order."""
    names = ["file_path", "file_name", "file_size", "start", "place", "record"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, rest, odd, inside, place = None, [], 0, False, 0

        def rows(records: pa.Array, first: int) -> pa.RecordBatch:
            n = len(records)
            same = [pa.array([v] * n, t) for v, t in zip(split, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)]
            return pa.RecordBatch.from_arrays([*same, pa.array(range(first, first + n), pa.int64()), records.cast(pa.string())], names=names)

        def left() -> Iterator[pa.RecordBatch]:
            if fragments and split is not None and rest:
                lines = pa.concat_arrays(rest)
                yield rows(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n"), place)

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3, 4)), strict=True))
            bounds = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if a == b:
                    continue
                if keys[a] != split:
                    yield from left()
                    split, rest, odd, place = keys[a], [], batch.column(5)[a].as_py(), 0
                    inside = odd == 1  # the first record started in an earlier split
                start = odd
                if rest:
                    lines, start = pa.concat_arrays([*rest, batch.column(0).slice(a, b - a)]), 1 if inside else 0
                else:
                    lines = batch.column(0).slice(a, b - a)
                records, after, odd = _joined(lines.cast(pa.string()), start)
                rest = [after] if len(after) else []
                if len(records) and inside:
                    if fragments:
                        yield rows(records.slice(0, 1), place)
                    records, inside, place = records.slice(1), False, place + 1
                if len(records):
                    if not fragments:
                        yield rows(records, place)
                    place += len(records)
        yield from left()

    return run


_RECORDS = "file_path string, file_name string, file_size bigint, start bigint, place bigint, record string"


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file_path, file_name, file_size, start, place, record): records in UTF-8 files; the first one of a file has start and place 0.

    An unclosed quote makes the rest of its file one record, as it does for a reader of whole files.
    """
    lines = _lines(importable(spark), path)
    splits = materialize(_parities(lines), "splits")
    known = lookup_join(lines, splits, _SPLIT)
    fields = ["value", "file_path", "file_name", "file_size", "start", "odd"]
    records = known.select(*fields).mapInArrow(_regroup(False), _RECORDS)
    if splits.filter("cut").isEmpty():
        return records
    parts = materialize(known.filter("cut").select(*fields).mapInArrow(_regroup(True), _RECORDS), "fragments")
    # an end of a record has place 0 in a split that starts within quotes; all others start one
    odd = lookup_join(parts, splits, _SPLIT)
    opens = F.when((F.col("odd") == 1) & (F.col("place") == 0), 0).otherwise(1)
    number = F.sum(opens).over(Window.partitionBy("file_path").orderBy("start", "place"))
    piece = F.struct("start", "place", "record")
    whole = odd.withColumn("number", number).groupBy("file_path", "file_name", "file_size", "number").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    first = F.get("pieces", F.lit(0))
    return records.unionByName(whole.select(
        "file_path", "file_name", "file_size", first["start"].alias("start"), first["place"].alias("place"),
        F.array_join(F.transform("pieces", lambda p: p["record"]), "\n").alias("record"),
    ))
