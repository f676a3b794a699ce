"""Shared-folder materialization: cuts lineage with a table every executor can read."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tablemeld.session import importable

_SETTING = "spark.checkpoint.dir"
#: Bytes of a range that a task copies, and those that it holds.
COPY_BYTES, HELD_BYTES = 32 << 20, 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the cluster; local sessions without one get their own."""
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tablemeld-")
    spark.conf.set(_SETTING, folder)
    return folder


def materialize(df: DataFrame, label: str, file_rows: int = 0) -> DataFrame:
    """Write a result that several later jobs read, and return the written table; rows of a file at most, if any."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tablemeld/{label}-{uuid.uuid4().hex}"
    (df.write.option("maxRecordsPerFile", file_rows) if file_rows else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a written result that no later job reads."""
    spark = table.sparkSession
    for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
        system, location = _location(spark, folder)
        system.delete(location, True)


def _location(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), location


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on whatever file system it names."""
    system, location = _location(spark, path)
    return system.exists(location)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    system, location = _location(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(location)) if system.exists(location) else []


def local_path(spark: SparkSession, path: str) -> str | None:
    """A path as files are opened by, if it is of a mounted file system."""
    system, location = _location(spark, path)
    return location.toUri().getPath() if system.getUri().getScheme() == "file" else None


def _copy(target: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                with open(r.source, "rb") as read, open(target, "r+b") as write:
                    read.seek(r.start)
                    write.seek(r.at)
                    left = r.size
                    while left:
                        held = read.read(min(left, HELD_BYTES))
                        if not held:
                            raise OSError(f"{r.source} is shorter than it was")
                        write.write(held)
                        left -= len(held)
            yield batch[["size"]]

    return run


def join_files(spark: SparkSession, source: str, folder: str, name: str, head: bytes) -> str:
    """A new folder with one file: ``head`` and the part files of ``source`` in order, copied to their places by many tasks.

    Only names and sizes of the parts are known to the driver.  Until all is copied the file has a name
    that readers pass over; a range that is copied twice has the same bytes.
    """
    os.makedirs(folder)
    ranges, at = [], len(head)
    for part in sorted(f for f in os.listdir(source) if f.startswith("part-")):
        size = os.path.getsize(os.path.join(source, part))
        ranges += [(os.path.join(source, part), k, min(COPY_BYTES, size - k), at + k) for k in range(0, size, COPY_BYTES)]
        at += size
    hidden = os.path.join(folder, f"_{name}")
    with open(hidden, "wb") as file:
        file.write(head)
        file.truncate(at)
    if ranges:
        rows = importable(spark).createDataFrame(ranges, "source string, start long, size long, at long")
        copied = rows.repartitionByRange(len(ranges), "at").mapInPandas(_copy(hidden), "size long").agg({"size": "sum"}).first()[0]
        if copied != at - len(head):
            raise OSError(f"{copied} of {at - len(head)} bytes were copied")
    os.rename(hidden, os.path.join(folder, name))
    return folder
