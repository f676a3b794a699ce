"""A stored table that grows by segments and is read as a snapshot and the segments since.

Every append is a segment under the id of its run: a run that is repeated, after a failure or by
accident, replaces its own segment, so its rows count once.  ``compact`` writes what all segments
so far amount to as the next snapshot, with the list of runs that it holds; a load reads the newest
snapshot and the segments of other runs, not the history behind them.  A segment counts once it is
complete, a snapshot once its list of runs (one file, written last) is there.  One process compacts
a table at a time; a run that a snapshot holds already is not counted again.  Nothing is deleted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablemeld.storage import children, path_exists


class Segments:
    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def append(self, rows: DataFrame, run: str | None = None) -> str:
        """Write a run's rows, in place of those that it wrote before; returns the id of the run."""
        run = run or uuid.uuid4().hex
        fields = self.spark.createDataFrame([], self.schema).schema
        rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields]).write.mode("overwrite").parquet(self._segment(run))
        return run

    def _segment(self, run: str) -> str:
        return f"{self.folder}/log/run={quote(run, safe='')}"

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def version(self) -> int:
        """The newest snapshot (0: none)."""
        names = [n for n in children(self.spark, f"{self.folder}/commits") if path_exists(self.spark, f"{self.folder}/commits/{n}/_SUCCESS")]
        return max(map(int, names), default=0)

    def _state(self) -> tuple[int, DataFrame, set[str], list[str]]:
        """Version, the snapshot's rows, the runs that it holds, and the complete runs since."""
        version, held = self.version(), set()
        if version:
            held = {r["run"] for r in self.spark.read.schema("run string").parquet(f"{self.folder}/commits/{version}").collect()}
        known = {unquote(n.removeprefix("run=")) for n in children(self.spark, f"{self.folder}/log")}
        newer = [r for r in sorted(known - held) if path_exists(self.spark, f"{self._segment(r)}/_SUCCESS")]
        return version, self._read([f"{self.folder}/snapshots/{version}"] if version else []), held, newer

    def runs(self) -> list[str]:
        """Runs since the snapshot, whose segments a load reads."""
        return self._state()[3]

    def load(self) -> DataFrame:
        """All rows: the snapshot's and those of the segments since."""
        version, rows, _, newer = self._state()
        log = self._read([self._segment(r) for r in newer])
        return rows.unionByName(log) if version and newer else log if newer else rows

    def compact(self, merge: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> int:
        """Write ``merge`` of all rows as the next snapshot; returns the newest version.  Appends that come meanwhile stay in the log."""
        version, rows, held, newer = self._state()
        if not newer:
            return version
        version += 1
        merge(rows.unionByName(self._read([self._segment(r) for r in newer]))).write.mode("overwrite").parquet(f"{self.folder}/snapshots/{version}")
        listed = self.spark.createDataFrame([(r,) for r in sorted(held.union(newer))], "run string")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/{version}")
        return version
