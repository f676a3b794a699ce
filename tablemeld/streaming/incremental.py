"""Incremental harmonization: frozen parameters on newly arrived files.

Every transform is a stateless projection whose parameters were fitted in batch, so
the stream needs no state, no watermark and no shuffle (frozen percentile ranks are a join
with a static table).  Each micro-batch is written under the id of its query, which lives in
the checkpoint, and its batch id: a batch that is retried after a failure replaces its own
output, and a new checkpoint never replaces the output of an old one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tablemeld.operators import transform as tf, validate as va
from tablemeld.sources.tables import csv_options, format_of

Step = Callable[[DataFrame], DataFrame]


def read_stream(
    spark: SparkSession, folder: str, schema, kind: str | None = None, max_files: int | None = None, **options
) -> DataFrame:
    """A stream of the files that arrive in a folder, read with the options of the batch readers.

    A JSON stream has a record on each line unless ``multiLine`` is given: its files are not known beforehand.
    """
    kind = kind or format_of(folder, "parquet")
    reader = spark.readStream.format(kind).schema(schema)
    if kind == "csv":
        reader = reader.options(**csv_options(typed=True))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.options(**options).load(folder)


def harmonized_stream(stream: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """The stream after its fitted steps."""
    for step in steps:
        stream = step(stream)
    return stream


def start(
    stream: DataFrame,
    steps: Sequence[Step],
    output: str,
    checkpoint: str,
    rules: Sequence[va.Rule] = (),
    flag_output: str | None = None,
    dataset: str = "incremental",
    record_id: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Append harmonized rows, and their flags, as files arrive.

    ``checkpoint`` must be a folder that all executors share.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.read.json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]
        part = f"query_id={query}/batch_id={batch_id}"
        with tf.increments():
            done = harmonized_stream(batch, steps)
        done.write.mode("overwrite").parquet(f"{output.rstrip('/')}/{part}")
        if rules and flag_output:
            # the written rows, so the steps do not run twice
            written = batch.sparkSession.read.schema(done.schema).parquet(f"{output.rstrip('/')}/{part}")
            va.record_flags(written, rules, dataset, record_id).write.mode("overwrite").parquet(
                f"{flag_output.rstrip('/')}/{part}"
            )

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
