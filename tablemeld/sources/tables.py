"""Table readers and writers."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablemeld.columns import nan_to_null, ref, union_by_name
from tablemeld.sources.records import csv_records
from tablemeld.storage import join_files, local_path, path_exists, shared_folder

FORMATS = {"csv": "csv", "json": "json", "parquet": "parquet", "orc": "orc"}


@dataclass(frozen=True)
class Source:
    """A table and where it comes from."""

    data: DataFrame
    path: str
    format: str
    encoding: str | None = None
    #: The reads that ``data`` unites, where it is more than one.
    parts: tuple[DataFrame, ...] = ()

    def files(self) -> DataFrame:
        """(file_path, file_name, file_size, rows) of every file read."""
        meta = F.col("_metadata")
        names = ("file_path", "file_name", "file_size")
        found = [part.groupBy(*[meta[n].alias(n) for n in names]).agg(F.count(F.lit(1)).alias("rows")) for part in self.parts or (self.data,)]
        return union_by_name(found)

    def describe(self) -> DataFrame:
        """One row: path, format, encoding, rows, columns and total size."""
        found = self.files().agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum("file_size"), F.lit(0)).alias("file_size_bytes"),
        )
        return found.select(
            F.lit(self.path).alias("file_path"),
            F.lit(self.format).alias("file_type"),
            F.lit(self.encoding).cast("string").alias("encoding"),
            "rows",
            F.array(*[F.lit(c) for c in self.data.columns]).cast("array<string>").alias("columns"),
            F.lit(len(self.data.columns)).alias("column_count"),
            "file_size_bytes",
        )


def format_of(path: str, default: str | None = None) -> str:
    suffix = path.rstrip("/").lower().rsplit(".", 1)[-1]
    found = FORMATS.get(suffix, default)
    if found is None:
        raise ValueError(f"unsupported file format: .{suffix}")
    return found


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if every line is valid UTF-8, else ISO-8859-1 (which reads any bytes)."""
    broken = spark.read.text(path).where(~F.is_valid_utf8("value"))
    return "UTF-8" if broken.isEmpty() else "ISO-8859-1"


def csv_options(typed: bool, lines: bool = False) -> dict:
    """How CSV is read everywhere, in batches and in streams; ``typed``: with a schema."""
    return {"header": True, "escape": '"', "multiLine": not lines} | ({"nullValue": "\0"} if typed else {})


def read_csv(
    spark: SparkSession, path: str, encoding: str | None = None, schema: T.StructType | str | None = None,
    lines: bool = False, split: bool | None = None, **options,
) -> Source:
    """CSV with a header; an empty file gives an empty table.

    Quoted values may hold line breaks.  Small files are a task each; a folder with a UTF-8 file of
    several splits is read by records (``split``), which many tasks share.  ``lines=True`` promises
    that no value holds a line break.  A ``schema`` saves the pass that infers the types, an
    ``encoding`` the pass that checks for UTF-8.  With a schema a quoted empty value is an
    empty text and only an unquoted one is missing; without one both are missing.
    """
    encoding = encoding or detect_encoding(spark, path)
    wanted = csv_options(schema is not None, lines) | {"encoding": encoding, "inferSchema": schema is None} | options
    if split is None:
        # other quotes and separators of lines are left to the reader of whole files
        split = not lines and not options and encoding == "UTF-8" and _largest_file(spark, path) > 2 * _split_bytes(spark)
    if split:
        return _read_records(spark, path, schema, wanted)
    reader = spark.read.options(**wanted)
    return Source((reader if schema is None else reader.schema(schema)).csv(path), path, "csv", encoding)


def _split_bytes(spark: SparkSession) -> int:
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))


def _largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file, from the listing alone."""
    found = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
    return found or 0


def _read_records(spark: SparkSession, path: str, schema: T.StructType | str | None, options: dict) -> Source:
    """CSV parsed record by record."""
    found = csv_records(spark, path)
    meta = F.struct("file_path", "file_name", "file_size").alias("_metadata")
    heads = found.where("start = 0 and place = 0")
    rows = found.where("not (start = 0 and place = 0)").where(~F.col("record").isin("", "\r")).select(F.regexp_replace("record", "\\r$", "").alias("record"), meta)
    parse = {k: v for k, v in options.items() if k not in ("header", "multiLine", "inferSchema", "encoding")}
    if schema is None:
        head = heads.agg(F.min_by("record", "file_path").alias("record")).first()
        if head["record"] is None:
            return Source(spark.createDataFrame([], T.StructType([])), path, "csv", "UTF-8")
        schema = _inferred(spark, head["record"].rstrip("\r"), rows, parse)
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parsed = F.from_csv("record", fields.toDDL(), {k: str(v) for k, v in parse.items()})
    data = rows.select(parsed.alias("row")).select(*[F.col("row")[f.name].alias(f.name) for f in fields])
    return Source(data, path, "csv", "UTF-8", parts=(rows,))


def _inferred(spark: SparkSession, head: str, rows: DataFrame, options: dict) -> T.StructType:
    """Names from a header, types from all records."""
    strings = spark._jvm.org.apache.spark.sql.Encoders.STRING()
    reader = lambda **more: spark.read.options(**options | more)._jreader
    named = reader(header=True).csv(getattr(spark.createDataFrame([(head,)], "value string")._jdf, "as")(strings))
    typed = reader(header=False, inferSchema=True).csv(getattr(rows.select(F.col("record").alias("value"))._jdf, "as")(strings))
    names, kinds = (T.StructType.fromJson(json.loads(found.schema().json())) for found in (named, typed))
    return T.StructType([T.StructField(f.name, kinds[i].dataType if i < len(kinds) else T.StringType()) for i, f in enumerate(names)])


def _json_kinds(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Files of one array, and files of a record on each line, by the first text of each file.

    One aggregate over the lines; a file without any text is in neither list.
    """
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())  # ids grow along a split
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.ltrim(F.regexp_replace("value", "\ufeff", "")).alias("line"), place.alias("place"))
    first = lines.where(F.trim("line") != "").groupBy("file").agg(F.min_by(F.substring("line", 1, 1), "place").alias("mark"))
    found = first.groupBy((F.col("mark") == "[").alias("whole")).agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    kinds = {r["whole"]: [_literal(f) for f in r["files"]] for r in found}
    return kinds.get(True, []), kinds.get(False, [])


def _literal(file: str) -> str:
    """A file's address as a path that names it alone: decoded, and without signs that match several names."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(file))


def merged_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that values of both types are read as: numbers widen, fields come together, anything else is text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        fields = {f.name: f.dataType for f in a.fields}
        for f in b.fields:
            fields[f.name] = merged_type(fields[f.name], f.dataType) if f.name in fields else f.dataType
        return T.StructType([T.StructField(n, fields[n]) for n in sorted(fields)])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merged_type(a.elementType, b.elementType))
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    return T.StringType()


def read_json(
    spark: SparkSession, path: str, multiline: bool | None = None, schema: T.StructType | str | None = None, **options
) -> Source:
    """JSON records, one on each line, or files of one array, which are read whole.

    Each file of a folder is read as its own first text says, and all with one schema; ``multiline``
    says it for all files and saves the pass that looks.
    """
    def read(paths: str | list[str], whole: bool, wanted: T.StructType | str | None) -> DataFrame:
        base = {} if paths == path or not path_exists(spark, path) else {"basePath": path}
        reader = spark.read.options(**{"multiLine": whole} | base | options)
        return (reader if wanted is None else reader.schema(wanted)).json(paths)

    if multiline is not None:
        return Source(read(path, multiline, schema), path, "json")
    kinds = dict(zip((True, False), _json_kinds(spark, path), strict=True))
    held = {whole: files for whole, files in kinds.items() if files}
    if len(held) < 2:
        # one kind only: the path itself, so that partition columns of a folder stay
        return Source(read(path, True in held, schema), path, "json")
    if schema is None:
        inferred = [read(files, whole, None).schema for whole, files in held.items()]
        schema = merged_type(*inferred)
    parts = tuple(read(files, whole, schema) for whole, files in held.items())
    return Source(union_by_name(parts), path, "json", parts=parts)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> Source:
    """A table by file extension."""
    kind = format_of(path)
    if kind == "csv":
        return read_csv(spark, path, schema=schema, **options)
    if kind == "json":
        return read_json(spark, path, schema=schema, **options)
    reader = spark.read.format(kind).options(**options)
    return Source((reader if schema is None else reader.schema(schema)).load(path), path, kind)


def read_statistics(spark: SparkSession, path: str, dataset: str = "baseline") -> DataFrame:
    """Stored statistics, relabelled; ``-`` bounds are missing values."""
    table = read_table(spark, path).data
    cleaned = [
        F.expr(f"try_cast(`{c}` AS double)").alias(c) if c in ("min", "max") else F.col(f"`{c}`")
        for c in table.columns
    ]
    return nan_to_null(table.select(*cleaned)).withColumn("dataset", F.lit(dataset))


def write_table(df: DataFrame, path: str, kind: str | None = None, mode: str = "overwrite") -> str:
    """Write a table in the format of its extension, CSV by default."""
    kind = kind or format_of(path, "csv")
    writer = df.write.mode(mode)
    if kind == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(kind).save(path)
    return path


def write_one_csv(df: DataFrame, path: str) -> str:
    """A new folder with one CSV file, which many tasks write: parts first, then every range of a part to its place.

    The folder and the shared folder must be of a file system that executors mount (``file:``); a store
    without places in files gets the file from one task.
    """
    spark = df.sparkSession
    parts = f"{shared_folder(spark).rstrip('/')}/tablemeld/csv-parts-{uuid.uuid4().hex}"
    folder, source = local_path(spark, path), local_path(spark, parts)
    if folder is None or source is None:
        return write_table(df.coalesce(1), path, "csv", "errorifexists")
    df.write.option("header", False).option("escape", '"').csv(parts)
    quoted = [f'"{c.replace(chr(34), chr(34) * 2)}"' for c in df.columns]
    return join_files(spark, source, folder, f"part-00000-{uuid.uuid4().hex}.csv", (",".join(quoted) + "\n").encode())


def write_report(report: dict[str, DataFrame], folder: str) -> list[str]:
    """Every table of a report as JSON rows below one folder."""
    paths = []
    for name, table in report.items():
        paths.append(write_table(table, f"{folder.rstrip('/')}/{name}", "json"))
    return paths


def combine(frames: dict[str, DataFrame]) -> DataFrame:
    """UNION ALL by name; columns a frame lacks are null."""
    return union_by_name(list(frames.values()))


def _csv_columns(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """Rows in the column order of an existing CSV output, which cannot gain columns."""
    order = spark.read.option("header", True).csv(path).columns
    new = [c for c in rows.columns if c not in order]
    if new:
        raise ValueError(f"a CSV output cannot gain columns {new}: combine into Parquet")
    return rows.select(*[ref(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in order])


def write_combined(
    spark: SparkSession, frames: dict[str, DataFrame], path: str, incremental_only: bool = False
) -> str:
    """Write the union, or append only the incremental frame to an existing output.

    The existing output is not rewritten when appending to Parquet, only its schema is read: numbers
    widen to the type that a column has there, and columns it lacks appear as null through schema
    merging.  A column whose values the output's type cannot hold is refused.
    """
    if incremental_only and path_exists(spark, path):
        if "incremental" in frames:
            rows, kind = frames["incremental"], format_of(path, "parquet")
            if kind == "csv":
                rows = _csv_columns(spark, rows, path)
            elif kind == "parquet":
                rows = _typed_like(rows, read_combined(spark, path).schema)
            write_table(rows, path, kind, "append")
        return path
    return write_table(combine(frames), path, format_of(path, "parquet"))


def _typed_like(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows with the types that a stored table has for their columns."""
    stored = {f.name: f.dataType for f in schema.fields}
    size = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8}
    change = {}
    for f in rows.schema.fields:
        want = stored.get(f.name, f.dataType)
        if want == f.dataType:
            continue
        wider = type(f.dataType) in size and (isinstance(want, T.DoubleType) or size.get(type(want), 0) > size[type(f.dataType)])
        if not (wider or isinstance(f.dataType, (T.NullType, T.FloatType)) and isinstance(want, T.DoubleType) or isinstance(want, T.StringType)):
            raise ValueError(f"column {f.name} is {want.simpleString()} in the output and {f.dataType.simpleString()} here: write all sources again")
        change[f.name] = ref(f.name).cast(want)
    return rows.withColumns(change) if change else rows


def read_combined(spark: SparkSession, path: str) -> DataFrame:
    """A combined Parquet output whose appends may have added columns."""
    return spark.read.option("mergeSchema", True).parquet(path)
