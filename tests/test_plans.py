import csv
import json
import os
import random

import pytest
from pyspark.sql import functions as F, types as T

import __spark_entry__ as entry
from tablemeld import storage
from tablemeld.operators import impute as im, memory as me, transform as tf, validate as va
from tablemeld.plans import local, metadata as mp, multi_source, single_source
from tablemeld.sources import metadata as md, tables as st
from tablemeld.streaming import incremental
from tests import samples

SCHEMA = md.master_schema(
    {
        "schema_name": "survey", "version": "1.0",
        "columns": [
            {"name": "respondent_id", "data_type": "integer", "is_key": True, "aliases": ["resp_id"]},
            {"name": "survey_date", "data_type": "datetime", "aliases": ["interview_date"]},
            {"name": "country", "data_type": "categorical", "aliases": ["market"]},
            {"name": "age", "data_type": "categorical", "aliases": ["age_group"]},
            {"name": "gender", "data_type": "categorical"},
            {"name": "satisfaction_score", "data_type": "float", "aliases": ["csat"], "validation_rules": {"min_value": 0, "max_value": 100}},
            {"name": "nps_score", "data_type": "integer", "aliases": ["nps"], "validation_rules": {"min_value": 0, "max_value": 10}},
            {"name": "purchase_intent", "data_type": "categorical", "aliases": ["purchase_likelihood"]},
            {"name": "channel", "data_type": "categorical"},
        ],
    }
)
MAPS = {
    "channel": {"ONL": "Online", "RET": "Retail", "MOB": "Mobile", "SOC": "Social"},
    "purchase_intent": {"VU": "Very Unlikely", "U": "Unlikely", "N": "Neutral", "L": "Likely", "VL": "Very Likely"},
    "gender": {"Male": "M", "Female": "F"},
}


def test_csv_with_latin1_text_and_empty_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('id,name\n1,Espa\xf1a\n2,"a ""b"""\n'.encode("latin-1"))
    source = st.read_table(spark, str(tmp_path / "a.csv"))
    assert source.encoding == "ISO-8859-1"
    assert [tuple(r) for r in source.data.orderBy("id").collect()] == [(1, "España"), (2, 'a "b"')]
    row = source.describe().first()
    assert (row["rows"], row["column_count"], row["columns"]) == (2, 2, ["id", "name"]) and row["file_size_bytes"] > 0
    (tmp_path / "u.csv").write_text("id,name\n1,España\n", encoding="utf-8")
    assert st.read_table(spark, str(tmp_path / "u.csv")).data.first()["name"] == "España"
    (tmp_path / "e.csv").write_text("")
    assert st.read_table(spark, str(tmp_path / "e.csv")).data.count() == 0
    with pytest.raises(ValueError):
        st.read_table(spark, str(tmp_path / "a.sav"))


def test_json_and_parquet_round_trip(spark, tmp_path, answers):
    (tmp_path / "r.json").write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": None}]))
    assert st.read_table(spark, str(tmp_path / "r.json")).data.count() == 2
    path = st.write_table(answers, str(tmp_path / "t.parquet"))
    assert st.read_table(spark, path).data.count() == 7
    assert st.write_table(answers, str(tmp_path / "plain")) and (tmp_path / "plain" / "_SUCCESS").exists()


def test_documents(spark, tmp_path):
    (tmp_path / "master_schema.json").write_text(json.dumps({"schema": {"columns": [{"name": "a", "aliases": ["b"]}]}}))
    assert md.load_master_schema(spark, str(tmp_path)).columns[0].aliases == ("b",)
    pytest.importorskip("yaml")
    (tmp_path / "rules.yaml").write_text("rules:\n  - min_records: 5\n  - column: x\n    allowed_values: [1, 2]\n")
    found = md.load_rules(spark, str(tmp_path / "rules.yaml"))
    assert found[0].min_records == 5 and found[1].allowed_values == ("1", "2")
    (tmp_path / "rules.txt").write_text("column: x not null\n\nminimum 5 records\n")
    assert [r.text for r in md.load_rules(spark, str(tmp_path / "rules.txt"))] == ["column: x not null", "minimum 5 records"]
    assert md.load_rules(spark, str(tmp_path / "none.yaml")) == []
    maps = md.value_maps({"c": {"1": "a"}, "scale_normalizations": {"s": {"input_scales": [{"name": "x", "min": 1, "max": 5}]}}})
    assert maps == {"c": {"1": "a"}}
    assert md.rules_table(spark, found).count() == 2 and md.schema_table(spark, SCHEMA).count() == 9


def test_local_harmonization_order(spark):
    df = spark.createDataFrame(
        [(1, "2024 > 06 > 01", "Uk", "north", "Web", 3, "1"), (2, "2024 > 06 > 02", "España", None, "Fax", None, "2"), (3, "2024 > 06 > 03", "Chile", "NY", None, 5, "x")],
        "`Respondent ID` int, `Survey Date` string, Country string, Region string, Channel string, Likert int, `Code!` string",
    )
    out = local.harmonize(df, local.Options(scale_conversion="1-5", column_strategies={"Likert": "Replace with MEDIAN"}))
    assert out.columns == ["respondent_id", "survey_date", "country", "region", "channel", "likert", "code"]
    rows = [tuple(r) for r in out.orderBy("respondent_id").collect()]
    # ids lie in 1-5 too, so the scale step converts them, as every numeric column that fits
    assert rows == [
        (0.0, "2024-06-01", "GB", "NORTH", "ONLINE", 50.0, "1"),
        (25.0, "2024-06-02", "ES", "UNKNOWN", "fax", 75.0, "2"),
        (50.0, "2024-06-03", "CHILE", "US-NY", "unknown", 100.0, "x"),
    ]
    result = local.run(df)
    assert result["score"].first()["quality_score"] == 100.0 and result["changes"].count() > 5


def test_golden_brand_survey_shape(spark):
    """Numeric nulls become the mean, the tied-free mode fills text, regions turn upper case."""
    df = spark.createDataFrame(
        [(1, "Female", "North", 0.0, None), (2, None, "south", 1.0, 4.0), (3, "Female", "East", None, 2.0), (4, "Male", "West", 1.0, None)],
        "RID bigint, Gender string, Region string, BrandA_usage double, BrandA_affinity double",
    )
    out = local.harmonize(df, local.Options(column_strategies={"Gender": "Replace with MODE"}))
    rows = {r["rid"]: r for r in out.collect()}
    assert rows[2]["gender"] == "Female" and rows[2]["region"] == "SOUTH"
    assert rows[3]["branda_usage"] == pytest.approx(2 / 3) and rows[1]["branda_affinity"] == 3.0


def test_golden_channel_pair(spark):
    df = spark.createDataFrame([("Uk", "18 - 24", "Web"), ("Belgium", "35-44", "Unknown")], "country string, age string, channel string")
    out = local.harmonize(df, local.Options(remove_special=False))
    assert [tuple(r) for r in out.collect()] == [("GB", "18 - 24", "ONLINE"), ("BELGIUM", "35-44", "unknown")]


def test_single_source_run(spark, tmp_path):
    df = samples.historical(spark)
    result = single_source.run(df, SCHEMA, MAPS, ["column: nps between 0 and 9"], keys=["resp_id"])
    out = result["harmonized"]
    assert out.columns == SCHEMA.names and out.count() == 200
    bounds = out.agg(F.min("satisfaction_score"), F.max("satisfaction_score")).first()
    assert tuple(bounds) == (0.0, 100.0)  # the observed 1-5 range is stretched
    assert {r["channel"] for r in out.select("channel").distinct().collect()} == {"Online", "Retail", "Mobile", "Social"}
    assert result["validation"].first()["confidence_score"] == pytest.approx((7 * 0.9 + 2) / 9)
    changes = {r["column"]: r["values_changed"] for r in result["comparison"].collect()}
    assert changes["channel"] == 200 and changes["country"] == 0
    assert result["harmonization"].first()["records_failed"] == 0
    assert result["run"].first()["status"] in ("success", "warning", "error")
    declared = single_source.run(samples.current(spark), SCHEMA, MAPS, scale_bounds="declared")["harmonized"]
    assert declared.agg(F.max("satisfaction_score")).first()[0] <= 100
    path = st.write_table(df, str(tmp_path / "in.csv"))
    single_source.run_files(spark, path, SCHEMA, str(tmp_path / "out.parquet"), str(tmp_path / "reports"), MAPS)
    assert spark.read.parquet(str(tmp_path / "out.parquet")).count() == 200
    assert spark.read.json(str(tmp_path / "reports" / "mappings")).count() == 9


def test_multi_source_run(spark, tmp_path):
    sources = {"historical": samples.historical(spark), "current": samples.current(spark), "incremental": samples.incremental(spark)}
    rules = md.rules({"rules": [{"column": "satisfaction_score", "min": 0, "max": 100}, {"min_records": 100}]})
    result = multi_source.run(sources, SCHEMA, MAPS, rules, settings=multi_source.Settings(group_columns=["gender"]))
    combined = result["combined"]
    assert combined.count() == 420 and set(combined.columns) == set(SCHEMA.names)
    assert {r["country"] for r in combined.select("country").distinct().collect()} <= {
        "USA", "UK", "Germany", "France", "Spain", "Italy", "Netherlands", "Belgium", "Japan", "Australia", "Canada", "Brazil", "India", "China",
    } | {"US", "DE"}
    assert result["calibration_report"].count() == 6  # three genders, two measures; ids are left alone
    flags = result["flags"]
    assert flags.where("issue_type = 'min_records'").first()["dataset"] == "incremental"
    matched = {r["source_column"]: r["target_column"] for r in result["cross_dataset"].collect()}
    assert matched == {c: c for c in SCHEMA.names}
    assert result["descriptive_stats"].select("dataset").distinct().count() == 3
    assert result["market_comparison"].select("dataset").distinct().count() == 2
    multi_source.remember(result, str(tmp_path))
    assert me.latest_table(spark, str(tmp_path), "datasets").count() == 3
    assert me.load(spark, str(tmp_path), "learned_mappings").count() == 27


def test_runs_on_files(spark, tmp_path):
    sources = {"historical": samples.historical(spark), "current": samples.current(spark), "incremental": samples.incremental(spark)}
    paths = {name: str(tmp_path / f"{name}.parquet") for name in sources}
    for name, df in sources.items():
        df.write.parquet(paths[name])
    out, memory = str(tmp_path / "out"), str(tmp_path / "memory")
    options = {"value_maps": MAPS, "settings": multi_source.Settings(group_columns=["gender"])}
    first = {k: paths[k] for k in ("historical", "current")}
    result = multi_source.run_files(spark, first, SCHEMA, out, memory, run_id="first", **options)
    held = st.read_combined(spark, out).count()
    assert held == result["combined"].count() > 0
    for _ in range(2):  # a repeated run learns once
        multi_source.run_files(spark, first, SCHEMA, out, memory, run_id="first", **options)
    assert me.load(spark, memory, "datasets").count() == 2
    added = multi_source.run_files(spark, paths, SCHEMA, out, memory, incremental_only=True, run_id="second", **options)
    assert "calibration_report" not in added
    assert st.read_combined(spark, out).count() == held + sources["incremental"].count()
    assert {r["dataset"] for r in me.latest_table(spark, memory, "datasets").collect()} == set(sources)
    with pytest.raises(ValueError):
        multi_source.run_files(spark, first, SCHEMA, out, incremental_only=True, **options)


def test_combined_output_appends(spark, tmp_path):
    path = str(tmp_path / "all.parquet")
    first = {"historical": spark.createDataFrame([(1, "a")], "k int, v string")}
    st.write_combined(spark, first, path)
    more = first | {"incremental": spark.createDataFrame([(2, 0.5)], "k int, w double")}
    st.write_combined(spark, more, path, incremental_only=True)
    rows = sorted(map(tuple, st.read_combined(spark, path).select("k", "v", "w").collect()))
    assert rows == [(1, "a", None), (2, None, 0.5)]
    st.write_combined(spark, more, path)
    assert st.read_combined(spark, path).count() == 2
    text = str(tmp_path / "all.csv")
    st.write_combined(spark, first, text)
    st.write_combined(spark, {"incremental": spark.createDataFrame([("b",)], "v string")}, text, incremental_only=True)
    assert sorted(map(tuple, st.read_table(spark, text).data.collect()), key=str) == [(1, "a"), (None, "b")]
    with pytest.raises(ValueError):
        st.write_combined(spark, more, text, incremental_only=True)


def test_generated_metadata_is_written(spark, tmp_path, answers):
    paths = mp.write(mp.run(answers), str(tmp_path))
    assert len(paths) == 7 and spark.read.parquet(paths[0]).count() == 7


def test_baseline_statistics(spark, tmp_path):
    (tmp_path / "stats.csv").write_text("dataset,column,mean,min,max\nx,a,1.5,-,-\nx,b,2.5,0,9\n")
    rows = {r["column"]: r for r in st.read_statistics(spark, str(tmp_path / "stats.csv")).collect()}
    assert rows["a"]["dataset"] == "baseline" and rows["a"]["min"] is None and rows["b"]["max"] == 9.0


def test_stream_replays_fitted_parameters(spark, tmp_path):
    batch = samples.current(spark, 60).withColumn("nps_score", F.when(F.col("respondent_id") % 5 > 0, F.col("nps_score")))
    plan = local.fit(batch, local.Options(auto_numeric=False))
    fills = im.fit_typed(batch)
    arrived = str(tmp_path / "arrived")
    batch.limit(30).write.parquet(arrived)

    def run():
        incremental.start(
            incremental.read_stream(spark, arrived, batch.schema, "parquet"),
            [lambda df: im.apply_fills(df, fills), lambda df: local.apply(df, plan)],
            str(tmp_path / "out"), str(tmp_path / "checkpoint"), [va.Rule("nps_score", max=9)], str(tmp_path / "flags"),
            record_id="respondent_id",
        ).awaitTermination()

    run()
    batch.where("respondent_id >= 2030").write.mode("append").parquet(arrived)
    run()
    out = spark.read.parquet(str(tmp_path / "out"))
    expected = local.apply(im.apply_fills(batch, fills), plan)
    key = ["respondent_id", "country", "nps_score"]
    assert sorted(map(tuple, out.select(*key).collect())) == sorted(map(tuple, expected.select(*key).collect()))
    assert spark.read.parquet(str(tmp_path / "flags")).count() == out.where("nps_score > 9").count()


def test_shared_folder_comes_from_the_session(spark):
    folder = storage.shared_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir")
    table = storage.materialize(spark.range(5), "five")
    assert table.count() == 5 and folder.split("/")[-1] in table.inputFiles()[0]


def test_sample_tables_are_deterministic(spark):
    first, second = samples.survey(spark, 200), samples.survey(spark, 200)
    assert first.exceptAll(second).count() == 0 and first.count() > 200


def test_entry_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 100


def test_transform_of_a_stream_is_stateless(spark, tmp_path):
    spark.range(3).withColumn("v", F.lit("x ")).write.parquet(str(tmp_path / "in"))
    stream = incremental.read_stream(spark, str(tmp_path / "in"), "id bigint, v string", "parquet")
    plan = tf.apply_transforms(stream, {"v": "v"}, {"v": tf.Transform("string_standardize")})
    assert plan.isStreaming


def test_whole_records_are_read(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "quoted"\nsecond line'), (2, ""), (3, None)], "k int, v string").coalesce(1)
    st.write_table(rows, str(tmp_path / "t.csv"))
    back = st.read_table(spark, str(tmp_path / "t.csv"), schema=rows.schema).data
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert st.read_table(spark, str(tmp_path / "t.csv")).data.count() == 3
    many = spark.range(100).withColumn("v", F.lit("x"))
    st.write_table(many, str(tmp_path / "many.json"))
    assert st.read_table(spark, str(tmp_path / "many.json")).data.count() == 100
    (tmp_path / "array.json").write_text('\n [{"a": 1},\n {"a": 2}]')
    assert st.read_table(spark, str(tmp_path / "array.json")).data.count() == 2


def test_folder_of_json_arrays_and_lines(spark, tmp_path):
    folder = tmp_path / "mixed folder.json"
    (folder / "day=1").mkdir(parents=True)
    (folder / "day=2").mkdir()
    (folder / "day=1" / "a file.json").write_text('\ufeff\n [{"a": 1, "b": {"c": 1}},\n {"a": 2.5, "d": "x\\ny"}]')
    (folder / "day=2" / "b.json").write_text("\n".join('{"a": %d, "b": {"e": "t"}}' % k for k in range(10)))
    (folder / "day=2" / "empty.json").write_text(" \n")
    (folder / "day=2" / "c.json").write_text('[\n{"a": 7}\n]')
    source = st.read_table(spark, str(folder))
    data = source.data
    assert data.count() == 13 and {"a", "b", "d", "day"} == set(data.columns)
    assert sorted(r["a"] for r in data.collect()) == sorted([1, 2.5, 7, *range(10)])
    assert {(r["a"], r["day"]) for r in data.where("d is not null or a = 7").collect()} == {(2.5, 1), (7.0, 2)}
    typed = st.read_table(spark, str(folder), schema="a double, d string").data
    assert typed.count() == 13 and typed.where("d = 'x\ny'").count() == 1
    assert {r["file_name"].split(".")[0][0]: r["rows"] for r in source.files().collect()} == {"a": 2, "b": 10, "c": 1}


def test_types_that_two_files_share():
    merge = lambda a, b: st.merged_type(*(T._parse_datatype_string(f"x {t}")["x"].dataType for t in (a, b))).simpleString()
    assert merge("bigint", "bigint") == "bigint" and merge("bigint", "double") == "double" and merge("string", "bigint") == "string"
    assert merge("array<bigint>", "array<double>") == "array<double>" and merge("struct<b:bigint>", "struct<a:string,b:string>") == "struct<a:string,b:string>"
    assert st.merged_type(T.NullType(), T.LongType()) == T.LongType() == st.merged_type(T.LongType(), T.NullType())


def test_csv_stream_keeps_quoted_line_breaks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'one "line"\nand another'), (2, "plain"), (3, ""), (4, None)], "id int, v string").coalesce(1)
    arrived, out = str(tmp_path / "in.csv"), str(tmp_path / "out")
    st.write_table(rows, arrived)
    stream = incremental.read_stream(spark, arrived, rows.schema, "csv")
    incremental.start(stream, [], out, str(tmp_path / "checkpoint")).awaitTermination()
    got = spark.read.parquet(out).select("id", "v")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, st.read_table(spark, arrived, schema=rows.schema).data.collect())) == sorted(map(tuple, rows.collect()))


@pytest.fixture
def small_splits(spark):
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", saved[0])
    spark.conf.set("spark.sql.files.openCostInBytes", saved[1])


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_one_file_with_quoted_line_breaks_is_read_by_many_tasks(spark, tmp_path, small_splits, ending):
    r = random.Random(11)
    folder = tmp_path / "big.csv"
    folder.mkdir()
    for name in ("a", "b"):
        with open(folder / f"{name}.csv", "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, lineterminator=ending)
            writer.writerow(["id", "the text", "number"])
            for k in range(120):
                text = "".join(r.choice(["é", "word ", '"', "\n", ",", "漢"]) for _ in range(r.choice([0, 3, 10, 150])))
                writer.writerow([k, text, r.choice(["", "1.5", "7"])])
    schema = "id int, `the text` string, number double"
    whole = st.read_csv(spark, str(folder), schema=schema, split=False)
    parts = st.read_csv(spark, str(folder), schema=schema)  # the files are larger than two splits
    assert parts.parts and parts.data.rdd.getNumPartitions() > 20
    assert sorted(map(str, parts.data.collect())) == sorted(map(str, whole.data.collect())) and parts.data.count() == 240
    assert {(r["file_name"], r["rows"]) for r in parts.files().collect()} == {("a.csv", 120), ("b.csv", 120)}
    inferred = st.read_csv(spark, str(folder)).data
    assert inferred.dtypes == st.read_csv(spark, str(folder), split=False).data.dtypes and inferred.count() == 240


def test_records_of_odd_files(spark, tmp_path, small_splits):
    (tmp_path / "one.csv").write_text("a,b\n")
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "open.csv").write_text('a,b\n1,x\n\n2,"never closed\n' + "3,y\n" * 60)
    (tmp_path / "long.csv").write_text('a,b\n1,"' + "line\n" * 200 + '"\n2,z')
    for name, count in (("one", 0), ("none", 0), ("open", 2), ("long", 2)):
        assert st.read_csv(spark, str(tmp_path / f"{name}.csv"), schema="a int, b string", split=True).data.count() == count, name
    long = st.read_csv(spark, str(tmp_path / "long.csv"), schema="a int, b string", split=True).data.where("a = 1").first()
    assert long["b"] == "line\n" * 200


def test_increments_need_frozen_ranks(spark):
    base = spark.createDataFrame([(float(v),) for v in range(1, 101)], "x double")
    fit = {"x": tf.ScaleFit(1.0, 100.0, 0.0, 100.0, "percentile")}
    part = spark.createDataFrame([(10.0,), (10.5,), (0.0,), (500.0,), (None,)], "x double")
    with tf.increments(), pytest.raises(ValueError):
        tf.apply_scales(part, fit)
    frozen = tf.freeze_scales(base, fit)
    with tf.increments():
        got = sorted((r["x"] is None, r["x"]) for r in tf.apply_scales(part, frozen).collect())
    assert [round(x, 6) for none, x in got if not none] == [0.0, 10.0, 10.0, 100.0] and got[-1][0]


def test_unknown_transforms_are_refused(spark):
    with pytest.raises(ValueError, match="unknown transform"):
        tf.apply_transforms(spark.range(1), {"id": "id"}, {"id": tf.Transform("no_such")})


def test_one_csv_file_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "COPY_BYTES", 50)
    rows = spark.range(40, numPartitions=5).selectExpr("CAST(id AS INT) AS a", "CASE WHEN id % 3 = 0 THEN NULL ELSE concat('é\n\"', id) END AS `b, \"c`")
    monkeypatch.setattr(type(rows), "coalesce", lambda *_: pytest.fail("one task writes all rows"))
    path = st.write_one_csv(rows, str(tmp_path / "one.csv"))
    assert len([f for f in os.listdir(path) if not f.startswith(".")]) == 1
    for split in (True, False):
        assert sorted(map(tuple, st.read_csv(spark, path, schema=rows.schema, split=split).data.collect())) == sorted(map(tuple, rows.collect()), key=lambda r: r[0])
    assert st.read_csv(spark, path, split=True).data.columns == rows.columns
    empty = st.write_one_csv(rows.limit(0), str(tmp_path / "none.csv"))
    assert st.read_csv(spark, empty, schema=rows.schema, split=True).data.count() == 0
    with pytest.raises(FileExistsError):
        st.write_one_csv(rows, path)
