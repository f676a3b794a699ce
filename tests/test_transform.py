import pytest
from pyspark.sql import functions as F

from tablemeld.functions import casts, names, scales, text, values
from tablemeld.operators import facts as fa, joins, transform as tf


def column(spark, items, kind, change):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(change(F.col("v")).alias("r")).collect()]


def test_value_map_keeps_nulls_and_unknown_values(spark):
    found = column(spark, ["VL", "x", None], "string", lambda c: values.value_map(c, {"VL": "Very Likely"}))
    assert found == ["Very Likely", "x", None]
    found = column(spark, [1, 2, None], "int", lambda c: values.value_map(c, {"1": "one"}, "other"))
    assert found == ["one", "other", None]


def test_long_map_joins_with_and_without_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "i int, v string")
    mapping = spark.createDataFrame([("a", "A"), ("a", "A"), ("b", "B")], "raw string, canonical string")
    for limit in (100, 0):
        monkeypatch.setattr(joins, "BROADCAST_ROWS", limit)
        found = {r["i"]: r["v"] for r in tf.map_values(df, "v", mapping).collect()}
        assert found == {1: "A", 2: "z", 3: None}


def test_codes(spark):
    assert column(spark, [" New York", "na", "Paris"], "string", values.region_code) == ["US-NY", "NA", "PARIS"]
    assert column(spark, ["Uk", "USA", "España", "Belgium", None], "string", values.country_code) == [
        "GB", "US", "ES", "BELGIUM", None,
    ]
    assert column(spark, ["1", "E-Cigarette", "Fax Line"], "string", values.category_code) == [
        "ACTIVE", "VAPE", "fax line",
    ]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("Tom &amp; <b>Jerry</b>", "Tom Jerry"),
        ("  café   ☕ #1! ", "caf 1"),
        ("a - b/c > d", "a > b > c d"),
        ("35-44", "35 > 44"),
        ("plain text", "plain text"),
        ("a\x1cb c", "a bc"),
        ("☕", None),
        ("", None),
        (None, None),
    ],
)
def test_clean_text(spark, raw, expected):
    assert column(spark, [raw], "string", text.clean_text) == [expected]


def test_clean_text_matches_a_plain_python_reading(spark):
    import re

    def reading(v):
        v = re.sub(r"<[^>]+>", " ", re.sub(r"&[a-zA-Z]+;", " ", v)).encode("ascii", "ignore").decode()
        v = re.sub(r"\s+", " ", re.sub(r"[^\w\s\-.,'\"/()]", "", v)).strip()
        return re.sub(r"\s*[>\-/]\s*", " > ", v) or None

    items = ["<a title=\"&lt;\">x</a>", "a&nbsp;b", "-", "x /  y", "tab\there", "<&gt;>q", "(ok) 'yes', \"no\"", "_", "1,5"]
    assert column(spark, items, "string", text.clean_text) == [reading(v) for v in items]


def test_string_steps_know_accents(spark):
    found = column(spark, ["  Él, ño! "], "string", lambda c: text.standardize(c, ["strip", "lowercase", "replace_special"]))
    assert found == ["él ño"]


def test_wave_labels(spark):
    items = ["Wave 1 2024", "2024-W1", "Q1 2024", "2024Q1", "spring"]
    assert column(spark, items, "string", text.wave_label) == ["W1_2024", "W1_2024", "Q1_2024", "Q1_2024", "spring"]


def test_casts_never_fail(spark):
    items = ["5", " 3.0 ", "3.7", "1e3", "5d", "x", None, "9007199254740993"]
    assert column(spark, items, "string", lambda c: casts.cast_to(c, "integer")) == [
        5, 3, None, 1000, None, None, None, 9007199254740993,
    ]
    assert column(spark, items[:6], "string", lambda c: casts.cast_to(c, "float")) == [5.0, 3.0, 3.7, 1000.0, None, None]
    assert column(spark, ["true", "maybe", None], "string", lambda c: casts.cast_to(c, "boolean")) == [True, None, None]


@pytest.mark.parametrize(
    "raw, pattern, expected",
    [
        ("25/12/2024", "d/M/yyyy", "2024-12-25"),
        ("5/7/2024", "d/M/yyyy", "2024-07-05"),
        ("2024-02-31", "yyyy-M-d", None),
        ("20240601", "yyyyMMdd", "2024-06-01"),
        ("2024-06-01 10:20:30", None, "2024-06-01"),
        ("12/25/2024", None, "2024-12-25"),
        ("25/12/2024", None, "2024-12-25"),
        ("2024-06-01T10:20:30", None, "2024-06-01"),
        ("soon", None, None),
    ],
)
def test_dates(spark, raw, pattern, expected):
    assert column(spark, [raw], "string", lambda c: casts.format_date(c, pattern)) == [expected]


def test_date_columns_are_found_by_share(spark):
    df = spark.createDataFrame(
        [("2024 > 06 > 01", "x", "01/02/2024"), ("2024 > 06 > 02", "y", None), (None, "z", None)],
        "survey_date string, update_note string, start_time string",
    )
    repaired = tf.repair_separators(df)
    patterns = tf.fit_dates(repaired)
    assert patterns == {"survey_date": "yyyy-M-d"}  # one third of start_time parses
    assert [r[0] for r in tf.standardize_dates(repaired, patterns).collect()] == ["2024-06-01", "2024-06-02", None]


def test_scales(spark):
    assert column(spark, [1.0, 3.0, 5.0, None], "double", lambda c: scales.fixed(c, "1-5")) == [0.0, 50.0, 100.0, None]
    assert column(spark, [1.0, 4.0], "double", lambda c: scales.fixed(c, "1-7")) == [0.0, 50.0]
    assert column(spark, [9, 7, 6, None], "int", scales.nps_category) == ["Promoter", "Passive", "Detractor", None]
    bands = [(0.0, 1.05), (1.0, 5.05)]
    assert column(spark, [0.5, 3.0, 9.0], "double", lambda c: scales.piecewise(c, bands)) == [
        pytest.approx(0.5 / 1.05 * 100), pytest.approx(2 / 4.05 * 100), 9.0,
    ]


def test_scale_methods_are_chosen_from_the_data(spark):
    df = spark.createDataFrame([(float(i % 5), 1.0 * (i if i else 10_000)) for i in range(200)], "a double, b double")
    fits = tf.fit_scales(df, {"a": (0.0, 100.0), "b": (0.0, 100.0)})
    assert fits["a"].method == "linear" and fits["b"].method == "percentile"
    assert tf.fit_scales(df, {"a": (0.0, 4.0)}) == {}  # already on the scale
    out = tf.apply_scales(df, fits)
    assert out.columns == ["a", "b"] and out.count() == 200
    assert out.agg(F.max("b")).first()[0] == 100.0


def test_numeric_text_above_the_share(spark):
    df = spark.createDataFrame([("1", "1")] * 9 + [("n/a", "x")] * 1 + [("2", None)] * 2, "a string, b string")
    assert tf.fit_numeric(df) == ["a"]
    assert tf.to_numeric(df, ["a"]).agg(F.sum("a")).first()[0] == 13.0


def test_lookup_join_keeps_rows_of_hot_and_null_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(i, 7 if i % 3 == 0 else None if i % 3 == 1 else i) for i in range(300)], "i int, k int")
    table = rows.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    monkeypatch.setattr(joins, "HOT_KEYS", 1)
    small = joins.lookup_join(rows, table, ["k"], weight="n")
    large = joins.lookup_join(rows, table, ["k"], weight="n", max_rows=0)
    assert sorted(map(tuple, small.collect()), key=lambda r: r[0]) == sorted(map(tuple, large.collect()), key=lambda r: r[0])
    assert large.count() == 300


def test_names():
    assert names.standardized(["My Col", "my col", "MY-COL", "my_col"]) == ["my_col", "my_col_2", "mycol", "my_col_3"]
    assert names.snake_case("respondentID code") == "respondent_id_code"
    assert names.deduplicated(["a", "a", "b", "a"]) == ["a", "a_dup1", "b", "a_dup2"]
    assert names.loosely_equal("Resp-ID", ["respondent", "resp_id_x"]) and not names.loosely_equal("age", ["gender"])
    assert names.similarity("AGE", "age") == 1.0 and names.similarity("", "age") == 0.0


def test_projections(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    out, sources, warnings = tf.project_mapping(df, [("a", "x"), ("b", "x"), ("c", "UNMAPPED"), ("d", "y")])
    assert out.columns == ["x"] and sources == {"x": "a"} and len(warnings) == 3
    out = tf.apply_decisions(df, {"a": {"action": "skip"}, "b": {"target": "z"}, "c": {"target": "z"}})
    assert out.columns == ["z", "c"]
    out, added = tf.add_required(df, [("w", "float", "1.5"), ("a", "string", None)])
    assert added == ["w"] and out.first()["w"] == 1.5
    assert tf.reorder(out, ["w", "c", "q"]).columns == ["w", "c", "a", "b"]
    snake, table = tf.snake_case_names(df.toDF("fooBar", "B c", "d"))
    assert snake.columns == ["foo_bar", "b_c", "d"] and table.count() == 3


def test_transform_registry_and_samples(spark):
    df = spark.createDataFrame([(2, "b "), (1, " a"), (3, None)], "k int, v string")
    tf.register_transform("bang", lambda c, o: F.concat(c, F.lit(o["mark"])))
    out = tf.apply_transforms(df, {"v": "v", "n": "k"}, {"v": tf.Transform("bang", {"mark": "!"}), "n": tf.Transform("custom", {"sql": "k * 2"})})
    assert {(r["v"], r["n"]) for r in out.collect()} == {("b !", 4), (" a!", 2), (None, 6)}
    sample = tf.transform_samples(df, "v", tf.Transform("string_standardize"), ["k"], 1).first()
    assert (sample["original"], sample["transformed"]) == (" a", "a")


def test_facts_feed_fixed_scale_choice(spark):
    df = spark.createDataFrame([(1, 0, 9), (5, 10, 11)], "likert int, nps int, other int")
    facts = fa.fit_facts(df)
    assert tf.fixed_scale_columns(facts, "1-5") == ["likert"]
    assert tf.fixed_scale_columns(facts, "nps") == ["likert", "nps"]
    assert tf.convert_scale(df, "1-5").first()["likert"] == 0.0
