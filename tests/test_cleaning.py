import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablemeld.operators import impute as im, joins, memory as me, validate as va
from tablemeld.sources import metadata as md


def test_typed_imputation(answers):
    filled, summary = im.impute_typed(answers, "s")
    rows = {r["column"]: r for r in summary.collect()}
    # 1000 makes the score skewed, so its median fills; a fractional mean widens nps
    assert rows["score"]["strategy"] == "median" and rows["score"]["fill_value"] == "45.0"
    assert rows["nps"]["strategy"] == "mean" and rows["nps"]["missing_count"] == 1
    assert rows["gender"]["fill_value"] == "F" and rows["country"]["fill_value"] == "USA"
    assert filled.count() == answers.count() and filled.dropna().count() == filled.count()
    assert dict(filled.dtypes)["nps"] == "double"


def test_skewness_correction_matches_pandas(spark):
    from tablemeld.operators.facts import fit_facts, fit_skewness

    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 10.0)], "x double")
    assert fit_skewness(df, fit_facts(df), ["x"])["x"] == pytest.approx(pd.Series([1, 2, 3, 10]).skew())


def test_strategies_drop_and_fill(answers):
    plan = im.fit_strategies(
        answers, {"score": "Replace with 0", "country": "Drop column", "gender": "Remove rows", "nps": "Keep missing"}
    )
    out = im.apply_plan(answers, plan)
    assert "country" not in out.columns and out.count() == 6
    assert out.where("respondent_id = 3").first()["score"] == 0.0
    assert out.where("nps IS NULL").count() == 1
    assert out.where("survey_date = 'Unknown'").count() == 1
    assert im.apply_plan(answers, im.fit_strategies(answers, {c: "Keep missing" for c in answers.columns}, remove_any=True)).count() == 4


def test_all_null_numeric_falls_back_to_zero(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert im.apply_plan(df, im.fit_strategies(df)).first()["x"] == 0.0


@pytest.fixture(scope="module")
def brand(spark):
    return spark.createDataFrame(
        [(1, 1, 1.0, 3.0), (2, 0, None, None), (3, 1, None, 5.0), (4, None, None, 1.0)],
        "rid int, aware int, usage double, affinity double",
    )


RULES = im.skip_rules({"filters": [{"if": {"aware": 0}, "then_null": ["usage", "affinity"]}]})


def test_skip_logic_separates_valid_nulls(brand):
    found = {(r["row_id"], r["column"]): r["null_class"] for r in im.classify_nulls(brand, "rid", RULES).collect()}
    assert found == {
        (2, "usage"): "valid", (2, "affinity"): "valid", (3, "usage"): "uncertain",
        (4, "aware"): "uncertain", (4, "usage"): "uncertain",
    }


def test_masked_imputation_equals_skip_logic(brand):
    strategies = {"usage": "zero", "affinity": "mean", "aware": "mode"}
    nulls = im.classify_nulls(brand, "rid", RULES)
    masked = im.impute_masked(brand, "rid", strategies, nulls.where("null_class = 'valid'"))
    direct = im.impute_with_skip_logic(brand, strategies, RULES)
    assert sorted(map(tuple, masked.collect()), key=str) == sorted(map(tuple, direct.collect()), key=str)
    assert masked.where("rid = 2").first()["usage"] is None
    assert masked.where("rid = 4").first()["usage"] == 0.0


def test_masked_imputation_of_listed_cells_and_removal(brand):
    listed = brand.sparkSession.createDataFrame([(3, "usage")], "row_id int, column string")
    out = im.impute_masked(brand, "rid", {"usage": "zero", "aware": "remove"}, None, listed)
    assert {r["rid"]: r["usage"] for r in out.collect()} == {1: 1.0, 2: None, 3: 0.0}
    with pytest.raises(ValueError):
        im.fit_codes(brand, {"usage": "guess"})


@pytest.mark.parametrize("broadcast_rows", [200_000, 3])
def test_masks_of_many_columns_and_rows_without_id(spark, monkeypatch, broadcast_rows):
    """A third of the rows have no id, a third have one and the same; masks of both kinds over more columns than a word holds."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", broadcast_rows)
    r = random.Random(6)
    names = [f"c{k}" for k in range(40)]
    ids = [None, 7, None]
    rows = [(ids[k % 3] if k % 3 < 2 else 100 + k, k, *[r.choice([None, 1.0, 2.0]) for _ in names]) for k in range(90)]
    df = spark.createDataFrame(rows, "rid int, k int, " + ", ".join(f"{c} double" for c in names))
    cells = [(r.choice([None, 7, *range(100, 190)]), r.choice(names)) for _ in range(900)]
    valid, uncertain = cells[:400], cells[400:] + [(None, "other"), (7, "other")]
    table = lambda x: spark.createDataFrame(x, "row_id int, column string")
    strategies = {c: "zero" for c in names[:-1]} | {names[-1]: "remove"}
    out = im.impute_masked(df, "rid", strategies, table(valid), table(uncertain))
    assert out.columns == df.columns
    mentioned = {c for _, c in uncertain}
    valid_set, listed = {x for x in valid if x[0] is not None}, {x for x in uncertain if x[0] is not None}
    want = []
    for rid, k, *values in rows:
        if values[-1] is None and (rid, names[-1]) not in valid_set:
            continue
        filled = [0.0 if v is None and s == "zero" and (rid, c) not in valid_set and (c not in mentioned or (rid, c) in listed) else v for (c, s), v in zip(strategies.items(), values)]
        want.append((rid, k, *filled))
    assert sorted(map(tuple, out.collect()), key=lambda x: x[1]) == want


def test_fallback_only_when_nothing_improved(answers):
    assert im.fallback_clean(answers, answers).where("gender = 'Unknown'").count() == 1
    better = answers.fillna({"score": 0.0})
    assert im.fallback_clean(answers, better).where("gender IS NULL").count() == 1


def test_dictionary_suggestions_and_reconciliation(spark, answers):
    found = im.dictionary_suggestions(
        answers,
        {"score": {"data_type": "float", "min": 0, "max": 100, "impute_strategy": "median"}, "gender": {"data_type": "categorical", "allowed_values": ["M"]}},
    )
    rows = {r["column"]: r for r in found.collect()}
    assert rows["score"]["out_of_range"] == 1 and rows["score"]["strategy"] == "Replace with MEDIAN"
    assert rows["gender"]["not_allowed"] == 4
    proposals = spark.createDataFrame([("gender", "unknown")], "column string, strategy string")
    merged = {r["column"]: (r["strategy"], r["origin"]) for r in im.reconcile_strategies(proposals, found.select("column", "strategy")).collect()}
    assert merged == {"gender": ("Replace with 'Unknown'", "proposal"), "score": ("Replace with MEDIAN", "dictionary")}


def test_overrides_replay_the_latest(spark, tmp_path):
    for strategy in ("Replace with 0", "Replace with MEAN"):
        me.append(me.override_rows(spark, {"score": strategy}, "user"), str(tmp_path), "imputation_overrides")
    history = me.load(spark, str(tmp_path), "imputation_overrides")
    assert history.count() == 2 and me.replay_overrides(history) == {"score": "Replace with MEAN"}


def test_record_flags(answers):
    rules = md.rules(
        {"rules": [
            {"column": "score", "min": 15, "max": 100}, {"column": "gender", "required": True},
            {"column": "country", "allowed_values": ["USA", "France"]}, {"column": "absent", "min": 1},
            {"min_records": 10}, {"max_records": 3},
        ]}
    )
    flags = va.apply_rules(answers, rules, "s", va.record_id_column(answers))
    assert flags.columns == ["dataset", "record_id", "column", "issue_type", "details"]
    found = {(r["record_id"], r["column"], r["issue_type"]): r["details"] for r in flags.collect()}
    assert found == {
        ("1", "score", "below_min"): "Value 10.0 below min 15",
        ("7", "score", "above_max"): "Value 1000.0 above max 100",
        ("4", "gender", "required_missing"): "Required value missing",
        ("2", "country", "invalid_value"): "Value uk  not in allowed list",
        ("4", "country", "invalid_value"): "Value España not in allowed list",
        ("7", "country", "invalid_value"): "Value Chile not in allowed list",
        (None, None, "min_records"): "Dataset has 7 rows, minimum is 10",
        (None, None, "max_records"): "Dataset has 7 rows, maximum is 3",
    }


def test_long_allowed_lists_join(spark, answers, monkeypatch):
    monkeypatch.setattr(va, "IN_LIST_VALUES", 1)
    for limit in (100, 0):
        monkeypatch.setattr(joins, "BROADCAST_ROWS", limit)
        flags = va.record_flags(answers, [va.Rule("country", allowed_values=("USA", "France"))], "s", "respondent_id")
        assert {r["record_id"] for r in flags.collect()} == {"2", "4", "7"}


def test_missing_flags(answers):
    df = answers.withColumn("gone", F.lit(None).cast("int"))
    found = {r["column"]: (r["issue_type"], r["details"]) for r in va.missing_flags(df, "s").collect()}
    assert found["gone"] == ("structural_missing", "100.0% missing")
    assert found["score"] == ("random_missing", "14.3% missing")
    rows = {r["record_id"]: r["details"] for r in va.row_missing_flags(answers, "s", "respondent_id").collect()}
    assert rows == {"2": "2 fields missing", "3": "2 fields missing", "4": "1 fields missing"}
    assert va.row_missing_flags(answers, "s", "respondent_id", 1).first()["record_id"] == "2"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Minimum 100 records per market", {"min_records": 100}),
        ("min 30 records", {"min_records": 30}),
        ("column: score between -5 and 10.5", {"column": "score", "min": -5.0, "max": 10.5}),
        ("Column 'Q1' range 1 to 5", {"column": "Q1", "min": 1.0, "max": 5.0}),
        ("column gender is required", {"column": "gender", "required": True}),
    ],
)
def test_text_rules(text, expected):
    rule = va.parse_text_rule(text)
    assert {k: getattr(rule, k) for k in expected} == expected


def test_unreadable_text_rule():
    assert va.parse_text_rule("be nice") is None


def test_business_issues(answers):
    found = {r["column"]: r for r in va.business_issues(answers, ["column: SCORE between 0 and 100", "column: gender not null", "minimum 50 records"]).collect()}
    assert found["score"]["affected_rows"] == 1 and found["score"]["severity"] == "fixable"
    assert found["gender"]["description"].endswith("has 1 null values")
    assert found[None]["description"].endswith("Found 7 records.")
