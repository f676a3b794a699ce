import random
import statistics

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tablemeld import columns as cols
from tablemeld.operators import facts as fa, levels as lv, products, profile as pr, quality as ql, ranks
from tests import samples


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_statistics_of_a_table_with_gaps(answers):
    rows = by_column(pr.column_statistics(answers))
    score = rows["score"]
    assert (score["total_count"], score["null_count"], score["null_pct"]) == (7, 1, 14.29)
    assert score["unique_count"] == 5 and score["unique_pct"] == 83.33
    assert score["mean"] == pytest.approx(195.0)
    assert score["median"] == 45.0
    assert score["std"] == pytest.approx(statistics.stdev([10, 20, 40, 50, 50, 1000]))
    assert rows["nps"]["inferred_type"] == "integer"  # a nullable integer stays an integer
    assert (rows["country"]["min_length"], rows["country"]["max_length"]) == (3, 6)


def test_approximate_statistics_agree_on_small_data(answers):
    exact, rough = by_column(pr.column_statistics(answers)), by_column(pr.column_statistics(answers, approx=True))
    for name in answers.columns:
        assert exact[name]["unique_count"] == rough[name]["unique_count"]


@pytest.mark.parametrize("max_levels", [3, 40, 50_000])
def test_exact_quantiles_at_every_bracket_size(spark, max_levels):
    rng = random.Random(3)
    values = [rng.gauss(0, 1) for _ in range(5000)] + [7.5] * 2500 + [None] * 50
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    wanted = [0.0, 0.01, 0.25, 0.5, 0.66, 0.75, 0.99, 1.0]
    found = fa.exact_quantiles(df, {"x": wanted}, fa.fit_facts(df), max_levels)["x"]
    expected = pd.Series(values).quantile(wanted)
    for p in wanted:
        assert found[p] == pytest.approx(expected[p], abs=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60))
def test_quantiles_match_pandas(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    found = fa.exact_quantiles(df, {"x": [0.25, 0.5]}, fa.fit_facts(df), 2)["x"]
    expected = pd.Series(values).quantile([0.25, 0.5])
    assert found[0.25] == pytest.approx(expected[0.25]) and found[0.5] == pytest.approx(expected[0.5])


def test_all_null_and_empty_tables(spark):
    df = spark.createDataFrame([(None, None)], "a double, b string")
    rows = by_column(pr.descriptive_stats(df, "x"))
    assert rows["a"]["scale_consistency"] == "unknown" and rows["a"]["outlier_count"] == 0
    assert rows["a"]["median"] is None and rows["b"]["mode"] is None
    empty = spark.createDataFrame([], "a double, b string")
    assert by_column(pr.column_statistics(empty))["a"]["null_pct"] == 0.0
    assert ql.quick_assessment(empty).first()["rows"] == 0


def test_modes_and_top_values_break_ties_by_smallest(spark):
    df = spark.createDataFrame([(10, "b"), (9, "a"), (10, "a"), (9, "b")], "n int, t string")
    assert lv.modes(df, ["n", "t"]) == {"n": "9", "t": "a"}
    top = lv.top_values(lv.level_counts(df, ["t"]), 1).collect()
    assert [(r["value"], r["count"]) for r in top] == [("a", 2)]


def test_top_values_are_limited_before_the_shuffle(answers):
    plan = lv.top_values(lv.level_counts(answers), 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_levels_of_both_zeros_are_one(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,)], "x double")
    assert [(r["value"], r["count"]) for r in lv.level_counts(df).collect()] == [("0.0", 2)]


def test_descriptive_statistics_known_values(spark):
    # satisfaction answers of the null-bearing survey fixture: mean 48.125, median 46.5
    scores = [30, 55, 21, 55, 15, 74, 15, 92, 80, 38, 23, 87, 43, 50, 76, 16]
    df = spark.createDataFrame([(v,) for v in [*scores, None, None, None, None]], "score int")
    row = pr.descriptive_stats(df, "x").first()
    series = pd.Series(scores)
    assert row["mean"] == pytest.approx(series.mean()) and row["median"] == series.median()
    assert row["missing_pct"] == 20.0 and row["std"] == pytest.approx(series.std())
    assert row["mode"] == "15.0" and row["scale_consistency"] == "0-100"


def test_correlations_skip_nulls_per_pair(spark):
    rows = [(1.0, 2.0, None), (2.0, 1.0, 3.0), (3.0, 5.0, 1.0), (4.0, None, 0.0), (5.0, 9.0, 7.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    expected = pd.DataFrame(rows, columns=list("abc"), dtype=float).corr()
    for r in pr.correlations(df, None).collect():
        assert r["correlation"] == pytest.approx(expected.loc[r["column_a"], r["column_b"]])


def test_missing_patterns(answers):
    assert {r["missing_fields"]: r["rows"] for r in pr.missing_histogram(answers).collect()} == {0: 4, 1: 1, 2: 2}
    counts = {r["column"]: r["missing_count"] for r in pr.missing_by_column(answers).collect()}
    assert counts == {"respondent_id": 0, "survey_date": 1, "country": 1, "gender": 1, "score": 1, "nps": 1}


def test_wide_table_in_several_jobs(spark):
    df = spark.range(20).select(*[(F.col("id") * i).alias(f"c {i}") for i in range(60)])
    rows = by_column(pr.column_statistics(df))
    assert len(rows) == 60 and rows["c 3"]["max"] == 57.0 and rows["c 0"]["unique_count"] == 1


@pytest.mark.parametrize("per_task", [5, 1000])
def test_percentile_rank_matches_pandas(spark, monkeypatch, per_task):
    rng = np.random.default_rng(1)
    values = [float(v) for v in rng.integers(0, 60, 400)] + [17.0] * 200 + [None] * 5
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, x double")
    monkeypatch.setattr(ranks, "LEVELS_PER_TASK", per_task)
    table = ranks.percentile_ranks(df, "x", per_task)
    found = {r["x"]: r["percentile_rank"] for r in table.collect()}
    expected = pd.Series(values).rank(pct=True)
    for v, e in zip(values, expected):
        if v is not None:
            assert found[v] == pytest.approx(e)


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a"), (2, "a"), (1, None)], "a int, b string")
    row = ql.duplicate_summary(df).first()
    assert (row["total_rows"], row["duplicate_rows"], row["severity"]) == (5, 2, "blocking")


def test_duplicates_without_broadcast(spark, monkeypatch):
    from tablemeld.operators import joins

    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1)
    df = spark.range(100).select((F.col("id") % 30).alias("a"))
    assert ql.count_duplicates(df) == 70


def test_quality_score_of_known_issue_counts(spark):
    # two blocking issues, eighteen warnings and 320.2 null percent over 17 columns
    statistics_ = spark.createDataFrame([(320.2 / 17,)] * 17, "null_pct double")
    issues = spark.createDataFrame([("blocking",)] * 2 + [("warning",)] * 18, "severity string")
    row = ql.quality_score(statistics_, issues).first()
    assert row["quality_score"] == pytest.approx(61.58235294117647)
    assert not row["is_acceptable"]
    assert row["recommendations"][0] == "2 blocking issues stand in the way of any further step"


def test_issues_and_report(spark):
    df = samples.survey(spark, 400)
    facts = fa.fit_facts(df)
    statistics_ = pr.column_statistics(df, facts=facts)
    issues = ql.detect_issues(df, statistics_, facts)
    kinds = {r["issue_type"] for r in issues.collect()}
    assert {"missing_values", "outliers", "duplicates"} <= kinds
    report = ql.quality_report(statistics_, issues)
    assert sum(r["issues"] for r in report["by_type"].collect()) == report["summary"].first()["total_issues"]


def test_small_samples_block(spark):
    issues = ql.detect_issues(spark.range(5).toDF("k"))
    assert ("insufficient_sample", "blocking") in {(r["issue_type"], r["severity"]) for r in issues.collect()}


def test_type_helpers(answers):
    counts = {r["data_type"]: r["columns"] for r in cols.type_counts(answers).collect()}
    assert counts == {"bigint": 1, "string": 3, "double": 1, "int": 1}
    assert cols.columns_like(answers, ["DATE", "nps"]) == ["survey_date", "nps"]


def test_nan_is_missing(spark):
    df = cols.nan_to_null(spark.createDataFrame([(float("nan"), 1), (2.0, 1)], "a double, b int"))
    assert by_column(pr.missing_by_column(df))["a"]["missing_count"] == 1


def test_quantile_rounds_are_bounded(spark, monkeypatch):
    calls = []
    counted = fa._count_brackets
    monkeypatch.setattr(fa, "_count_brackets", lambda df, bounds: calls.append(1) or counted(df, bounds))
    for rows, most in (([3, 1, 2], 4), (list(range(60)), 4), ([1.0] * 4000 + [1.0 + k * 1e-12 for k in range(3000)] + [1e300, -1e300], 8)):
        calls.clear()
        df = spark.createDataFrame([(float(v),) for v in rows], "x double")
        found = fa.exact_quantiles(df, {"x": [0.25, 0.5, 0.9]}, fa.fit_facts(df), 2)["x"]
        assert [found[p] for p in (0.25, 0.5, 0.9)] == pytest.approx(list(pd.Series(rows).quantile([0.25, 0.5, 0.9])), abs=0, rel=1e-15)
        assert len(calls) <= most


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,)], "x double")
    row = by_column(pr.column_statistics(df))["x"]
    assert row["null_count"] == 2 and row["mean"] == 1.5 and row["max"] in (2.0, "2.0") and row["median"] == 1.5


@pytest.mark.parametrize("block, fan_in, group", [(128, 64, 4096), (4, 2, 4096), (4, 2, 8)])
def test_products_of_many_columns_match_pairwise(spark, monkeypatch, block, fan_in, group):
    for name, value in {"BLOCK": block, "FAN_IN": fan_in, "GROUP": group}.items():
        monkeypatch.setattr(products, name, value)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 21)) @ rng.normal(size=(21, 21)) + 1e6
    x[:, 3] = 5.5  # constant
    x[rng.random(x.shape) < 0.2] = np.nan
    x[5, 7] = None
    x[:, 9] = np.nan
    x[10:, 11] = np.nan
    names = [f"c {k}" for k in range(21)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"`{c}` double" for c in names)).repartition(7)
    want = {}
    for i in range(21):
        for j in range(i + 1, 21):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            if len(a) > 1 and a.std() > 0 and b.std() > 0:
                want[names[i], names[j]] = np.corrcoef(a, b)[0, 1]
    got = {(r["column_a"], r["column_b"]): r["correlation"] for r in products.correlation_pairs(df, names).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())
    assert products.correlation_pairs(df.limit(0), names).count() == 0


def test_many_columns_take_one_scan(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(60, 40))
    spark.createDataFrame([tuple(r) for r in x.tolist()], ", ".join(f"c{k} double" for k in range(40))).write.parquet(str(tmp_path / "wide"))
    found = pr.correlations(spark.read.parquet(str(tmp_path / "wide")), 3).collect()
    best = sorted(((abs(np.corrcoef(x[:, i], x[:, j])[0, 1]), f"c{i}", f"c{j}") for i in range(40) for j in range(i + 1, 40)), reverse=True)[:3]
    assert [(r["column_a"], r["column_b"]) for r in found] == [b[1:] for b in best]
