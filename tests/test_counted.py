"""Counted tables, their store, and segments with snapshots."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tablemeld.operators import counted, facts as fa, levels as lv, memory as me, ranks
from tablemeld.operators.counted import Counts, CountStore
from tablemeld.sources.segments import Segments

SCHEMA = "id bigint, small int, price double, cost decimal(12,2), name string, day date, yes boolean, none double"


def rows(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        out.append((
            10**9 + i, r.choice([1, 2, 2, 3, None]), r.choice([r.gauss(50, 20), r.expovariate(1e-6), -0.0, 0.0, None, math.nan]),
            None if i % 7 == 0 else f"{r.randrange(10**6) / 100:.2f}", r.choice(["a", "bb", "", "ccc", None]), r.choice(["2024-01-01", "2023-06-05", None]), r.choice([True, False, None]), None,
        ))
    return out


def frame(spark, data):
    raw = SCHEMA.replace("decimal(12,2)", "string").replace("date", "string")
    return spark.createDataFrame(data, raw).select("id", "small", "price", F.col("cost").cast("decimal(12,2)"), "name", F.col("day").cast("date"), "yes", "none")


def same_facts(mine, theirs):
    assert mine.keys() == theirs.keys()
    for c, fact in theirs.items():
        for field, value in vars(fact).items():
            got = getattr(mine[c], field)
            assert got == value or got == pytest.approx(value, rel=1e-9), (c, field)


@pytest.mark.parametrize("picked,rounds,buckets", [(200_000, 4, 4096), (3, 8, 4), (3, 1, 2), (0, 0, 4)])
def test_counts_answer_as_the_rows_do(spark, monkeypatch, picked, rounds, buckets):
    for name, value in {"PICKED": picked, "ROUNDS": rounds, "BUCKETS": buckets}.items():
        monkeypatch.setattr(counted, name, value)
    data = rows(400)
    df = frame(spark, data)
    counts = Counts.of(df)
    facts = fa.fit_facts(df)
    same_facts(counts.facts(), facts)
    numeric = [c for c, f in facts.items() if f.numeric]
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = counts.quantiles({c: shares for c in numeric})
    want = fa.exact_quantiles(df, {c: shares for c in numeric}, facts)
    for c in numeric:
        for p in shares:
            assert got[c][p] == want[c][p] or got[c][p] == pytest.approx(want[c][p], rel=1e-12), (c, p)
    price = sorted(p for _, _, p, *_ in data if p is not None and not math.isnan(p))
    assert got["price"][0.5] == pytest.approx(statistics.median(price))
    skew = fa.fit_skewness(df, facts, numeric)
    assert counts.skewness() == pytest.approx(skew, abs=1e-6)
    assert counts.modes() == {c: lv.modes(df, [c])[c] for c in df.columns}
    levels = {(r["column"], r["value"]): r["count"] for r in lv.level_counts(df).collect()}
    assert {(r["column"], r["value"]): r["count"] for r in counts.levels().collect()} == levels
    distinct = {c: len({v for k, v in levels if k == c}) for c in df.columns}
    assert counts.distinct() == distinct
    mine = {r["small"]: r["percentile_rank"] for r in counts.percentile_ranks("small").collect()}
    assert mine == {r["small"]: r["percentile_rank"] for r in ranks.percentile_ranks(df, "small").collect()}


@pytest.mark.parametrize("picked", [200_000, 2])
def test_infinite_and_extreme_numbers(spark, monkeypatch, picked):
    monkeypatch.setattr(counted, "PICKED", picked)
    values = [math.inf, -math.inf, 1e308, -1e308, 5e-324, 0.0, 1.0, 2.0, math.inf]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = Counts.of(df).quantiles({"x": [i / 8 for i in range(9)]})["x"]
    assert list(got.values()) == sorted(values)


def test_moments_of_long_numbers(spark):
    values = [10**15 + 7 * k for k in range(400)]
    fact = Counts.of(spark.createDataFrame([(v,) for v in values], "x bigint")).facts()["x"]
    assert fact.mean == statistics.mean(values) and fact.std == pytest.approx(statistics.stdev(values), rel=1e-12)


def test_counts_of_nothing(spark):
    empty = Counts.of(frame(spark, []))
    assert all(f.rows == 0 and f.mean is None for f in empty.facts().values())
    assert empty.medians() == dict.fromkeys(["id", "small", "price", "cost", "none"]) and empty.modes()["name"] is None
    assert empty.levels().count() == 0 and set(empty.distinct().values()) == {0}


def test_merged_counts_are_the_counts_of_all_rows(spark):
    data = rows(300, seed=3)
    whole = Counts.of(frame(spark, data))
    merged = Counts.of(frame(spark, data[:90])).merge(Counts.of(frame(spark, data[90:]).drop("yes")))
    same = sorted(tuple(r) for r in whole.table.filter("column <> 'yes'").select(F.to_json(F.struct("*"))).collect())
    assert sorted(tuple(r) for r in merged.table.filter("column <> 'yes'").select(F.to_json(F.struct("*"))).collect()) == same
    assert merged.quartiles() == whole.quartiles()
    other = Counts.of(spark.createDataFrame([("x",)], "small string"))
    with pytest.raises(ValueError, match="small is"):
        merged.merge(other)
    widened = Counts.of(spark.createDataFrame([(1.5,)], "small double")).merge(Counts.of(spark.createDataFrame([(2,)], "small int")))
    assert widened.facts()["small"].mean == 1.75 and widened.facts()["small"].kind == "float"


def test_store_counts_a_repeated_run_once(spark, tmp_path):
    data = rows(240, seed=4)
    store = CountStore(spark, str(tmp_path / "counts"))
    assert store.counts().types == {}
    store.add(frame(spark, data[:80]), "a/1")
    store.add(frame(spark, data[80:100]), "b")
    store.add(frame(spark, data[80:160]), "b")
    store.compact()
    assert store.segments.version() == 1 and store.segments.runs() == []
    store.add(frame(spark, data[:80]), "a/1")  # a late retry
    store.add(frame(spark, data[160:]), "c")
    assert store.segments.runs() == ["c"]
    whole = Counts.of(frame(spark, data))
    for _ in range(2):
        got = store.counts()
        same_facts(got.facts(), whole.facts())
        assert got.quartiles() == whole.quartiles() and got.types == whole.types
        store.compact()
    assert store.segments.version() == 2


def test_segments_that_are_not_complete_are_not_read(spark, tmp_path):
    table = Segments(spark, str(tmp_path / "t"), "k bigint")
    assert table.load().count() == 0 and table.compact() == 0
    table.append(spark.range(3).withColumnRenamed("id", "k"), "one")
    (tmp_path / "t" / "log" / "run=two").mkdir()  # a run that wrote nothing yet
    (tmp_path / "t" / "commits" / "1").mkdir(parents=True)  # a snapshot that was not finished
    assert table.version() == 0 and table.load().count() == 3
    assert table.compact() == 1 and table.load().count() == 3
    table.append(spark.range(5).withColumnRenamed("id", "k"), "two")
    assert table.load().count() == 8 and table.compact(lambda d: d.distinct()) == 2
    assert table.load().count() == 5 and table.compact() == 2


def test_learned_tables_keep_the_last_rows_in_a_snapshot(spark, tmp_path):
    for run, strategy in enumerate(["mean", "median", "mode"]):
        me.append(me.override_rows(spark, {"score": strategy}, "user"), str(tmp_path), "imputation_overrides", f"run {run}")
    assert me.compact(spark, str(tmp_path), "imputation_overrides", only_latest=True) == 1
    assert [r["strategy"] for r in me.load(spark, str(tmp_path), "imputation_overrides").collect()] == ["mode"]
