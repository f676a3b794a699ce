import math
import random
import statistics
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablemeld import storage
from tablemeld.functions import fixed_values as fv, names
from tablemeld.functions.values import merge_value_maps
from tablemeld.operators import (
    calibrate as ca, compare as cp, generate as ge, joins, levels as lv, match as ma, memory as me, neighbours, partners, unkeyed,
)
from tablemeld.sources import metadata as md
from tablemeld.storage import materialize
from tablemeld.sources.metadata import value_map_table

SCHEMA = md.master_schema(
    {
        "schema_name": "survey", "version": 1.0,
        "columns": [
            {"name": "respondent_id", "data_type": "integer", "is_required": True, "aliases": ["resp_id", "id"]},
            {"name": "country", "data_type": "categorical", "aliases": ["market"]},
            {"name": "survey_date", "data_type": "datetime"},
            {"name": "score", "data_type": "float", "validation_rules": {"min_value": 0, "max_value": 100}},
        ],
    }
)


def columns_of(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "ord int, source_column string")


def test_match_precedence(spark):
    found = ma.match_columns(columns_of(spark, ["Resp_ID", "COUNTRY", "survey date", "csat_score", "zzz", "market"]), SCHEMA)
    rows = {r["source_column"]: (r["target_column"], r["confidence"], r["confidence_level"], r["requires_review"]) for r in found.collect()}
    assert rows == {
        "Resp_ID": ("respondent_id", 0.9, "high", False),
        "COUNTRY": ("country", 1.0, "high", False),
        "survey date": ("survey_date", 0.95, "high", False),
        "csat_score": ("score", 0.7, "medium", True),
        "zzz": ("UNMAPPED", 0.0, "uncertain", True),
        "market": ("country", 0.9, "high", False),
    }


def test_merge_prefers_higher_confidence(spark):
    rules = ma.match_columns(columns_of(spark, ["country", "csat_score", "zzz"]), SCHEMA)
    proposals = spark.createDataFrame(
        [("country", "respondent_id", 1.0, "x"), ("csat_score", "country", 0.9, "x"), ("zzz", "survey_date", 0.0, "x"), ("new", "score", 0.6, "x")],
        "source_column string, target_column string, confidence double, reason string",
    )
    rows = {r["source_column"]: r["target_column"] for r in ma.merge_mappings(rules, proposals).collect()}
    assert rows == {"country": "country", "csat_score": "country", "zzz": "survey_date", "new": "score"}


def test_drift_and_validation(spark):
    mappings = ma.match_columns(columns_of(spark, ["country", "zzz"]), SCHEMA)
    drift = ma.schema_drift(mappings, SCHEMA)
    row = drift.first()
    assert row["missing_columns"] == ["respondent_id"] and row["extra_columns"] == ["zzz"]
    assert row["drift_score"] == 0.75 and row["drift_severity"] == "blocking"
    result = ma.validation_result(mappings, drift).first()
    assert result["confidence_score"] == 0.5 and not result["is_valid"]
    assert result["validation_errors"] == ["Missing required columns: respondent_id"]
    complete = ma.match_columns(columns_of(spark, ["respondent_id", "country", "survey_date", "score"]), SCHEMA)
    assert ma.validation_result(complete, ma.schema_drift(complete, SCHEMA)).first()["is_valid"]
    diff = ma.schema_difference(columns_of(spark, ["country", "zzz"]), SCHEMA, "d").first()
    assert diff["missing_in_source"] == ["respondent_id", "score", "survey_date"] and diff["extra_in_source"] == ["zzz"]


def test_match_datasets(spark):
    left = spark.createDataFrame([(1, "US", 3.0), (2, "DE", 4.0), (3, None, 5.0)], "id int, market string, csat double")
    right = spark.createDataFrame([(1, "US", 3.5), (2, "FR", 4.5), (9, "DE", 5.5)], "key int, markets string, score double")
    rows = {r["source_column"]: r for r in ma.match_datasets(left, right).collect()}
    assert rows["market"]["target_column"] == "markets"
    assert rows["market"]["distribution_similarity"] == pytest.approx(2 / 3, abs=1e-3)
    expected = round(0.5 * names.similarity("market", "markets") + 0.3 * rows["market"]["distribution_similarity"], 3)
    assert rows["market"]["confidence"] == expected and rows["market"]["status"] == "review"
    labelled = ma.match_datasets(left, right, {"csat": "Satisfaction"}, {"score": "Satisfaction"})
    assert {r["source_column"]: r["label_similarity"] for r in labelled.collect()}["csat"] == 1.0
    single = ma.match_datasets(left, right, one_to_one=True)
    targets = [r["target_column"] for r in single.collect()]
    assert len(targets) == len(set(targets))


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, market string, x double")


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_calibration_moves_groups_to_reference(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", broadcast_rows)
    source = frame(
        spark,
        [(i, "A", float(i)) for i in range(10)] + [(100 + i, "B", 5.0) for i in range(6)]
        + [(200 + i, "C", float(i)) for i in range(3)] + [(300 + i, None, 1.0) for i in range(8)],
    )
    reference = frame(spark, [(i, m, 50.0 + 3 * i) for m in "ABC" for i in range(8)])
    out, report = ca.calibrate(source, reference, ["market"], ["id"])
    rows = out.collect()
    assert len(rows) == source.count() and out.columns == source.columns
    values = {m: [r["x"] for r in rows if r["market"] == m] for m in ("A", "B", "C", None)}
    target = [50.0 + 3 * i for i in range(8)]
    assert statistics.mean(values["A"]) == pytest.approx(statistics.mean(target))
    assert statistics.stdev(values["A"]) == pytest.approx(statistics.stdev(target))
    assert values["B"] == [pytest.approx(60.5)] * 6  # no spread: mean shift
    assert sorted(values["C"]) == [0.0, 1.0, 2.0] and values[None] == [1.0] * 8
    assert {(r["market"], r["method"]) for r in report.collect()} == {("A", "mean_std"), ("B", "mean_shift")}


def test_calibration_without_groups(spark):
    source = frame(spark, [(i, "A", float(i)) for i in range(10)])
    reference = frame(spark, [(i, "B", 10.0 * i) for i in range(10)])
    out, report = ca.calibrate(source, reference, [], ["id"])
    assert out.agg(F.avg("x")).first()[0] == pytest.approx(45.0)
    assert report.first()["group"] == "overall"
    assert ca.calibration_groups(source, reference) == ["market"]
    means = ca.market_comparison(source, reference, names=["x"])
    assert {(r["market"], r["dataset"]) for r in means.collect()} == {("A", "historical"), ("B", "current")}


def test_comparison_by_key(spark):
    before = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (3, "c", None), (4, "d", 4.0)], "k int, t string, old double")
    after = spark.createDataFrame([(1, "A", 1), (2, None, 1), (3, None, 1), (5, "e", 1)], "k int, t string, new int")
    rows = {r["column"]: r for r in cp.compare_tables(before, after, ["k"]).collect()}
    assert rows["t"]["values_changed"] == 2 and rows["t"]["change_pct"] == pytest.approx(66.67)
    summary = cp.compare_summary(before, after, ["k"]).first()
    assert (summary["keys_added"], summary["keys_removed"], summary["columns_added"], summary["columns_common"]) == (1, 1, 1, 2)
    preview = {r["k"]: r["changed_columns"] for r in cp.change_preview(before, after, ["k"], 2).collect()}
    assert preview == {1: ["t", "new", "old"], 2: ["new", "old"]}


def test_repeated_keys_do_not_multiply(spark):
    many = spark.range(3000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    other = many.unionByName(spark.createDataFrame([(2, 5)], "k int, v bigint"))
    assert cp.compare_summary(many, other, ["k"]).first()["repeated_keys"] == 1
    assert cp.compare_tables(many, other, ["k"]).first()["values_changed"] == 0


def test_generated_metadata(answers):
    made = ge.generate_metadata(answers, max_levels=4)
    rules = {r["column"]: r for r in made.rules.collect()}
    assert rules[None]["min_records"] == 10 and (rules["score"]["min"], rules["score"]["max"]) == (10.0, 1000.0)
    assert rules["gender"]["allowed_values"] == ["F", "M"] and "country" not in rules  # five countries
    standards = ge.standards_of(made.standards)
    assert standards["score"]["impute_strategy"] == "mean" and "allowed_values" not in standards["country"]
    maps = {(r["column"], r["raw"]): r["canonical"] for r in made.value_maps.collect()}
    assert maps["gender", "F"] == "F" and maps["age", "18 to 24"] == "18-24"
    headers = ge.schema_from_headers(answers.toDF("RespID", "Survey Date", "c", "g", "s", "n")).collect()
    assert [(r["name"], r["aliases"]) for r in headers][:2] == [("resp_id", ["RespID"]), ("survey_date", ["Survey Date"])]


def test_value_maps_merge():
    merged = merge_value_maps({"country": {"US": "America"}, "x": {"a": "b"}})
    assert merged["country"]["US"] == "America" and merged["country"]["FR"] == "France" and merged["x"] == {"a": "b"}
    assert merge_value_maps({"country": {"US": "America"}}, replace=True)["country"]["US"] == "USA"
    assert fv.MARKET_NAMES["UK"] == "UK"


def test_level_suggestions_ignore_known_levels(spark, answers):
    levels = lv.top_values(lv.level_counts(answers, ["country"]), 20)
    maps = value_map_table(spark, {"country": {"USA": "US", "France": "FR"}})
    found = {r["raw_value"]: r["suggested_value"] for r in me.level_suggestions(levels, maps, "s").collect()}
    assert found == {"uk ": "uk", "España": "España", "Chile": "Chile"}


def test_latest_and_upsert(spark):
    rows = spark.createDataFrame(
        [("t", "a", "x", 0.5, "review", 1), ("t", "a", "y", 0.9, "auto", 2), ("t", "b", "z", 0.9, "auto", 1)],
        "table_name string, source_column string, target_column string, confidence double, status string, s int",
    ).withColumn("timestamp", F.timestamp_seconds("s")).drop("s")
    assert {(r["source_column"], r["target_column"]) for r in me.latest(rows, me.KEYS["column_mappings"]).collect()} == {("a", "y"), ("b", "z")}
    updates = spark.createDataFrame([("a", "w", 1.0, "auto")], "source_column string, target_column string, confidence double, status string")
    merged = {r["source_column"]: r["target_column"] for r in me.upsert_mappings(rows, updates, "t").collect()}
    assert merged == {"a": "w", "b": "z"}


def test_format_fixes_replay(spark):
    df = spark.createDataFrame([("2024 > 06 > 01", "a > b")], "visit_date string, note string")
    fix = me.format_fix_row(spark, "nowhere", "date separator", "replace").withColumn("timestamp", F.current_timestamp())
    row = me.replay_format_fixes(df, fix).first()
    assert tuple(row) == ("2024-06-01", "a > b")
    own = me.format_fix_row(spark, "note", "wrong separator", "x").withColumn("timestamp", F.current_timestamp())
    assert me.replay_format_fixes(df, own).first()["note"] == "a-b"


def test_memory_text_and_confirmed_mappings(spark):
    mappings = spark.createDataFrame(
        [("a", "x", 0.9), ("", "y", 0.9), ("b", "UNMAPPED", 0.9), ("c", "z", 0.5)],
        "source_column string, target_column string, confidence double",
    )
    rows = me.memory_rows(me.learnable(mappings), F.lit("float")).collect()
    assert [r["text"] for r in rows] == ["a maps to x (type: float)"]
    found = me.confirmed_mappings(spark, {"a": {"target": "x"}, "b": {"action": "skip", "target": "y"}, "c": {"target": "UNMAPPED"}})
    assert [tuple(r) for r in found.collect()] == [("a", "x", 0.95, "user_confirmed")]


SMALL_CELLS = {"LEAF_ROWS": 9, "FAN": 4, "BLOCK_ROWS": 7, "DEPTH": 4}


def brute_nearest(memory, queries, k, threshold):
    """{(query, rank): memory row}, distances added up one pair at a time."""
    expected = {}
    for q, x in enumerate(queries):
        distance = [math.fsum(((x - m) ** 2).tolist()) for m in memory]
        order = sorted(range(len(memory)), key=lambda m: (distance[m], m))[:k]
        expected |= {(q, i + 1): m for i, m in enumerate(order) if 1 / (1 + distance[m]) >= threshold}
    return expected


def found_nearest(spark, memory, queries, k, threshold):
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(memory)], "memory_id bigint, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id bigint, vector array<double>")
    return {(r["query_id"], r["rank"]): r["memory_id"] for r in me.nearest(table, asked, k, threshold).collect()}


@pytest.mark.parametrize("small", [{}, SMALL_CELLS])
@pytest.mark.parametrize("threshold", [0.5, 0.0])
def test_nearest_matches_brute_force(spark, monkeypatch, small, threshold):
    for name, value in small.items():
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(5)
    memory = rng.integers(-6, 6, size=(120, 3)) * 0.25  # many ties
    memory[40:80] = memory[3]  # a third of the memory is one vector
    queries = np.vstack([memory[3], memory[3], rng.integers(-6, 6, size=(18, 3)) * 0.25])
    assert found_nearest(spark, memory, queries, 4, threshold) == brute_nearest(memory, queries, 4, threshold)


@pytest.mark.parametrize("small", [{}, SMALL_CELLS])
def test_nearest_far_from_the_origin(spark, monkeypatch, small):
    """Norms of 10^6 and distances below 1: products of whole vectors have no digits left for them."""
    for name, value in small.items():
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(7)
    groups = np.repeat(rng.normal(size=(3, 8)) * 1e6, 50, axis=0)
    memory = groups + rng.normal(size=groups.shape) * 0.2
    queries = memory[::10] + rng.normal(size=(15, 8)) * 0.05
    assert found_nearest(spark, memory, queries, 3, 0.2) == brute_nearest(memory, queries, 3, 0.2)


def test_cells_hold_every_row_and_bound_it(spark, monkeypatch):
    for name, value in SMALL_CELLS.items():
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(3)
    vectors = np.vstack([rng.normal(size=(150, 4)), np.ones((60, 4))])
    tree = neighbours.Tree(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "m bigint, v array<double>"))
    leaves = tree.leaves.toPandas()
    assert sorted(leaves["m"]) == list(range(210)) and len(tree.levels) > 1
    levels = pd.concat([level.toPandas() for level in tree.levels]).set_index("cell")
    same = leaves[leaves["m"] >= 150]["cell"].unique()
    assert len(same) == 1 and levels.loc[same[0], "n"] >= 60  # equal vectors cannot be parted
    sizes = leaves.groupby("cell").size()
    assert (sizes == levels.loc[sizes.index, "n"]).all() and (sizes[sizes.index != same[0]] <= 9).all()
    for cell, rows in leaves.groupby("cell"):
        far = np.sqrt(((np.stack(rows["v"]) - levels.loc[cell, "v"]) ** 2).sum(1))
        assert far.min() >= levels.loc[cell, "lo"] - 1e-12 and far.max() <= levels.loc[cell, "hi"] + 1e-12


def test_pairs_of_copies_are_computed_in_slices():
    copies = np.ones((600, 256))
    tracemalloc.start()
    q, m, d = neighbours.best(copies, copies, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(q) == len(m) == 600 * 600 and not d.any()
    assert peak < 100 << 20  # all at once: 700 MB


def test_what_a_part_of_queries_returns_is_bounded(spark, monkeypatch):
    """Every query goes to every cell: rows that a task returns at once keep within their bytes."""
    for name, value in (SMALL_CELLS | {"BLOCK_ROWS": 20_000, "ROUTED_BYTES": 3000}).items():
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 4)))], "m bigint, v array<double>")
    tree = neighbours.Tree(rows)
    asked = rows.select(F.col("m").alias("q"), "v", F.lit(99.0).alias("r"), F.lit(-1).cast("long").alias("home"), F.lit(0).cast("long").alias("cell"))
    left, right = neighbours._parted(asked, tree.levels[0], tree.width, True)
    held, cells = ({r["part"]: r["count"] for r in side.groupBy("part").count().collect()} for side in (left, right))
    assert sum(held.values()) == 200 and len(held) > 5 and set(held) <= set(cells)
    routed = neighbours._descend(asked, tree.levels[0], tree.width, "bigint", True)
    assert routed.count() == sum(held[p] * cells[p] for p in held)
    assert max(held[p] * cells[p] for p in held) * 8 * tree.width < 2 * 3000


def ranks(memory, queries, k, most):
    """{(query, rank): memory row} of many rows, none beyond ``most`` (squared)."""
    d = ((queries[:, None, :] - memory[None]) ** 2).sum(2)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return {(q, i + 1): m for q, row in enumerate(order.tolist()) for i, m in enumerate(row) if d[q, m] <= most}


#: Queries pass by all rows before a tree is built, in one that is built all the same, and as cells allow.
WAYS = [{"WIDE": -1.0}, {"WIDE": 2.0, "ROUTES": 1}, {"WIDE": 2.0, "ROUTES": 3}, {}]


@pytest.mark.parametrize("way", WAYS[1:] + [{"WIDE": 0.25}])
def test_what_nearest_writes_grows_with_the_vectors(spark, monkeypatch, tmp_path, way):
    """Vectors much alike in their distances meet all cells: no copy of a query is written for each (before: 98 times the bytes of the vectors)."""
    for name, value in ({"LEAF_ROWS": 20, "FAN": 200} | way).items():
        monkeypatch.setattr(neighbours, name, value)
    vectors = np.random.default_rng(11).normal(size=(1500, 48)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "memory_id bigint, vector array<float>").repartition(3)
    monkeypatch.setattr(storage, "shared_folder", lambda spark: tmp_path.as_uri())
    got = me.nearest(table, table.withColumnRenamed("memory_id", "query_id"), 3, 0.0).collect()
    exact = vectors.astype(float)
    assert {(r["query_id"], r["rank"]): r["memory_id"] for r in got} == ranks(exact, exact, 3, np.inf)
    bytes_of = {label: sum(p.stat().st_size for p in tmp_path.glob(f"tablemeld/{label}-*/*.parquet")) for label in ("routed", "reached", "passing", "passed")}
    assert bytes_of["passed"] > 0 and sum(bytes_of.values()) < 8 * vectors.nbytes


@pytest.mark.parametrize("way", WAYS)
def test_nearest_of_repeated_and_missing_keys(spark, monkeypatch, way):
    """Every row of a repeated query id brings its candidates, and every row of a repeated memory id is one."""
    for name, value in (SMALL_CELLS | way).items():
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(6)
    memory = [(None if i % 50 == 7 else i // 2, v.tolist()) for i, v in enumerate(rng.normal(size=(100, 5)))]
    memory += memory[:10]
    asked = [(None if j % 9 == 4 else j // 2, v.tolist()) for j, v in enumerate(rng.normal(size=(20, 5)))] + [(3, memory[0][1])] * 2
    table = spark.createDataFrame(memory, "memory_id bigint, vector array<double>").repartition(3)
    got = me.nearest(table, spark.createDataFrame(asked, "query_id bigint, vector array<double>"), 4, 0.1).collect()
    expected = []
    for key in {q for q, _ in asked}:
        pairs = sorted((float(((np.array(x) - np.array(v)) ** 2).sum()), -1 if m is None else m) for q, x in asked if q == key for m, v in memory)
        expected += [(key, i + 1, m) for i, (d, m) in enumerate(pairs[:4]) if 1 / (1 + d) >= 0.1]
    assert sorted(map(str, expected)) == sorted(str((r["query_id"], r["rank"], -1 if r["memory_id"] is None else r["memory_id"])) for r in got)


@pytest.mark.parametrize("way", WAYS)
def test_nearest_each_way_with_ties_and_radius(spark, monkeypatch, way):
    for name, value in (SMALL_CELLS | way).items():
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(5)
    memory = rng.integers(-6, 6, size=(120, 3)) * 0.25
    memory[40:80] = memory[3]
    queries = np.vstack([memory[3], memory[3], rng.integers(-6, 6, size=(18, 3)) * 0.25, [[60.0, 0, 0]]])
    for threshold in (0.5, 0.0):
        assert found_nearest(spark, memory, queries, 4, threshold) == brute_nearest(memory, queries, 4, threshold)


def test_nearest_refuses_vectors_of_different_lengths(spark, monkeypatch):
    for name, value in (SMALL_CELLS | WAYS[0]).items():
        monkeypatch.setattr(neighbours, name, value)
    table = spark.createDataFrame([(i, [0.5 * i] * (2 + i % 2)) for i in range(40)], "memory_id bigint, vector array<double>")
    with pytest.raises(Exception, match="differ|dimension|shape"):
        me.nearest(table, table.withColumnRenamed("memory_id", "query_id"), 2, 0.1).collect()


@pytest.mark.parametrize("spread, shift", [(1.0, 0.0), (1e-9, 1.0), (1e-3, 1e6), (0.0, 2.0), (1e30, 0.0)])
def test_short_floats_leave_out_no_near_pair(spread, shift):
    rng = np.random.default_rng(8)
    vectors = shift + spread * rng.normal(size=(400, 16))
    queries = np.vstack([vectors[:40], shift + spread * rng.normal(size=(60, 16)), np.full((1, 16), 1e3)])
    exact = ((queries[:, None] - vectors[None]) ** 2).sum(2)
    for most in (np.sort(exact, axis=1)[:, 2], np.full(len(queries), np.inf), np.zeros(len(queries))):
        q, m, d = neighbours.within(queries, vectors, 3, most)
        least = np.minimum(most, np.sort(exact, axis=1)[:, 2])
        got = {(a, b) for a, b, c in zip(q.tolist(), m.tolist(), d, strict=True) if c <= least[a]}
        assert got == set(zip(*(x.tolist() for x in np.nonzero(exact <= least[:, None])), strict=True))
        assert (d == exact[q, m]).all()


def test_nearest_leaves_out_what_is_no_vector(spark):
    rows = [(1, [0.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (None, [0.1, 0.0])]
    table = spark.createDataFrame(rows, "memory_id bigint, vector array<double>")
    got = me.nearest(table, table.withColumnRenamed("memory_id", "query_id"), 5, 0.5).collect()
    assert sorted((str(r.query_id), str(r.memory_id)) for r in got) == [("1", "1"), ("1", "None"), ("None", "1"), ("None", "None")]
    assert me.nearest(table.limit(0), table.withColumnRenamed("memory_id", "query_id")).count() == 0


def test_nearest_with_text_ids_and_nothing_similar(spark):
    table = spark.createDataFrame([("m", [0.0, 0.0])], "memory_id string, vector array<float>")
    asked = spark.createDataFrame([("near", [0.1, 0.0]), ("far", [9.0, 9.0])], "query_id string, vector array<float>")
    assert [r["query_id"] for r in me.suggest(table, asked).collect()] == ["near"]
    assert me.nearest(table, asked.limit(0)).count() == 0


@pytest.mark.parametrize("set_columns", [256, 40])
def test_overlap_of_columns_that_share_values(spark, monkeypatch, set_columns):
    monkeypatch.setattr(ma, "SET_COLUMNS", set_columns)
    r = random.Random(2)

    def side(width, rows):
        data = [tuple(r.choice(["all", "all", f"v{r.randrange(4 + c)}", None]) for c in range(width)) + (r.randrange(3),) for _ in range(rows)]
        return data, spark.createDataFrame(data, ", ".join([*(f"c{c} string" for c in range(width)), "n int"]))

    (left, source), (right, target) = side(70, 30), side(5, 20)
    names_s, names_t = source.columns, [f"t_{c}" for c in target.columns]
    target = target.toDF(*names_t)
    pairs = spark.createDataFrame([(a, b) for a in names_s for b in names_t], "s_column string, t_column string")
    got = {(x["s_column"], x["t_column"]): x["jaccard"] for x in ma.level_overlap(source, target, pairs).collect()}
    text = lambda rows, c: {str(row[c]) for row in rows if row[c] is not None}
    want = {(a, b): len(text(left, i) & text(right, j)) / max(1, len(text(left, i) | text(right, j))) for i, a in enumerate(names_s) for j, b in enumerate(names_t)}
    assert got == pytest.approx(want)
    if set_columns == 256:
        sets = ma.column_sets(source, names_s, target, names_t).collect()
        assert sum(x["values"] for x in sets) == len(set().union(*(text(left, i) for i in range(71)), *(text(right, j) for j in range(6))))
        assert sum(len(x["source_set"]) >= 70 and len(x["target_set"]) >= 5 for x in sets) == 1  # the value of all columns is one row


def test_overlap_of_nothing(spark):
    empty = spark.createDataFrame([(None, None)], "a string, b int")
    pairs = spark.createDataFrame([("a", "a"), ("b", "a")], "s_column string, t_column string")
    assert {x["jaccard"] for x in ma.level_overlap(empty, empty, pairs).collect()} == {0.0}
    assert ma.level_overlap(empty, empty, pairs.limit(0)).count() == 0


WORDS = ("customer order brand country region satisfaction score rating date wave age gender income spend channel visit product price store weight "
         "loyalty market segment intent purchase usage panel question answer comment").split()


@pytest.mark.parametrize("labels", [False, True])
def test_best_partner_is_that_of_all_pairs(labels):
    r = random.Random(8)
    make = lambda: "_".join(r.choice(WORDS) for _ in range(r.randrange(1, 4))) + r.choice(["", "_1", "_Code", "ID"])
    targets = pd.DataFrame({"name": [make() for _ in range(2000)], "label": [make() if labels else "" for _ in range(2000)], "ord": range(2000)})
    targets["distribution"] = [r.choice([0.0, 0.0, 0.0, round(r.random(), 3)]) for _ in range(2000)]
    scored = 0
    for _ in range(12):
        name, label = make(), make() if labels else ""
        confidence = [
            0.5 * names.similarity(name, t.name) + (0.2 * names.similarity(label, t.label) if labels else 0.0) + 0.3 * t.distribution
            for t in targets.rename(columns={"name": "n"}).rename(columns={"n": "name"}).itertuples(index=False)
        ]
        want = min(range(2000), key=lambda k: (-partners.rounded(confidence[k]), k))
        k, n, _, count = partners.best_partner(name, label, targets)
        assert (k, n) == (want, names.similarity(name, targets["name"][want]))
        scored += count
    assert scored < 12 * 2000 / 10


def test_bounds_hold_for_every_pair():
    r = random.Random(9)
    texts = ["", None, "É É", "aa"] + ["".join(r.choice("abcAB_ ") for _ in range(r.randrange(9))) for _ in range(60)]
    for a in texts:
        bounds = partners.similarity_bounds(a, texts)
        assert all(names.similarity(a, b) <= bounds[k] + 1e-12 for k, b in enumerate(texts))


def changes_of(spark, before, after, most=2, schema="a string, b int, c double"):
    found = unkeyed.row_changes(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema).repartition(3), most).collect()
    return sorted((r["change"], tuple(r["columns"]), r["before"] and tuple(r["before"]), r["after"] and tuple(r["after"])) for r in found)


def test_rows_without_keys(spark):
    before = [("x", 1, 1.0)] * 5 + [("y", 2, 2.0), ("z", None, 3.0), ("gone", 9, 9.0), (None, None, None)]
    after = [("x", 1, 1.0)] * 3 + [("y", 2, 2.5), ("z", 0, 3.0), ("new", 7, 7.0), (None, None, None), ("x", 1, 4.0)]
    assert changes_of(spark, before, after, 1) == [
        ("added", (), None, ("new", 7, 7.0)), ("changed", ("b",), ("z", None, 3.0), ("z", 0, 3.0)), ("changed", ("c",), ("x", 1, 1.0), ("x", 1, 4.0)),
        ("changed", ("c",), ("y", 2, 2.0), ("y", 2, 2.5)), ("removed", (), ("gone", 9, 9.0), None), ("removed", (), ("x", 1, 1.0), None),
    ]
    assert changes_of(spark, before, before) == [] and changes_of(spark, [], []) == []
    assert [c[0] for c in changes_of(spark, before[:2], [])] == ["removed", "removed"]
    assert [c[0] for c in changes_of(spark, [("a", 1, 1.0)], [("b", 2, 1.0)], 0)] == ["added", "removed"]
    with pytest.raises(ValueError):
        changes_of(spark, before, after, 3)


@pytest.mark.parametrize("rows_per_task", [500_000, 20])
def test_a_large_list_of_interchangeable_rows_is_paired_off(spark, monkeypatch, rows_per_task):
    """All rows agree but for one cell that changed everywhere: as many pairs as rows, not their product."""
    monkeypatch.setattr(unkeyed, "ROWS_PER_TASK", rows_per_task)
    before = [("same", 5, float(k)) for k in range(150)] + [("same", 5, 0.5)] * 50
    after = [("same", 5, 1000.0 + k) for k in range(120)] + [("other", 5, 2000.0 + k) for k in range(100)]
    found = changes_of(spark, before, after)
    kinds = Counter((c[0], c[1]) for c in found)
    assert kinds == {("changed", ("c",)): 120, ("changed", ("a", "c")): 80, ("added", ()): 20}
    assert Counter(c[2] for c in found if c[2]) == Counter(before) and Counter(c[3] for c in found if c[3]) == Counter(after)


def test_rows_are_paired_in_one_pass_over_each_set_of_columns(spark, monkeypatch):
    """Rows of many lists at once: each set of columns is passed once, and none again because its first choices were refused."""
    written = []
    monkeypatch.setattr(unkeyed, "materialize", lambda df, label: written.append(label) or materialize(df, label))
    before = [(chr(97 + i % 5), i % 7, float(i % 11)) for i in range(120)]
    after = [(chr(97 + i % 4), i % 6, float(i % 13) + 0.5 * (i % 3 == 0)) for i in range(120)]
    found = changes_of(spark, before, after)
    assert Counter(c[2] for c in found if c[2]) == Counter(before) - (Counter(before) & Counter(after))
    assert Counter(c[3] for c in found if c[3]) == Counter(after) - (Counter(before) & Counter(after))
    assert all(sum(x != y for x, y in zip(c[2], c[3], strict=True)) == len(c[1]) for c in found if c[0] == "changed")
    # what is left has no partner, and changes of one column come before those of two
    alone = [c for c in found if c[0] != "changed"]
    assert not any(sum(x != y for x, y in zip(b[2], a[3], strict=True)) <= 2 for b in alone if b[2] for a in alone if a[3])
    assert written.count("pairs") <= 6 and written.count("open") <= 3


def test_broadcasts_are_bound_by_rows_and_bytes(spark, monkeypatch):
    table = spark.range(50).select("id", F.repeat(F.lit("é"), 100).alias("text"), F.array("id", "id").alias("list"))
    assert joins.fits_broadcast(table) and not joins.fits_broadcast(table, 49)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 50 * 200)
    assert not joins.fits_broadcast(table) and joins.fits_broadcast(table.limit(5)) and joins.fits_broadcast(table.limit(0))
    rows = spark.range(60)
    assert joins.lookup_join(rows, table, ["id"]).where("text is not null").count() == 50
