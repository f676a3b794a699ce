"""Matching, calibration, comparison, generated metadata, memory and whole runs."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from checks.profiles import (
    CUSTOMER_COLUMNS, SURVEY_COLUMNS, SURVEY_NAMES, levels_sql, samples_sql, stats_sql, top_sql,
)
from checks.registry import (
    CUSTOMER_SQL, SURVEY_SQL, case_sql, customer, query, rounded, survey, table, values_sql, with_customer,
    with_survey,
)
from checks.cleaning import mode_sql
from checks.transforms import HARMONIZED_SQL, OLD_NAMES, PERCENTILE_SQL, SURVEY_MAPS, SURVEY_SCHEMA, vendor_survey
from tablemeld.functions import fixed_values as fv
from tablemeld.operators import (
    calibrate as ca, compare as cp, generate as ge, levels as lv, match as ma, memory as me, profile as pr,
    transform as tf, unkeyed, validate as va,
)
from tablemeld.operators.facts import fit_facts
from tablemeld.plans import local, metadata, multi_source, reports as rp, single_source
from tablemeld.sources import metadata as md, tables as st
from tablemeld.sources.metadata import ColumnSpec, MasterSchema, value_map_table
from tablemeld.storage import materialize, shared_folder
from tablemeld.streaming import incremental

# --- rule-based matching ---------------------------------------------------------

EXPECTED = (
    ("respondent_id", "respondent_id", 1.0, "high"), ("survey date", "survey_date", 0.95, "high"),
    ("market", "country", 0.90, "high"), ("region", "UNMAPPED", 0.0, "uncertain"), ("age_group", "age", 0.90, "high"),
    ("gender", "gender", 1.0, "high"), ("csat", "satisfaction_score", 0.90, "high"), ("nps", "nps_score", 0.90, "high"),
    ("spend", "UNMAPPED", 0.0, "uncertain"), ("channel", "channel", 1.0, "high"),
    ("purchase_likelihood", "purchase_intent", 0.90, "high"), ("status", "UNMAPPED", 0.0, "uncertain"),
)
MAPPING_VALUES = ", ".join(f"('{s}', '{t}', {c}::DOUBLE, '{k}')" for s, t, c, k in EXPECTED)
MAPPINGS_SQL = f"SELECT * FROM (VALUES {MAPPING_VALUES}) m(source_column, target_column, confidence, confidence_level)"
VENDOR_COLUMNS = tuple((OLD_NAMES.get(c, c), t, k) for c, t, k in SURVEY_COLUMNS)
VENDOR_SQL = f"""SELECT respondent_id, survey_date AS "survey date", country AS market, region, age AS age_group, gender,
    satisfaction_score AS csat, nps_score AS nps, spend, channel, purchase_intent AS purchase_likelihood, status
    FROM ({SURVEY_SQL})"""


def quoted_stats(source: str, columns) -> str:
    return stats_sql(source, columns).replace("(survey date)", '("survey date")').replace("DISTINCT survey date", 'DISTINCT "survey date"')


VENDOR_STATS = f"WITH v AS ({VENDOR_SQL}) " + quoted_stats("v", VENDOR_COLUMNS)


@query(
    "column_mapping",
    f"""SELECT m.*, m.confidence < 0.8 AS requires_review, inferred_type, non_null_count, unique_count
    FROM ({MAPPINGS_SQL}) m JOIN ({VENDOR_STATS}) s ON m.source_column = s."column" """,
)
def column_mapping(spark, folder):
    df = vendor_survey(spark, folder)
    mappings = ma.match_columns(ma.column_table(df), SURVEY_SCHEMA)
    statistics = pr.source_schema(df).withColumnRenamed("column", "source_column").drop("ord")
    return mappings.join(statistics, "source_column").select(
        "source_column", "target_column", "confidence", "confidence_level", "requires_review",
        "inferred_type", "non_null_count", "unique_count",
    )


@query(
    "type_mismatches",
    f"""SELECT source_column, target_column, inferred_type AS source_type, expected_type
    FROM ({MAPPINGS_SQL}) m JOIN ({VENDOR_STATS}) s ON m.source_column = s."column"
    JOIN (VALUES {values_sql({c.name: c.data_type for c in SURVEY_SCHEMA.columns})}) e(name, expected_type)
    ON target_column = name WHERE inferred_type <> expected_type""",
)
def type_mismatches(spark, folder):
    df = vendor_survey(spark, folder)
    return rp.structural_validation(df, SURVEY_SCHEMA)["type_mismatches"]


@query(
    "validation_result",
    f"""SELECT round(avg(confidence), 4) AS confidence_score, false AS is_valid,
    (SELECT count(*) FROM ({MAPPINGS_SQL}) m JOIN ({VENDOR_STATS}) s ON m.source_column = s."column"
     JOIN (VALUES {values_sql({c.name: c.data_type for c in SURVEY_SCHEMA.columns})}) e(name, expected_type)
     ON target_column = name WHERE inferred_type <> expected_type) AS warnings,
    'Missing required columns: weight' AS errors FROM ({MAPPINGS_SQL})""",
)
def validation_result(spark, folder):
    found = rp.structural_validation(vendor_survey(spark, folder), SURVEY_SCHEMA)["validation"]
    return rounded(
        found.select(
            "confidence_score", "is_valid", F.size("validation_warnings").cast("bigint").alias("warnings"),
            F.array_join("validation_errors", "; ").alias("errors"),
        )
    )


@query(
    "schema_drift",
    f"""SELECT side, d."column", round((1 - 9 / 12.0)::DOUBLE, 4) AS drift_score, 'blocking' AS drift_severity,
    coalesce(non_null_count, 0) AS cells, coalesce(unique_count, 0) AS unique_values
    FROM (VALUES ('missing', 'weight'), ('extra', 'region'), ('extra', 'spend'), ('extra', 'status')) d(side, "column")
    LEFT JOIN ({VENDOR_STATS}) s ON s."column" = d."column" """,
)
def schema_drift(spark, folder):
    """Missing and extra columns, with what would be lost of each extra one."""
    df = vendor_survey(spark, folder)
    drift = ma.schema_drift(ma.match_columns(ma.column_table(df), SURVEY_SCHEMA), SURVEY_SCHEMA)
    sides = [drift.select(F.lit(side).alias("side"), F.explode(f"{side}_columns").alias("column"), F.round("drift_score", 4).alias("drift_score"), "drift_severity") for side in ("missing", "extra")]
    held = pr.column_statistics(df).select("column", F.col("non_null_count").alias("cells"), F.col("unique_count").alias("unique_values"))
    return sides[0].unionByName(sides[1]).join(held, "column", "left").fillna(0, ["cells", "unique_values"])


@query(
    "merged_mappings",
    f"""SELECT m.source_column, CASE WHEN p.confidence IS NULL OR (m.target_column <> 'UNMAPPED' AND m.confidence >= p.confidence)
      THEN m.target_column ELSE p.target_column END AS target_column,
      greatest(m.confidence, coalesce(round(p.confidence, 4), 0)) AS confidence
    FROM ({MAPPINGS_SQL}) m LEFT JOIN (SELECT "column" AS source_column, 'extra_' || "column" AS target_column,
      round(non_null_count / total_count, 4)::DOUBLE AS confidence FROM ({VENDOR_STATS})) p ON m.source_column = p.source_column""",
)
def merged_mappings(spark, folder):
    df = vendor_survey(spark, folder)
    facts = fit_facts(df)
    proposals = pr.facts_table(df, facts).select(
        F.col("column").alias("source_column"), F.concat(F.lit("extra_"), "column").alias("target_column"),
        F.round(F.col("non_null_count") / F.col("total_count"), 4).alias("confidence"), F.lit("share").alias("reason"),
    )
    merged = ma.merge_mappings(ma.match_columns(ma.column_table(df), SURVEY_SCHEMA), proposals)
    return merged.select("source_column", "target_column", "confidence")


# --- similarity of data sets ------------------------------------------------------

LEFT = "SELECT c_custkey AS id, c_acctbal AS balance, c_nationkey AS nation, c_mktsegment AS segment FROM {customer}"
RIGHT = "SELECT s_suppkey AS key, s_acctbal AS acct_balance, s_nationkey AS nation_key, CAST(s_nationkey AS {string}) AS segments FROM {supplier}"
LEFT_SQL, RIGHT_SQL = LEFT.format(customer="customer"), RIGHT.format(string="VARCHAR", supplier="supplier")
LEFT_COLS = (("id", True), ("balance", True), ("nation", True), ("segment", False))
RIGHT_COLS = (("key", True), ("acct_balance", True), ("nation_key", True), ("segments", False))


def similarity_sql() -> str:
    parts = []
    for a, an in LEFT_COLS:
        for b, bn in RIGHT_COLS:
            name = SequenceMatcher(None, a, b).ratio()
            if an and bn:
                value = f"""(SELECT (1 - least(abs(m1 - m2) / (abs(m1) + abs(m2) + 1e-6), 1) + 1 - least(abs(s1 - s2) / (abs(s1) + abs(s2) + 1e-6), 1)) / 2
                  FROM (SELECT avg({a}) AS m1, stddev_samp({a}) AS s1 FROM l), (SELECT avg({b}) AS m2, stddev_samp({b}) AS s2 FROM r))"""
            else:
                x, y = f"SELECT DISTINCT CAST({a} AS VARCHAR) AS v FROM l", f"SELECT DISTINCT CAST({b} AS VARCHAR) AS v FROM r"
                value = f"(SELECT count(*) FROM ({x} INTERSECT {y})) / (SELECT count(*) FROM ({x} UNION {y}))"
            parts.append(f"SELECT '{a}' AS source_column, '{b}' AS target_column, {name!r}::DOUBLE AS name, round({value}, 3)::DOUBLE AS distribution_similarity")
    return f"WITH l AS ({LEFT_SQL}), r AS ({RIGHT_SQL}) " + " UNION ALL ".join(parts)


def both_sides(spark, folder):
    return (
        spark.sql(LEFT, customer=table(spark, folder, "customer")),
        spark.sql(RIGHT.replace("{string}", "STRING"), supplier=table(spark, folder, "supplier")),
    )


@query("distribution_similarity", f"SELECT source_column, target_column, distribution_similarity FROM ({similarity_sql()})")
def distribution_similarity(spark, folder):
    return ma.distribution_similarity(*both_sides(spark, folder)).drop("s_ord", "t_ord")


@query(
    "match_datasets",
    f"""SELECT source_column, target_column, confidence, CASE WHEN confidence >= 0.8 THEN 'auto' ELSE 'review' END AS status,
    round(name, 3) AS name_similarity, distribution_similarity FROM (
      SELECT *, row_number() OVER (PARTITION BY source_column ORDER BY confidence DESC, array_position(['key', 'acct_balance', 'nation_key', 'segments'], target_column)) AS r
      FROM (SELECT *, round(0.5::DOUBLE * name + 0.3::DOUBLE * distribution_similarity, 3) AS confidence FROM ({similarity_sql()}))) WHERE r = 1""",
)
def match_datasets(spark, folder):
    return ma.match_datasets(*both_sides(spark, folder)).drop("ord", "label_similarity")


@query(
    "level_overlap",
    f"""WITH l AS ({LEFT_SQL}), r AS ({RIGHT_SQL}) SELECT 'nation' AS s_column, 'nation_key' AS t_column,
    round((SELECT count(*) FROM (SELECT nation FROM l INTERSECT SELECT nation_key FROM r))
      / (SELECT count(*) FROM (SELECT nation FROM l UNION SELECT nation_key FROM r)), 4)::DOUBLE AS jaccard""",
)
def level_overlap(spark, folder):
    pairs = spark.createDataFrame([("nation", "nation_key")], "s_column string, t_column string")
    return rounded(ma.level_overlap(*both_sides(spark, folder), pairs))


# --- calibration and comparison ---------------------------------------------------

SPLIT = """SELECT o_orderkey, o_custkey % 7 AS market, o_orderpriority AS wave, o_totalprice AS spend,
    CASE WHEN o_custkey % 7 = 3 THEN 5.0 ELSE (o_orderkey * 7) % 11 END AS score, o_orderdate < TIMESTAMP '1998-01-01' AS old FROM {orders}"""
SPLIT_SQL = f"s AS ({SPLIT.format(orders='orders')})"


def split(spark, folder):
    df = spark.sql(SPLIT, orders=table(spark, folder, "orders")).withColumn("score", F.col("score").cast("double"))
    return df.where("old").drop("old"), df.where("NOT old").drop("old")


MOMENTS_SQL = """m AS (SELECT h.*, c.* EXCLUDE (market, wave) FROM
    (SELECT market, wave, count(*) AS n1, avg(spend) AS m1, stddev_samp(spend) AS s1, avg(score::DOUBLE) AS m2, coalesce(stddev_samp(score::DOUBLE), 0) AS s2
     FROM s WHERE old GROUP BY ALL) h JOIN
    (SELECT market, wave, count(*) AS n3, avg(spend) AS m3, stddev_samp(spend) AS s3, avg(score::DOUBLE) AS m4, coalesce(stddev_samp(score::DOUBLE), 0) AS s4
     FROM s WHERE NOT old GROUP BY ALL) c ON h.market = c.market AND h.wave = c.wave WHERE n1 >= 5 AND n3 >= 5)"""


@query(
    "calibrate",
    f"""WITH {SPLIT_SQL}, {MOMENTS_SQL} SELECT o_orderkey, s.market, s.wave,
    round(CASE WHEN m1 IS NULL THEN spend ELSE (spend - m1) / s1 * s3 + m3 END, 4) AS spend,
    round(CASE WHEN m1 IS NULL THEN score WHEN s2 = 0 OR s4 = 0 THEN score - m2 + m4 ELSE (score - m2) / s2 * s4 + m4 END, 4)::DOUBLE AS score
    FROM s LEFT JOIN m ON s.market = m.market AND s.wave = m.wave WHERE old""",
)
def calibrate(spark, folder):
    historical, current = split(spark, folder)
    return rounded(ca.calibrate(historical, current, ["market", "wave"], ["o_orderkey"])[0])


@query(
    "calibration_report",
    f"""WITH {SPLIT_SQL}, {MOMENTS_SQL} SELECT market, wave, 'spend' AS "column", round(m1, 4) AS source_mean, round(m3, 4) AS reference_mean,
    round(s1, 4) AS source_std, round(s3, 4) AS reference_std, CASE WHEN s1 = 0 OR s3 = 0 THEN 'mean_shift' ELSE 'mean_std' END AS method FROM m
    UNION ALL SELECT market, wave, 'score', round(m2, 4), round(m4, 4), round(s2, 4), round(s4, 4),
    CASE WHEN s2 = 0 OR s4 = 0 THEN 'mean_shift' ELSE 'mean_std' END FROM m""",
)
def calibration_report(spark, folder):
    historical, current = split(spark, folder)
    return rounded(ca.calibrate(historical, current, ["market", "wave"], ["o_orderkey"])[1])


@query(
    "calibrate_overall",
    f"""WITH {SPLIT_SQL}, a AS (SELECT avg(spend) AS m1, stddev_samp(spend) AS s1 FROM s WHERE old),
    b AS (SELECT avg(spend) AS m2, stddev_samp(spend) AS s2 FROM s WHERE NOT old)
    SELECT o_orderkey, round((spend - m1) / s1 * s2 + m2, 4) AS spend FROM s, a, b WHERE old""",
)
def calibrate_overall(spark, folder):
    historical, current = (df.select("o_orderkey", "spend") for df in split(spark, folder))
    return rounded(ca.calibrate(historical, current, [], ["o_orderkey"])[0])


@query(
    "market_comparison",
    f"""WITH {SPLIT_SQL} SELECT market, round(avg(spend), 4) AS spend, round(avg(score::DOUBLE), 4) AS score,
    CASE WHEN old THEN 'historical' ELSE 'current' END AS dataset FROM s GROUP BY market, old""",
)
def market_comparison(spark, folder):
    historical, current = split(spark, folder)
    return rounded(ca.market_comparison(historical, current, names=["spend", "score"]))


AFTER_SQL = f"SELECT c_custkey, c_name, {case_sql('lower(trim(c_mktsegment))', fv.CATEGORY_CODES, 'lower(trim(c_mktsegment))')} AS c_mktsegment, coalesce(c_acctbal, 0) AS c_acctbal, 'x' AS extra FROM c WHERE c_custkey % 100 <> 5"


def changed_customer(spark, folder):
    before = customer(spark, folder)
    after = tf.standardize_codes(before, "category", ["c_mktsegment"]).fillna({"c_acctbal": 0.0})
    return before, after.where("c_custkey % 100 <> 5").withColumn("extra", F.lit("x")).drop("c_nationkey")


def change_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column", count(*) FILTER (b.{column} IS DISTINCT FROM a.{column}) AS values_changed,
        round(count(*) FILTER (b.{column} IS DISTINCT FROM a.{column}) / count(*) * 100, 2) AS change_pct FROM c b JOIN a ON b.c_custkey = a.c_custkey"""


@query(
    "compare_tables",
    f"WITH c AS ({CUSTOMER_SQL}), a AS ({AFTER_SQL}) " + " UNION ALL ".join(map(change_sql, ("c_name", "c_acctbal", "c_mktsegment"))),
)
def compare_tables(spark, folder):
    return cp.compare_tables(*changed_customer(spark, folder), ["c_custkey"])


#: Keys that hold many rows; every eleventh order changes its status.
REPEATED = "SELECT o_custkey, o_orderstatus, o_orderpriority, o_totalprice FROM {orders}"
REPEATED_AFTER = "SELECT o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority, o_totalprice FROM {orders} WHERE o_orderkey % 13 > 0"


def repeated_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column", CAST(sum(n) - sum(same) AS BIGINT) AS values_changed, round((sum(n) - sum(same)) / sum(n) * 100, 2) AS change_pct FROM (
        SELECT b.o_custkey, least(b.n, a.n) AS n, coalesce(same, 0) AS same FROM (SELECT o_custkey, count(*) AS n FROM b GROUP BY 1) b
        JOIN (SELECT o_custkey, count(*) AS n FROM a GROUP BY 1) a USING (o_custkey)
        LEFT JOIN (SELECT o_custkey, sum(least(x.n, y.n)) AS same FROM (SELECT o_custkey, {column} AS v, count(*) AS n FROM b GROUP BY 1, 2) x
          JOIN (SELECT o_custkey, {column} AS v, count(*) AS n FROM a GROUP BY 1, 2) y USING (o_custkey, v) GROUP BY 1) USING (o_custkey))"""


@query(
    "compare_repeated_keys",
    f"WITH b AS ({REPEATED.format(orders='orders')}), a AS ({REPEATED_AFTER.format(orders='orders')}) "
    + " UNION ALL ".join(map(repeated_sql, ("o_orderstatus", "o_orderpriority", "o_totalprice"))),
)
def compare_repeated_keys(spark, folder):
    orders = table(spark, folder, "orders")
    return cp.compare_tables(spark.sql(REPEATED, orders=orders), spark.sql(REPEATED_AFTER, orders=orders), ["o_custkey"])


@query(
    "compare_summary",
    f"""WITH c AS ({CUSTOMER_SQL}), a AS ({AFTER_SQL}) SELECT (SELECT count(*) FROM c) AS rows_before, (SELECT count(*) FROM a) AS rows_after,
    0::BIGINT AS keys_added, (SELECT count(*) FROM c) - (SELECT count(*) FROM a) AS keys_removed, 0::BIGINT AS repeated_keys,
    1::BIGINT AS columns_added, 1::BIGINT AS columns_removed, 4::BIGINT AS columns_common""",
)
def compare_summary(spark, folder):
    return cp.compare_summary(*changed_customer(spark, folder), ["c_custkey"])


@query(
    "change_preview",
    f"""WITH c AS ({CUSTOMER_SQL}), a AS ({AFTER_SQL.replace("WHERE c_custkey % 100 <> 5", "")})
    SELECT c_custkey, concat_ws('|', CASE WHEN b.c_acctbal IS DISTINCT FROM a.c_acctbal THEN 'c_acctbal' END,
      CASE WHEN b.c_mktsegment IS DISTINCT FROM a.c_mktsegment THEN 'c_mktsegment' END, 'extra') AS changed_columns
    FROM c b JOIN a USING (c_custkey) ORDER BY c_custkey LIMIT 50""",
)
def change_preview(spark, folder):
    before = customer(spark, folder).drop("c_nationkey")
    after = tf.standardize_codes(before, "category", ["c_mktsegment"]).fillna({"c_acctbal": 0.0}).withColumn("extra", F.lit("x"))
    found = cp.change_preview(before, after, ["c_custkey"])
    return found.select("c_custkey", F.array_join("changed_columns", "|").alias("changed_columns"))


# --- combining --------------------------------------------------------------------

PARTIES = """SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, CAST(NULL AS INTEGER) AS nation FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, s_nationkey FROM supplier"""


def parties(spark, folder):
    return {
        "historical": table(spark, folder, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment"),
        "incremental": table(spark, folder, "supplier").selectExpr("s_suppkey AS key", "s_name AS name", "s_acctbal AS balance", "s_nationkey AS nation"),
    }


@query("combine_sources", PARTIES)
def combine_sources(spark, folder):
    return st.combine(parties(spark, folder))


def scratch(spark, label: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/tablemeld/{label}-{uuid.uuid4().hex}"


@query("append_incremental", PARTIES)
def append_incremental(spark, folder):
    frames, path = parties(spark, folder), scratch(spark, "combined") + ".parquet"
    st.write_combined(spark, {"historical": frames["historical"]}, path)
    st.write_combined(spark, frames, path, incremental_only=True)
    return st.read_combined(spark, path)


@query("csv_round_trip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def csv_round_trip(spark, folder):
    path = scratch(spark, "orders") + ".csv"
    orders = table(spark, folder, "orders")
    st.write_table(orders, path)
    return st.read_table(spark, path, schema=orders.schema, lines=True).data


@query("csv_inferred", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders")
def csv_inferred(spark, folder):
    path = scratch(spark, "orders") + ".csv"
    st.write_table(table(spark, folder, "orders"), path)
    data = st.read_table(spark, path).data
    return data.withColumns({c: F.col(c).cast("bigint") for c in ("o_orderkey", "o_custkey")} | {"o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd")})


#: Texts with line breaks and quotes; an empty text and a missing one stay apart.
AWKWARD = """SELECT {id} AS id, CASE WHEN {id} % 7 = 0 THEN NULL WHEN {id} % 7 = 1 THEN '' ELSE {text} || '"' || {text} END AS text FROM {source}"""
AWKWARD_SQL = AWKWARD.format(id="doc_id", text="text", source="documents") + " UNION ALL " + AWKWARD.format(id="page_id", text="html", source="pages")


@query("csv_text_round_trip", AWKWARD_SQL)
def csv_text_round_trip(spark, folder):
    rows = spark.sql(
        AWKWARD.format(id="doc_id", text="text", source="{documents}") + " UNION ALL " + AWKWARD.format(id="page_id", text="html", source="{pages}"),
        documents=table(spark, folder, "documents"), pages=table(spark, folder, "pages"),
    )
    path = scratch(spark, "texts") + ".csv"
    st.write_table(rows, path)
    return st.read_table(spark, path, schema=rows.schema).data


@query("csv_one_file", AWKWARD_SQL)
def csv_one_file(spark, folder):
    """The same texts in one CSV file, read by records."""
    rows = spark.sql(
        AWKWARD.format(id="doc_id", text="text", source="{documents}") + " UNION ALL " + AWKWARD.format(id="page_id", text="html", source="{pages}"),
        documents=table(spark, folder, "documents"), pages=table(spark, folder, "pages"),
    )
    path = scratch(spark, "one-file") + ".csv"
    st.write_one_csv(rows, path)
    return st.read_csv(spark, path, schema=rows.schema, split=True).data


@query("json_round_trip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def json_round_trip(spark, folder):
    path = scratch(spark, "documents") + ".json"
    st.write_table(table(spark, folder, "documents"), path)
    return st.read_table(spark, path).data.select("doc_id", "text", "lang", "source", "n_chars")


@query("json_mixed_folder", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def json_mixed_folder(spark, folder):
    """Documents in a folder: some files hold an array, others a record on each line."""
    path, documents = scratch(spark, "mixed") + ".json", table(spark, folder, "documents")
    st.write_table(documents.where("doc_id % 2 = 0"), f"{path}/part=-1", "json")
    record = F.to_json(F.struct(*documents.columns), {"ignoreNullFields": "false"})
    # an array for each 64 documents, a file for each array
    arrays = documents.where("doc_id % 2 = 1").groupBy(F.floor(F.col("doc_id") / 128).alias("part")).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(record), ",\n"), F.lit("\n]")).alias("value"))
    arrays.write.mode("append").partitionBy("part").text(path)
    return st.read_table(spark, path).data.select(documents.columns)


@query("csv_stream_text", AWKWARD_SQL)
def csv_stream_text(spark, folder):
    """The same texts as a stream of CSV files."""
    rows = spark.sql(
        AWKWARD.format(id="doc_id", text="text", source="{documents}") + " UNION ALL " + AWKWARD.format(id="page_id", text="html", source="{pages}"),
        documents=table(spark, folder, "documents"), pages=table(spark, folder, "pages"),
    )
    path, out = scratch(spark, "arriving") + ".csv", scratch(spark, "texts")
    st.write_table(rows, path)
    incremental.start(incremental.read_stream(spark, path, rows.schema, "csv"), [], f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/data").select("id", "text")


@query("source_files", "SELECT 'events.parquet' AS file_name, count(*) AS rows, 6 AS column_count FROM events")
def source_files(spark, folder):
    source = st.read_table(spark, f"{folder}/events.parquet")
    return source.files().select("file_name", "rows", F.lit(len(source.data.columns)).alias("column_count"))


# --- generated metadata -----------------------------------------------------------


@query(
    "generated_metadata_round_trip",
    f"""WITH c AS ({CUSTOMER_SQL}), b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM c)
    SELECT 'column' AS kind, name, NULL::BIGINT AS found FROM (VALUES {", ".join(f"('{c[0]}')" for c in CUSTOMER_COLUMNS)}) v(name)
    UNION ALL SELECT 'flags', 'c_acctbal', count(*) FROM c, b WHERE c_acctbal * 2 NOT BETWEEN lo AND hi
    UNION ALL SELECT 'flags', 'c_mktsegment', count(*) FROM c WHERE c_mktsegment = 'BUILDING'
    UNION ALL SELECT 'map', 'c_mktsegment', count(DISTINCT c_mktsegment) FROM c""",
)
def generated_metadata_round_trip(spark, folder):
    """Documents generated from a table, loaded again, flag a changed version of it."""
    rows, target = customer(spark, folder), scratch(spark, "documents")
    metadata.write_documents(metadata.run(rows), target)
    schema, maps = md.load_master_schema(spark, target), md.load_value_maps(spark, target)
    changed = rows.withColumns(
        {"c_acctbal": F.col("c_acctbal") * 2, "c_mktsegment": F.when(F.col("c_mktsegment") == "BUILDING", "TOWER").otherwise(F.col("c_mktsegment"))}
    )
    found = spark.createDataFrame(
        [("column", c, None) for c in schema.names] + [("map", "c_mktsegment", len(maps["c_mktsegment"]))], "kind string, name string, found long"
    )
    flags = va.apply_rules(changed, md.load_rules(spark, f"{target}/validation_rules.json"), "customer", "c_custkey")
    counts = flags.groupBy("column").agg(F.count(F.lit(1)).alias("found")).where("column IN ('c_acctbal', 'c_mktsegment')")
    return found.unionByName(counts.select(F.lit("flags").alias("kind"), F.col("column").alias("name"), "found"))

GENERATED = stats_sql("c", CUSTOMER_COLUMNS, 0.10)


def allowed_sql(source: str, names, limit: int) -> str:
    return f"""SELECT "column", array_to_string(list(value ORDER BY value), '|') AS allowed_values FROM ({levels_sql(source, names)})
        GROUP BY "column" HAVING count(*) <= {limit}"""


@query(
    "generate_rules",
    with_customer(
        f"""SELECT s."column", round(min, 4) AS min, round(max, 4) AS max, allowed_values, CAST(NULL AS BIGINT) AS min_records
        FROM ({GENERATED}) s LEFT JOIN ({allowed_sql("c", ("c_name", "c_mktsegment"), 25)}) a ON s."column" = a."column"
        WHERE min IS NOT NULL OR allowed_values IS NOT NULL UNION ALL SELECT NULL, NULL, NULL, NULL, 10"""
    ),
)
def generate_rules(spark, folder):
    found = ge.generate_metadata(customer(spark, folder)).rules
    return rounded(found.withColumn("allowed_values", F.array_join("allowed_values", "|")))


@query(
    "generate_schema",
    with_customer(f'SELECT "column" AS name, "column" AS canonical_name, inferred_type AS data_type, round(min, 4) AS min_value, round(max, 4) AS max_value FROM ({GENERATED})'),
)
def generate_schema(spark, folder):
    return rounded(ge.generate_metadata(customer(spark, folder)).schema.drop("ord", "aliases"))


@query(
    "generate_standards",
    with_customer(
        f"""SELECT s."column", inferred_type AS data_type, round(min, 4) AS min, round(max, 4) AS max, allowed_values,
        CASE WHEN min IS NULL THEN 'mode' ELSE 'mean' END AS impute_strategy FROM ({GENERATED}) s
        LEFT JOIN ({allowed_sql("c", ("c_name", "c_mktsegment"), 25)}) a ON s."column" = a."column" """
    ),
)
def generate_standards(spark, folder):
    found = ge.generate_metadata(customer(spark, folder)).standards
    return rounded(found.withColumn("allowed_values", F.array_join("allowed_values", "|")))


DEFAULT_ENTRIES = ", ".join(f"('{c}', '{k}', '{v}')" for c, m in fv.DEFAULT_VALUE_MAPS.items() for k, v in m.items())


@query(
    "generate_value_maps",
    with_survey(
        f"""SELECT * FROM (VALUES {DEFAULT_ENTRIES}) d("column", raw, canonical) UNION ALL
        SELECT "column", value, value FROM ({levels_sql("survey", ("country", "region", "age", "gender", "channel", "purchase_intent", "status"))})
        WHERE ("column", value) NOT IN (SELECT ("column", raw) FROM (VALUES {DEFAULT_ENTRIES}) d("column", raw, canonical))"""
    ),
)
def generate_value_maps(spark, folder):
    return ge.generate_metadata(survey(spark, folder)).value_maps


@query(
    "generate_dictionary",
    with_survey(
        f"""SELECT s."column", inferred_type AS data_type, array_to_string(sample_values, '|') AS samples
        FROM ({stats_sql("survey", SURVEY_COLUMNS, 0.10)}) s JOIN ({samples_sql("survey", SURVEY_NAMES)}) v ON s."column" = v."column"
        WHERE s."column" <> 'spend'"""
    ),
)
def generate_dictionary(spark, folder):
    found = metadata.run(survey(spark, folder).drop("spend"))["data_dictionary"]
    return found.select("column", "data_type", F.array_join("sample_values", "|").alias("samples"))


# --- learned tables and memory ----------------------------------------------------


@query(
    "latest_override",
    """SELECT user_id, event_id, event_type, value FROM (
       SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
)
def latest_override(spark, folder):
    events = table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return me.latest(events, ["user_id"], "ts").drop("ts")


SURVEY_TEXT = ("survey_date", "country", "region", "age", "gender", "channel", "purchase_intent", "status")


@query(
    "level_suggestions",
    with_survey(
        f"""SELECT 'survey' AS dataset, "column", value AS raw_value, trim(value) AS suggested_value, 'review' AS status
        FROM ({levels_sql("survey", SURVEY_TEXT)}) WHERE ("column", value) NOT IN
        (SELECT ("column", raw) FROM (VALUES {", ".join(f"('{c}', '{k}')" for c, m in SURVEY_MAPS.items() for k in m)}) k("column", raw))"""
    ),
)
def level_suggestions(spark, folder):
    levels = lv.level_counts(survey(spark, folder), SURVEY_TEXT)
    return me.level_suggestions(levels, value_map_table(spark, SURVEY_MAPS), "survey")


@query(
    "upsert_mappings",
    """SELECT 'orders' AS table_name, CAST(o_custkey AS VARCHAR) AS source_column, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS target_column,
    0.5::DOUBLE AS confidence, 'auto' AS status FROM orders GROUP BY o_custkey""",
)
def upsert_mappings(spark, folder):
    orders = table(spark, folder, "orders")
    newest = me.latest(orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority"), ["o_custkey"], "o_orderdate")
    rows = newest.select(
        F.col("o_custkey").cast("string").alias("source_column"), F.col("o_orderpriority").alias("target_column"),
        F.lit(0.5).alias("confidence"), F.lit("auto").alias("status"), F.col("o_orderdate").cast("timestamp").alias("timestamp"),
    )
    existing = rows.select(
        F.lit("orders").alias("table_name"), "source_column", F.lit("old").alias("target_column"), "confidence", "status",
        (F.col("timestamp") - F.expr("INTERVAL 1 DAY")).alias("timestamp"),
    )
    return me.upsert_mappings(existing, rows, "orders").drop("timestamp")


@query(
    "schema_difference_history",
    """SELECT 'survey' AS dataset, count(*) AS days, strftime(min(o_orderdate), '%Y-%m-%d') AS first FROM (SELECT DISTINCT o_orderdate FROM orders)""",
)
def schema_difference_history(spark, folder):
    """One difference for each day with orders, learned in two runs, one of them repeated and one in a snapshot."""
    days, path = table(spark, folder, "orders").select(F.col("o_orderdate").cast("timestamp").alias("timestamp")).distinct(), scratch(spark, "diffs")
    found = me.difference_row(ma.column_table(vendor_survey(spark, folder)), SURVEY_SCHEMA, "survey")
    rows = days.crossJoin(F.broadcast(found))
    early = F.col("timestamp") < "1995-01-01"
    me.append(rows.where(early), path, "schema_diffs", "run 1")
    me.append(rows.where(early), path, "schema_diffs", "run 1")
    me.compact(spark, path, "schema_diffs")
    me.append(rows.where(~early), path, "schema_diffs", "run 2")
    me.append(rows.where(early), path, "schema_diffs", "run 1")
    history = me.load(spark, path, "schema_diffs")
    return history.groupBy("dataset").agg(F.count(F.lit(1)).alias("days"), F.date_format(F.min("timestamp"), "yyyy-MM-dd").alias("first"))


#: Orders after a delivery without keys to align by: some rows gone, some new, some with one or two changed cells.
DELIVERY = """SELECT o_orderkey + CASE WHEN o_orderkey % 17 = 3 THEN 100000000 ELSE 0 END AS o_orderkey,
    CASE WHEN o_orderkey % 17 = 3 THEN -1 ELSE o_custkey END AS o_custkey,
    CASE WHEN o_orderkey % 17 IN (3, 5) THEN 'X' WHEN o_orderkey % 17 = 7 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 17 IN (5, 9) THEN -1.0 ELSE o_totalprice END AS o_totalprice, o_orderpriority
    FROM {orders} WHERE o_orderkey % 17 <> 11"""


@query(
    "row_changes",
    f"""WITH a AS ({DELIVERY.format(orders="orders")}), d AS (
      SELECT b.o_orderkey AS before_key, a.o_orderkey AS after_key, a.o_orderstatus AS status,
             list_filter(['o_orderstatus', 'o_totalprice'], lambda c: CASE c WHEN 'o_orderstatus' THEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus ELSE a.o_totalprice <> b.o_totalprice END) AS c
      FROM orders b FULL JOIN a ON a.o_orderkey = b.o_orderkey)
    SELECT CASE WHEN after_key IS NULL THEN 'removed' WHEN before_key IS NULL THEN 'added' ELSE 'changed' END AS change,
           CASE WHEN after_key IS NULL OR before_key IS NULL THEN '' ELSE array_to_string(c, '|') END AS columns, before_key, after_key, status
    FROM d WHERE after_key IS NULL OR before_key IS NULL OR len(c) > 0""",
)
def row_changes(spark, folder):
    orders = table(spark, folder, "orders")
    before = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    after = spark.sql(DELIVERY, orders=orders).repartition(7, F.xxhash64("o_totalprice"))
    found = unkeyed.row_changes(before, after)
    return found.select("change", F.array_join("columns", "|").alias("columns"), F.col("before.o_orderkey").alias("before_key"), F.col("after.o_orderkey").alias("after_key"), F.col("after.o_orderstatus").alias("status"))


@query(
    "learned_tables",
    f"""SELECT 'level' AS kind, "column" AS name, value AS detail FROM ({levels_sql("orders", ("o_orderstatus", "o_orderpriority"))})
    UNION ALL SELECT 'dataset', 'orders', CAST(count(*) AS VARCHAR) FROM orders""",
)
def learned_tables(spark, folder):
    orders, path = table(spark, folder, "orders"), scratch(spark, "learned")
    names = ("o_orderstatus", "o_orderpriority")
    for _ in range(2):  # the latest view shows each row once
        me.append(me.level_suggestions(lv.level_counts(orders, names), value_map_table(spark, {"a": {"b": "c"}}), "orders"), path, "level_suggestions")
        me.append(me.dataset_row(orders, "orders"), path, "datasets")
    levels = me.latest_table(spark, path, "level_suggestions").selectExpr("'level' AS kind", "column AS name", "raw_value AS detail")
    return levels.unionByName(
        me.latest_table(spark, path, "datasets").selectExpr("'dataset' AS kind", "dataset AS name", "CAST(rows AS STRING) AS detail")
    )


DISTANCE = "power(list_distance(q.vector::DOUBLE[], e.embedding::DOUBLE[]), 2)"


def nearest_sql(queries: str, k: int, threshold: float, where: str = "true") -> str:
    return f"""SELECT query_id, memory_id, round(distance, 6) AS distance, round(similarity, 6) AS similarity, rank FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, memory_id) AS INTEGER) AS rank, 1 / (1 + distance) AS similarity
        FROM (SELECT query_id, vec_id AS memory_id, {DISTANCE} AS distance FROM ({queries}) q, embeddings e WHERE {where}))
        WHERE rank <= {k} AND similarity >= {threshold}"""


CENTROIDS = """SELECT label::BIGINT AS query_id, list(m ORDER BY i) AS vector FROM (
    SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label"""


@query("nearest_to_centroids", nearest_sql(CENTROIDS, 5, 0.5))
def nearest_to_centroids(spark, folder):
    embeddings = table(spark, folder, "embeddings")
    parts = embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(
        F.avg(F.col("x").cast("double")).alias("m")
    )
    queries = parts.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("v")).select(
        F.col("label").cast("bigint").alias("query_id"), F.transform("v", lambda e: e["m"]).alias("vector")
    )
    memory = embeddings.select(F.col("vec_id").alias("memory_id"), F.col("embedding").alias("vector"))
    return rounded(me.nearest(memory, queries, 5, 0.5), 6)


@query("nearest_mappings", nearest_sql("SELECT vec_id AS query_id, embedding AS vector FROM embeddings", 3, 0.45))
def nearest_mappings(spark, folder):
    embeddings = table(spark, folder, "embeddings")
    memory = embeddings.select(F.col("vec_id").alias("memory_id"), F.col("embedding").alias("vector"))
    return rounded(me.nearest(memory, memory.withColumnRenamed("memory_id", "query_id"), 3, 0.45), 6)


@query("suggested_mapping", nearest_sql(CENTROIDS, 1, 0.5))
def suggested_mapping(spark, folder):
    embeddings = table(spark, folder, "embeddings")
    parts = embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(
        F.avg(F.col("x").cast("double")).alias("m")
    )
    queries = parts.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("v")).select(
        F.col("label").cast("bigint").alias("query_id"), F.transform("v", lambda e: e["m"]).alias("vector")
    )
    memory = embeddings.select(F.col("vec_id").alias("memory_id"), F.col("embedding").alias("vector"))
    return rounded(me.suggest(memory, queries, threshold=0.5), 6)


@query(
    "memory_rows",
    """SELECT p_name AS source_column, p_brand AS target_column, p_size / 50.0::DOUBLE AS confidence,
    p_name || ' maps to ' || p_brand || ' (type: ' || p_type || ')' AS text FROM part WHERE p_size / 50.0::DOUBLE >= 0.8""",
)
def memory_rows(spark, folder):
    mappings = table(spark, folder, "part").select(
        F.col("p_name").alias("source_column"), F.col("p_brand").alias("target_column"),
        (F.col("p_size") / 50.0).alias("confidence"), "p_type",
    )
    return me.memory_rows(me.learnable(mappings), F.col("p_type")).drop("p_type")


@query("memory_statistics", "SELECT count(*) AS total_mappings, 0.75::DOUBLE AS similarity_threshold FROM embeddings")
def memory_statistics(spark, folder):
    return me.memory_statistics(table(spark, folder, "embeddings"))


# --- whole runs -------------------------------------------------------------------

LOCAL_SQL = f"""SELECT respondent_id, strftime(try_strptime(survey_date, '%d/%m/%Y'), '%Y-%m-%d') AS survey_date,
    {case_sql("lower(trim(country))", fv.COUNTRY_CODES, "upper(trim(country))")} AS country,
    {case_sql("lower(trim(region))", fv.REGION_CODES, "upper(trim(region))")} AS region, replace(trim(age), '-', ' > ') AS age,
    coalesce(gender, 'Unknown') AS gender,
    round((coalesce(satisfaction_score, (SELECT avg(satisfaction_score) FROM survey)) - 1) / 4 * 100, 1)::DOUBLE AS satisfaction_score,
    round(coalesce(nps_score, (SELECT avg(nps_score) FROM survey))::DOUBLE, 4) AS nps_score,
    round(coalesce(spend, (SELECT avg(spend) FROM survey)), 4) AS spend,
    {case_sql("lower(coalesce(channel, 'Unknown'))", fv.CATEGORY_CODES, "lower(coalesce(channel, 'Unknown'))")} AS channel,
    purchase_intent, {case_sql("lower(status)", fv.CATEGORY_CODES, "lower(status)")} AS status FROM survey"""


@query("local_harmonize", with_survey(LOCAL_SQL))
def local_harmonize(spark, folder):
    return rounded(local.harmonize(survey(spark, folder), local.Options(scale_conversion="1-5")))


@query(
    "local_run_score",
    with_survey(
        """SELECT count(*) AS rows, 12::BIGINT AS columns, 0::DOUBLE AS missing_pct, 0::BIGINT AS duplicates, 100::DOUBLE AS quality_score FROM survey"""
    ),
)
def local_run_score(spark, folder):
    return rounded(local.run(survey(spark, folder))["score"])


@query(
    "single_source_comparison",
    with_survey(
        f"""SELECT * FROM (SELECT 'gender' AS "column", count(*) FILTER (a.gender IS DISTINCT FROM b.gender) AS values_changed FROM survey a JOIN h b USING (respondent_id)
        UNION ALL SELECT 'channel', count(*) FILTER (a.channel IS DISTINCT FROM b.channel) FROM survey a JOIN h b USING (respondent_id)
        UNION ALL SELECT 'purchase_intent', count(*) FILTER (a.purchase_intent IS DISTINCT FROM b.purchase_intent) FROM survey a JOIN h b USING (respondent_id)
        UNION ALL SELECT 'country', count(*) FILTER (a.country IS DISTINCT FROM b.country) FROM survey a JOIN h b USING (respondent_id))"""
    ).replace("WITH survey AS", f"WITH h AS (WITH survey AS ({SURVEY_SQL}) {HARMONIZED_SQL}), survey AS"),
)
def single_source_comparison(spark, folder):
    result = single_source.run(vendor_survey(spark, folder), SURVEY_SCHEMA, SURVEY_MAPS, keys=["respondent_id"])
    return result["comparison"].where(F.col("column").isin("gender", "channel", "purchase_intent", "country")).drop("change_pct")


@query(
    "harmonization_summary",
    with_survey(
        """SELECT count(*) AS input_records, count(*) AS output_records, 0::BIGINT AS records_dropped, 9::BIGINT AS columns_without_failure,
        0::BIGINT AS records_failed, 1::DOUBLE AS confidence_score, 'weight' AS columns_added, 'region|spend|status' AS columns_removed FROM survey"""
    ),
)
def harmonization_summary(spark, folder):
    found = single_source.run(vendor_survey(spark, folder), SURVEY_SCHEMA, SURVEY_MAPS)["harmonization"]
    return found.select(
        "input_records", "output_records", "records_dropped", "columns_without_failure", "records_failed", "confidence_score",
        F.array_join("columns_added", "|").alias("columns_added"), F.array_join("columns_removed", "|").alias("columns_removed"),
    )


MARKET_SCHEMA = MasterSchema(
    "orders", "1", (
        ColumnSpec("record_id", "record_id", "integer", is_key=True),
        ColumnSpec("market", "market", "categorical"), ColumnSpec("spend", "spend", "float"), ColumnSpec("score", "score", "float"),
    ),
)
TWO = """SELECT o_orderkey AS record_id, CASE o_custkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'GERMANY' ELSE 'Elsewhere' END AS market,
    CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS spend, CAST((o_orderkey * 7) % 11 AS DOUBLE) AS score FROM {orders} WHERE {where}"""
MARKET_CASE = "CASE market WHEN 'US' THEN 'USA' WHEN 'GERMANY' THEN 'Germany' ELSE market END"
MULTI_SQL = f"""WITH h0 AS ({TWO.format(orders="orders", where="o_orderdate < TIMESTAMP '1998-01-01'")}),
    c0 AS ({TWO.format(orders="orders", where="o_orderdate >= TIMESTAMP '1998-01-01'")}),
    h AS (SELECT record_id, {MARKET_CASE} AS market, coalesce(spend, (SELECT avg(spend) FROM h0)) AS spend, score FROM h0),
    c AS (SELECT record_id, {MARKET_CASE} AS market, coalesce(spend, (SELECT avg(spend) FROM c0)) AS spend, score FROM c0),
    m AS (SELECT market, avg(spend) AS a1, stddev_samp(spend) AS a2, avg(score) AS a3, stddev_samp(score) AS a4 FROM h GROUP BY market),
    r AS (SELECT market, avg(spend) AS b1, stddev_samp(spend) AS b2, avg(score) AS b3, stddev_samp(score) AS b4 FROM c GROUP BY market),
    cal AS (SELECT record_id, market, (spend - a1) / a2 * b2 + b1 AS spend, (score - a3) / a4 * b4 + b3 AS score FROM h JOIN m USING (market) JOIN r USING (market))"""


def two_sources(spark, folder):
    orders = table(spark, folder, "orders")
    early, late = "o_orderdate < TIMESTAMP '1998-01-01'", "o_orderdate >= TIMESTAMP '1998-01-01'"
    return {
        "historical": spark.sql(TWO.replace("{where}", early), orders=orders),
        "current": spark.sql(TWO.replace("{where}", late), orders=orders),
    }


@query(
    "multi_source_combined",
    MULTI_SQL + " SELECT record_id, market, round(spend, 4) AS spend, round(score, 4) AS score FROM (SELECT * FROM cal UNION ALL SELECT * FROM c)",
)
def multi_source_combined(spark, folder):
    return rounded(multi_source.run(two_sources(spark, folder), MARKET_SCHEMA)["combined"])


@query(
    "multi_source_markets",
    MULTI_SQL + """ SELECT market, round(avg(spend), 4) AS spend, round(avg(score), 4) AS score, dataset FROM
    (SELECT *, 'historical' AS dataset FROM cal UNION ALL SELECT *, 'current' FROM c) GROUP BY market, dataset""",
)
def multi_source_markets(spark, folder):
    return rounded(multi_source.run(two_sources(spark, folder), MARKET_SCHEMA)["market_comparison"].drop("record_id"))


@query(
    "incremental_stream",
    """SELECT event_id, user_id, upper(event_type) AS event_type, round((value - lo) / (hi - lo) * 100, 4) AS value FROM events,
    (SELECT min(value) AS lo, max(value) AS hi FROM events)""",
)
def incremental_stream(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    facts = fit_facts(events, ["value"])["value"]
    fit = tf.ScaleFit(facts.low, facts.high, 0.0, 100.0)
    sources = {c: c for c in events.columns}
    transforms = {
        "value": tf.Transform("scale_normalize", {"fit": fit}),
        "event_type": tf.Transform("string_standardize", {"operations": ["strip", "uppercase"]}),
    }
    arrived = scratch(spark, "arrived")
    events.write.parquet(arrived)
    out = scratch(spark, "stream")
    incremental.start(
        incremental.read_stream(spark, arrived, events.schema, "parquet"),
        [lambda batch: tf.apply_transforms(batch, sources, transforms)],
        f"{out}/data", f"{out}/checkpoint", [va.Rule("value", max=50)], f"{out}/flags", record_id="event_id",
    ).awaitTermination()
    return rounded(spark.read.parquet(f"{out}/data").drop("query_id", "batch_id"))


def percentile_stream(spark, folder):
    """The events in three files, one micro-batch each, on a percentile scale with frozen ranks."""
    events = table(spark, folder, "events").select("event_id", "value")
    fit = tf.freeze_scales(events, tf.fit_scales(events, {"value": (0.0, 100.0)}))
    arrived, out = scratch(spark, "arrived"), scratch(spark, "stream")
    for part in range(3):
        events.where(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(arrived)
    incremental.start(
        incremental.read_stream(spark, arrived, events.schema, "parquet", max_files=1), [lambda batch: tf.apply_scales(batch, fit)],
        f"{out}/data", f"{out}/checkpoint", [va.Rule("value", max=50)], f"{out}/flags", record_id="event_id",
    ).awaitTermination()
    return out


@query("incremental_percentile", f"SELECT event_id, value, (SELECT 3::BIGINT) AS batches FROM ({PERCENTILE_SQL})")
def incremental_percentile(spark, folder):
    data = spark.read.parquet(f"{percentile_stream(spark, folder)}/data")
    batches = data.agg(F.count_distinct("batch_id").alias("batches"))
    return rounded(data.select("event_id", "value")).join(F.broadcast(batches))


@query("incremental_flags", f"""SELECT CAST(event_id AS VARCHAR) AS record_id, 'value' AS "column" FROM ({PERCENTILE_SQL.replace("round(avg_rank / n * 100, 4)", "avg_rank / n * 100")}) WHERE value > 50""")
def incremental_flags(spark, folder):
    return spark.read.parquet(f"{percentile_stream(spark, folder)}/flags").select("record_id", "column")
