"""Queries for names, learned tables, reports and documents, all over table data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.profiles import CUSTOMER_COLUMNS, _descriptive, descriptive_sql
from checks.registry import CUSTOMER_SQL, customer, query, table, with_customer
from checks.transforms import BROKEN_DATES
from tablemeld import columns as cols
from tablemeld.functions import text as tx
from tablemeld.operators import compare as cp, generate as ge, levels as lv, match as ma, memory as me, profile as pr, transform as tf, validate as va
from tablemeld.sources import metadata as md, tables as st
from tablemeld.sources.metadata import ColumnSpec, MasterSchema
from tablemeld.storage import shared_folder


def scratch(spark, label: str) -> str:
    return f"{shared_folder(spark)}/tablemeld/{label}-{uuid.uuid4().hex}"


def headed(spark, folder, *headers: str):
    return table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal").toDF(*headers)


@query("standard_names", "SELECT s_suppkey AS supplier_no, s_name AS name, s_nationkey AS name_2, s_acctbal AS balance__eur FROM supplier")
def standard_names(spark, folder):
    return tf.standardize_names(headed(spark, folder, " Supplier  No.", "Name", "NAME!", "Balance (_EUR)"))


@query("snake_names", "SELECT s_suppkey AS supplier_key, s_name AS full_name, s_nationkey AS nation_code, s_acctbal AS acct_bal FROM supplier")
def snake_names(spark, folder):
    return tf.snake_case_names(headed(spark, folder, "supplierKey", "Full Name", "nation-code", "__acctBal"))[0]


@query("unique_names", "SELECT s_suppkey AS a, s_name AS a_dup1, s_nationkey AS b, s_acctbal AS a_dup2 FROM supplier")
def unique_names(spark, folder):
    return tf.deduplicate_names(headed(spark, folder, "a", "a", "b", "a"))


@query("headers_schema", "SELECT s_suppkey AS supplier_key, s_name AS full_name, s_nationkey AS nation_code, s_acctbal AS acct_bal FROM supplier")
def headers_schema(spark, folder):
    """Every value of the table under the name that the schema of its headers gives it."""
    rows = headed(spark, folder, "supplierKey", "Full Name", "nation-code", "__acctBal")
    schema = md.schema_of(ge.schema_from_headers(rows))
    mapped = ma.match_columns(ma.column_table(rows), schema)
    return tf.project_mapping(rows, [(r["source_column"], r["target_column"]) for r in mapped.collect()])[0]


@query(
    "schema_difference",
    """SELECT 'events' AS dataset, 'refund' AS missing_in_source,
    (SELECT string_agg(DISTINCT event_type, '|' ORDER BY event_type) FROM events WHERE event_type NOT IN ('click', 'purchase')) AS extra_in_source""",
)
def schema_difference(spark, folder):
    found = table(spark, folder, "events").select(F.col("event_type").alias("source_column")).distinct()
    schema = MasterSchema("types", "1", (ColumnSpec("click", "click"), ColumnSpec("purchase", "purchase"), ColumnSpec("refund", "refund")))
    row = ma.schema_difference(found, schema, "events")
    return row.select("dataset", *[F.array_join(c, "|").alias(c) for c in ("missing_in_source", "extra_in_source")])


def changed_sql(column: str, change: str, before: str, after: str) -> str:
    count = lambda e, where: f"(SELECT count(DISTINCT {e}) FROM supplier{where})" if e else "0"
    return f"""SELECT '{column}' AS "column", '{change}' AS change, {count(before, "")}::BIGINT AS values_before, {count(after, " WHERE s_acctbal > 0")}::BIGINT AS values_after"""


@query(
    "column_changes",
    " UNION ALL ".join([
        *(changed_sql(c, "common", c, c) for c in ("s_suppkey", "s_nationkey", "s_acctbal")),
        changed_sql("s_name", "removed", "s_name", ""), changed_sql("is_rich", "added", "", "s_acctbal > 5000"),
    ]),
)
def column_changes(spark, folder):
    """Columns added, removed and common, with the values that each has before and after."""
    before = headed(spark, folder, "s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    after = before.where("s_acctbal > 0").drop("s_name").withColumn("is_rich", F.col("s_acctbal") > 5000)
    held = [
        lv.level_counts(df).groupBy("column").agg(F.count(F.lit(1)).alias(f"values_{name}")) for df, name in ((before, "before"), (after, "after"))
    ]
    found = cp.column_changes(before, after).join(held[0], "column", "left").join(held[1], "column", "left")
    return found.fillna(0, ["values_before", "values_after"])


@query(
    "replayed_overrides",
    """SELECT event_type AS "column", arg_max('fill ' || user_id, (ts, event_id)) AS strategy FROM events GROUP BY event_type""",
)
def replayed_overrides(spark, folder):
    events = table(spark, folder, "events")
    newest = events.groupBy("event_type", "ts").agg(F.max_by("user_id", "event_id").alias("user_id"))
    history = newest.select(
        F.col("event_type").alias("column"), F.concat(F.lit("fill "), F.col("user_id").cast("string")).alias("strategy"),
        F.lit("user").alias("source"), F.col("ts").cast("timestamp").alias("timestamp"),
    )
    return spark.createDataFrame(list(me.replay_overrides(history).items()), "column string, strategy string")


@query(
    "replayed_format_fixes",
    f"""SELECT o_orderkey, replace(order_date, ' > ', '-') AS order_date
    FROM ({BROKEN_DATES.format(date="strftime(o_orderdate, '%Y > %m > %d')", orders="orders")})""",
)
def replayed_format_fixes(spark, folder):
    dates = spark.sql(
        BROKEN_DATES.replace("{date}", "date_format(o_orderdate, 'yyyy > MM > dd')"), orders=table(spark, folder, "orders")
    )
    path = scratch(spark, "fixes")
    me.append(me.format_fix_row(spark, "order_date", "odd separator", " > becomes -"), path, "learned_format_fixes")
    return me.replay_format_fixes(dates, me.load(spark, path, "learned_format_fixes"))


@query("confirmed_levels", "SELECT c_mktsegment AS source_column, lower(c_mktsegment) AS target_column, count(*) AS rows FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY c_mktsegment")
def confirmed_levels(spark, folder):
    counted = table(spark, folder, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("rows"))
    decisions = {r[0]: {"action": "skip" if r[0] == "BUILDING" else "map_to", "target": r[0].lower()} for r in counted.collect()}
    found = me.confirmed_mappings(spark, decisions).select("source_column", "target_column")
    return found.join(counted, found["source_column"] == counted["c_mktsegment"]).select("source_column", "target_column", "rows")


@query("raw_snapshot", with_customer(descriptive_sql("c", "unclean_input", CUSTOMER_COLUMNS)))
def raw_snapshot(spark, folder):
    """The statistics of a snapshot, after a report was written and read again."""
    snapshot = ge.raw_snapshot(customer(spark, folder))
    target = scratch(spark, "report")
    paths = st.write_report({"descriptive_stats": snapshot["descriptive_stats"]}, target)
    schema = snapshot["descriptive_stats"].schema
    return _descriptive(spark.read.schema(schema).json(paths[0]))


@query(
    "baseline_statistics",
    f"""WITH c AS ({CUSTOMER_SQL}) SELECT 'baseline' AS dataset, 'c_acctbal' AS "column", min(c_acctbal) AS min, max(c_acctbal) AS max FROM c
    UNION ALL SELECT 'baseline', 'c_name', NULL, NULL""",
)
def baseline_statistics(spark, folder):
    bounds = customer(spark, folder).agg(F.min("c_acctbal").cast("string").alias("min"), F.max("c_acctbal").cast("string").alias("max"))
    stored = bounds.select(F.lit("c_acctbal").alias("column"), "min", "max").unionByName(
        spark.createDataFrame([("c_name", "-", "-")], "column string, min string, max string")
    )
    path = scratch(spark, "baseline") + ".csv"
    st.write_table(stored, path)
    return st.read_statistics(spark, path).select("dataset", "column", "min", "max")


@query(
    "loaded_rules",
    """WITH b AS (SELECT median(p_retailprice) AS top FROM part) SELECT "column", issue_type, count(*) AS flags FROM (
    SELECT 'p_retailprice' AS "column", 'out_of_range' AS issue_type FROM part, b WHERE p_retailprice > top) GROUP BY ALL""",
)
def loaded_rules(spark, folder):
    parts = table(spark, folder, "part")
    top = parts.agg(F.median("p_retailprice")).first()[0]
    path = md.save_document(spark, md.rules_document([va.Rule("p_retailprice", max=top)]), scratch(spark, "rules") + ".json")
    flags = va.apply_rules(parts, md.load_rules(spark, path), "part", "p_partkey")
    return va.flag_counts(flags).select("column", F.lit("out_of_range").alias("issue_type"), "flags")


@query(
    "one_column",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'construction' WHEN 'MACHINERY' THEN 'industry' ELSE c_mktsegment END AS segment, trim(c_name) AS name FROM customer""",
)
def one_column(spark, folder):
    entries = {"BUILDING": "construction", "MACHINERY": "industry"}
    return table(spark, folder, "customer").select(
        "c_custkey", tf.harmonize_column(F.col("c_mktsegment"), entries).alias("segment"), tf.harmonize_column(F.col("c_name")).alias("name")
    )


@query(
    "loose_matches",
    """SELECT event_type, count(*) AS rows, contains('click', lower(event_type)) OR contains(lower(event_type), 'click') OR contains('pageview', lower(event_type))
    OR contains(lower(event_type), 'pageview') AS known FROM events GROUP BY event_type""",
)
def loose_matches(spark, folder):
    known = tx.loosely_equal(F.col("event_type"), ["Click", "page_view"])
    return table(spark, folder, "events").groupBy("event_type", known.alias("known")).agg(F.count(F.lit(1)).alias("rows"))


@query("type_counts", "SELECT data_type, count(*) AS columns, sum(present)::BIGINT AS present FROM (" + " UNION ALL ".join(
    f"SELECT '{t}' AS data_type, count({c}) AS present FROM events"
    for c, t in (("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("props", "string"))
) + ") GROUP BY data_type")
def type_counts(spark, folder):
    """Columns of each storage type, and the cells that they fill."""
    events = table(spark, folder, "events")
    filled = pr.column_statistics(events, approx=True).groupBy("data_type").agg(F.sum("non_null_count").alias("present"))
    return cols.type_counts(events).join(filled, "data_type")
