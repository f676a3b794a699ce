"""Profiling, quality and assessment queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.registry import (
    CUSTOMER_SQL, SURVEY_SQL, customer, query, rounded, survey, table, with_customer, with_survey,
)
from tablemeld.operators import levels as lv, profile as pr, quality as ql, validate as va
from tablemeld.operators.counted import Counts, CountStore
from tablemeld.plans.reports import quality_analysis
from tablemeld.storage import shared_folder


def scratch(spark, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/checks/{label}-{uuid.uuid4().hex}"

CUSTOMER_COLUMNS = (
    ("c_custkey", "bigint", "integer"), ("c_name", "string", "string"),
    ("c_nationkey", "int", "integer"), ("c_acctbal", "double", "float"),
    ("c_mktsegment", "string", "string"),
)
SURVEY_COLUMNS = (
    ("respondent_id", "bigint", "integer"), ("survey_date", "string", "string"),
    ("country", "string", "string"), ("region", "string", "string"), ("age", "string", "string"),
    ("gender", "string", "string"), ("satisfaction_score", "bigint", "integer"),
    ("nps_score", "bigint", "integer"), ("spend", "double", "float"), ("channel", "string", "string"),
    ("purchase_intent", "string", "string"), ("status", "string", "string"),
)


def stats_sql(source: str, columns, share: float = 0.05) -> str:
    """Column statistics of a relation, one row per column."""
    parts = []
    for name, spark_type, kind in columns:
        number = kind in ("integer", "float")
        text = kind == "string"
        n = f"CAST({name} AS DOUBLE)" if number else "NULL::DOUBLE"
        length = f"length({name})" if text else "NULL::INTEGER"
        parts.append(
            f"""SELECT '{name}' AS "column", '{spark_type}' AS data_type, '{kind}' AS kind,
            count(*) AS total_count, count({name}) AS non_null_count,
            count(*) - count({name}) AS null_count, count(DISTINCT {name}) AS unique_count,
            avg({n}) AS mean, stddev_samp({n}) AS std, min({n}) AS min, max({n}) AS max,
            median({n}) AS median, avg({length})::DOUBLE AS avg_length,
            max({length})::INTEGER AS max_length, min({length})::INTEGER AS min_length
            FROM {source}"""
        )
    return f"""SELECT "column", data_type,
        CASE WHEN kind = 'string' AND non_null_count > 0 AND unique_count / non_null_count < {share}
             THEN 'categorical' ELSE kind END AS inferred_type,
        total_count, non_null_count, null_count, round(null_count / total_count * 100, 2) AS null_pct,
        unique_count, round(unique_count / non_null_count * 100, 2) AS unique_pct,
        mean, std, min, max, median, avg_length, max_length, min_length
        FROM ({' UNION ALL '.join(parts)})"""


def rounded_sql(inner: str, columns: str, digits: int = 4) -> str:
    listed = ", ".join(f"round({c}, {digits}) AS {c}" for c in columns.split())
    return f"SELECT * REPLACE ({listed}) FROM ({inner})"


STATS_DOUBLES = "null_pct unique_pct mean std min max median avg_length"


@query("column_statistics", with_customer(rounded_sql(stats_sql("c", CUSTOMER_COLUMNS), STATS_DOUBLES)))
def column_statistics(spark, folder):
    return rounded(pr.column_statistics(customer(spark, folder)).drop("ord"))


LINEITEM_COLUMNS = (
    ("l_orderkey", "bigint", "integer"), ("l_partkey", "bigint", "integer"),
    ("l_linenumber", "int", "integer"), ("l_quantity", "double", "float"),
    ("l_extendedprice", "double", "float"), ("l_discount", "double", "float"),
    ("l_returnflag", "string", "string"), ("l_linestatus", "string", "string"),
    ("l_suppkey", "bigint", "integer"), ("l_tax", "double", "float"), ("l_shipdate", "timestamp_ntz", "datetime"),
)


@query(
    "column_statistics_lineitem",
    rounded_sql(stats_sql("lineitem", LINEITEM_COLUMNS), STATS_DOUBLES),
)
def column_statistics_lineitem(spark, folder):
    return rounded(pr.column_statistics(table(spark, folder, "lineitem")).drop("ord"))


EVENT_COLUMNS = (
    ("event_id", "bigint", "integer"), ("ts", "timestamp_ntz", "datetime"), ("user_id", "bigint", "integer"),
    ("event_type", "string", "string"), ("value", "double", "float"), ("props", "string", "string"),
)


def event_counts(spark, folder) -> Counts:
    """Counts of events from three increments; the second is counted twice, as after a failure, and a snapshot holds the first two."""
    events = table(spark, folder, "events")
    store = CountStore(spark, scratch(spark, "event-counts"))
    part = lambda k: events.where(F.col("event_id") % 3 == k)
    store.add(part(0), "day 1")
    store.add(part(1).limit(5), "day 2")
    store.add(part(1), "day 2")
    store.compact()
    store.add(part(1), "day 2")
    store.add(part(2), "day 3")
    return store.counts()


@query("merged_fit", rounded_sql(stats_sql("events", EVENT_COLUMNS), STATS_DOUBLES))
def merged_fit(spark, folder):
    return rounded(pr.column_statistics(table(spark, folder, "events"), counts=event_counts(spark, folder)).drop("ord"))


@query(
    "merged_ranks",
    """SELECT value, count(*) AS row_count, (max(last) - (count(*) - 1) / 2) / max(n) AS percentile_rank FROM (
       SELECT value, rank() OVER (ORDER BY value) + count(*) OVER (PARTITION BY value) - 1 AS last, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
       GROUP BY value""",
)
def merged_ranks(spark, folder):
    return event_counts(spark, folder).percentile_ranks("value")


@query(
    "merged_modes",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", (SELECT CAST({c} AS VARCHAR) FROM events WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode,
        (SELECT round(quantile_cont({c}, 0.25), 4) FROM events) AS q1, (SELECT round(quantile_cont({c}, 0.75), 4) FROM events) AS q3"""
        for c in ("event_id", "user_id")
    ),
)
def merged_modes(spark, folder):
    counts = event_counts(spark, folder)
    modes, quartiles = counts.modes(), counts.quartiles()
    rows = [(c, modes[c], round(quartiles[c][0.25], 4), round(quartiles[c][0.75], 4)) for c in ("event_id", "user_id")]
    return spark.createDataFrame(rows, "column string, mode string, q1 double, q3 double")


def levels_sql(source: str, names) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS count
            FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}"""
        for c in names
    )


def top_sql(source: str, names, k: int) -> str:
    return f"""SELECT "column", rank, value, count FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS INTEGER) AS rank
        FROM ({levels_sql(source, names)})) WHERE rank <= {k}"""


EVENT_NAMES = ("user_id", "event_type", "props")


@query("top_values", top_sql("events", EVENT_NAMES, 10))
def top_values(spark, folder):
    return lv.top_values(lv.level_counts(table(spark, folder, "events"), EVENT_NAMES), 10)


@query(
    "unique_counts_and_modes",
    f"""SELECT "column", count(*) AS unique_count,
        arg_max(value, (count, -hash_order)) AS mode
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY CASE WHEN "column" = 'user_id' THEN CAST(value AS DOUBLE) END, value) AS BIGINT) AS hash_order
              FROM ({levels_sql("events", EVENT_NAMES[:1] + EVENT_NAMES[1:2])})) GROUP BY "column" """,
)
def unique_counts_and_modes(spark, folder):
    names = EVENT_NAMES[:2]
    return lv.level_summary(lv.level_counts(table(spark, folder, "events"), names), ["user_id"])


def null_sum(names) -> str:
    return " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in names)


SURVEY_NAMES = tuple(c for c, _, _ in SURVEY_COLUMNS)


@query(
    "missing_histogram",
    with_survey(
        f"""SELECT CAST({null_sum(SURVEY_NAMES)} AS INTEGER) AS missing_fields, count(*) AS rows
        FROM survey GROUP BY 1 ORDER BY rows DESC, 1 LIMIT 10"""
    ),
)
def missing_histogram(spark, folder):
    return pr.missing_histogram(survey(spark, folder))


def missing_sql(source: str, names) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
            round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct FROM {source}"""
        for c in names
    )


#: Gaps as NaN, which count as missing.
NAN = "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN {nan} WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value FROM {events}"
NAN_SQL = NAN.format(nan="NULL", events="events")


@query(
    "nan_statistics",
    f"""SELECT count(*) - count(value) AS null_count, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(max(value), 4) AS max_value,
    count(DISTINCT value) AS unique_count FROM ({NAN_SQL})""",
)
def nan_statistics(spark, folder):
    gaps = spark.sql(NAN.replace("{nan}", "double('NaN')"), events=table(spark, folder, "events"))
    found = pr.column_statistics(gaps).where("column = 'value'")
    return rounded(found.select("null_count", "mean", "median", F.col("max").cast("double").alias("max_value"), "unique_count"))


@query("missing_by_column", with_survey(missing_sql("survey", SURVEY_NAMES)))
def missing_by_column(spark, folder):
    return pr.missing_by_column(survey(spark, folder))


@query(
    "missing_summary",
    with_survey(
        f"""SELECT * FROM ({missing_sql("survey", SURVEY_NAMES)}) WHERE missing_count > 0
        ORDER BY missing_count DESC, "column" LIMIT 20"""
    ),
)
def missing_summary(spark, folder):
    return pr.missing_summary(survey(spark, folder))


NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey")


def corr_sql(source: str, names) -> str:
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    rows = " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS correlation FROM {source}"
        for a, b in pairs
    )
    return f"""SELECT column_a, column_b, round(correlation, 6) AS correlation FROM ({rows})
        ORDER BY abs(correlation) DESC LIMIT 10"""


DIRTY_LINEITEM = """SELECT CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
    CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
    l_discount, l_tax, l_linenumber, l_suppkey FROM {lineitem}"""


@query(
    "correlations",
    f"WITH l AS ({DIRTY_LINEITEM.format(lineitem='lineitem')}) {corr_sql('l', NUMBERS)}",
)
def correlations(spark, folder):
    lineitem = spark.sql(DIRTY_LINEITEM, lineitem=table(spark, folder, "lineitem"))
    return rounded(pr.correlations(lineitem), 6)


#: Twenty-four columns, gaps in different rows of each: more pairs than one aggregate holds.
WIDE = {
    f"{c[2:]}_{m}": f"CASE WHEN l_orderkey % {m} <> 0 THEN CAST({c} AS DOUBLE) * {m} + l_linenumber % {m} END"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_partkey") for m in (2, 3, 5, 7, 11, 13)
}


@query(
    "correlations_wide",
    f"WITH w AS (SELECT {', '.join(f'{e} AS {c}' for c, e in WIDE.items())} FROM lineitem) "
    + " UNION ALL ".join(f"""SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS correlation FROM w""" for i, a in enumerate(WIDE) for b in list(WIDE)[i + 1:]),
)
def correlations_wide(spark, folder):
    wide = table(spark, folder, "lineitem").select(*[F.expr(e).alias(c) for c, e in WIDE.items()])
    return rounded(pr.correlations(wide, None), 6)


def descriptive_sql(source: str, dataset: str, columns) -> str:
    parts = []
    for name, _, kind in columns:
        number = kind in ("integer", "float")
        v = f"CAST({name} AS DOUBLE)"
        ranked = f"""SELECT {v if number else name} AS v, count(*) AS n FROM {source}
                     WHERE {name} IS NOT NULL GROUP BY 1"""
        mode = f"(SELECT v FROM ({ranked}) ORDER BY n DESC, v LIMIT 1)"
        bands = """CASE WHEN lo >= 0 AND hi <= 1 THEN '0-1' WHEN lo >= 1 AND hi <= 5 THEN '1-5'
            WHEN lo >= 0 AND hi <= 10 THEN '0-10' WHEN lo >= 0 AND hi <= 100 THEN '0-100' ELSE 'mixed' END"""
        if number:
            parts.append(
                f"""SELECT '{name}' AS "column", '{kind}' AS kind, total, present, levels, mean, median,
                CAST(NULL AS VARCHAR) AS text_mode, {mode} AS number_mode, lo AS min, hi AS max, std,
                (SELECT count(*) FROM {source} WHERE abs(({v} - mean) / CASE WHEN std = 0 THEN 1 ELSE std END) > 3)
                    AS outlier_count, {bands} AS scale_consistency
                FROM (SELECT count(*) AS total, count({name}) AS present, count(DISTINCT {name}) AS levels,
                      avg({v}) AS mean, median({v}) AS median, min({v}) AS lo, max({v}) AS hi,
                      stddev_samp({v}) AS std FROM {source})"""
            )
        else:
            parts.append(
                f"""SELECT '{name}' AS "column", '{kind}' AS kind, count(*) AS total, count({name}) AS present,
                count(DISTINCT {name}) AS levels, NULL::DOUBLE AS mean, NULL::DOUBLE AS median,
                {mode} AS text_mode, NULL::DOUBLE AS number_mode, NULL::DOUBLE AS min, NULL::DOUBLE AS max,
                NULL::DOUBLE AS std, NULL::BIGINT AS outlier_count, NULL::VARCHAR AS scale_consistency
                FROM {source}"""
            )
    return f"""SELECT '{dataset}' AS dataset, "column",
        CASE WHEN kind = 'string' AND levels / present < 0.05 THEN 'categorical' ELSE kind END AS inferred_type,
        round((total - present) / total * 100, 2) AS missing_pct, levels AS unique_count,
        round(mean, 4) AS mean, round(median, 4) AS median, text_mode, round(number_mode, 4) AS number_mode,
        round(min, 4) AS min, round(max, 4) AS max, round(std, 4) AS std, outlier_count, scale_consistency
        FROM ({' UNION ALL '.join(parts)})"""


def _descriptive(stats):
    number = F.col("inferred_type").isin("integer", "float")
    return rounded(
        stats.select(
            "dataset", "column", "inferred_type", "missing_pct", "unique_count", "mean", "median",
            F.when(~number, F.col("mode")).alias("text_mode"),
            F.when(number, F.col("mode").try_cast("double")).alias("number_mode"),
            "min", "max", "std", "outlier_count", "scale_consistency",
        )
    )


@query("descriptive_stats", with_survey(descriptive_sql("survey", "orders", SURVEY_COLUMNS)))
def descriptive_stats(spark, folder):
    return _descriptive(pr.descriptive_stats(survey(spark, folder), "orders"))


@query(
    "descriptive_stats_stacked",
    f"""WITH survey AS ({SURVEY_SQL}), c AS ({CUSTOMER_SQL})
    SELECT * FROM ({descriptive_sql("survey", "orders", SURVEY_COLUMNS)})
    UNION ALL SELECT * FROM ({descriptive_sql("c", "customer", CUSTOMER_COLUMNS)})""",
)
def descriptive_stats_stacked(spark, folder):
    stacked = pr.descriptive_stats(survey(spark, folder), "orders").unionByName(
        pr.descriptive_stats(customer(spark, folder), "customer")
    )
    return _descriptive(stacked)


def distribution_sql(source: str, names, k: int = 5) -> str:
    return f"""SELECT "column", '{{' || string_agg('"' || value || '":' || count, ',' ORDER BY rank) || '}}'
        AS distribution FROM ({top_sql(source, names, k)}) GROUP BY "column" """


@query("distributions", distribution_sql("orders", ("o_orderstatus", "o_orderpriority", "o_custkey")))
def distributions(spark, folder):
    names = ("o_orderstatus", "o_orderpriority", "o_custkey")
    return lv.distributions(lv.level_counts(table(spark, folder, "orders"), names))


EXTREMES = (("o_totalprice", "orders"), ("value", "events"))


def outlier_sql(source: str, names) -> str:
    parts = []
    for c in names:
        parts.append(
            f"""SELECT '{c}' AS "column", (SELECT count({c}) FROM {source}) AS non_null_count,
            (SELECT count(*) FROM {source} WHERE abs(({c} - m) / s) > 3) AS z_outliers, lo AS lower_bound,
            hi AS upper_bound, (SELECT count(*) FROM {source} WHERE {c} < lo OR {c} > hi) AS iqr_outliers
            FROM (SELECT m, s, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
              (SELECT avg({c}) AS m, stddev_samp({c}) AS s, quantile_cont({c}, 0.25) AS q1,
                      quantile_cont({c}, 0.75) AS q3 FROM {source}))"""
        )
    return f"""SELECT "column", non_null_count, z_outliers,
        round(CAST(z_outliers AS DOUBLE) / non_null_count * 100, 4) AS z_pct, round(lower_bound, 4) AS lower_bound,
        round(upper_bound, 4) AS upper_bound, iqr_outliers,
        round(CAST(iqr_outliers AS DOUBLE) / non_null_count * 100, 4) AS iqr_pct FROM ({' UNION ALL '.join(parts)})"""


@query("outliers", outlier_sql("events", ("event_id", "user_id", "value")))
def outliers(spark, folder):
    return rounded(ql.outlier_summary(table(spark, folder, "events").select("event_id", "user_id", "value")))


@query(
    "outlier_samples",
    """SELECT 'value' AS "column", value FROM events,
       (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
       WHERE abs((value - m) / s) > 3 ORDER BY abs(value - m) DESC, value LIMIT 5""",
)
def outlier_samples(spark, folder):
    return ql.outlier_samples(table(spark, folder, "events"), "value")


@query(
    "percentile_bounds",
    """SELECT c AS "column", p, round(q, 4) AS quantile FROM (
       SELECT 'l_extendedprice' AS c, unnest([0.01, 0.25, 0.5, 0.75, 0.99])::DOUBLE AS p,
              unnest(quantile_cont(l_extendedprice, [0.01, 0.25, 0.5, 0.75, 0.99])) AS q FROM lineitem
       UNION ALL SELECT 'l_quantity', unnest([0.01, 0.25, 0.5, 0.75, 0.99])::DOUBLE,
              unnest(quantile_cont(l_quantity, [0.01, 0.25, 0.5, 0.75, 0.99])) FROM lineitem)""",
)
def percentile_bounds(spark, folder):
    names = ["l_extendedprice", "l_quantity"]
    found = pr.percentile_bounds(table(spark, folder, "lineitem"), names, [0.01, 0.25, 0.5, 0.75, 0.99])
    rows = [(c, float(p), float(q)) for c in names for p, q in found[c].items()]
    return rounded(spark.createDataFrame(rows, "column string, p double, quantile double"))


REPEATS = "SELECT user_id, event_type FROM events"


@query(
    "duplicates",
    f"""SELECT total_rows, duplicate_rows, round(duplicate_rows / total_rows * 100, 4) AS duplicate_pct,
        CASE WHEN duplicate_rows / total_rows * 100 > 5 THEN 'blocking' WHEN duplicate_rows / total_rows * 100 > 1
             THEN 'fixable' WHEN duplicate_rows > 0 THEN 'warning' END AS severity
        FROM (SELECT count(*) AS total_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({REPEATS})))
              AS duplicate_rows FROM ({REPEATS}))""",
)
def duplicates(spark, folder):
    return rounded(ql.duplicate_summary(table(spark, folder, "events").select("user_id", "event_type")))


def issues_sql(source: str, columns, numbers) -> str:
    """Missing, cardinality, outlier, duplicate and sample-size issues."""
    stats = stats_sql(source, columns)
    out = outlier_sql(source, numbers)
    names = ", ".join(c for c, _, _ in columns)
    return f"""
    SELECT "column", 'missing_values' AS issue_type,
      CASE WHEN null_pct > 50 THEN 'blocking' WHEN null_pct > 20 THEN 'fixable' ELSE 'warning' END AS severity,
      null_count AS affected_rows, null_pct AS affected_pct, null_pct < 50 AS is_fixable
      FROM ({stats}) WHERE null_pct > 0
    UNION ALL SELECT "column", CASE WHEN unique_pct = 100 AND total_count > 10 THEN 'high_cardinality'
      ELSE 'constant_value' END, 'warning', 0, 0, NOT (unique_pct = 100 AND total_count > 10)
      FROM ({stats}) WHERE (unique_pct = 100 AND total_count > 10) OR unique_count = 1
    UNION ALL SELECT "column", 'outliers', CASE WHEN z_pct > 5 THEN 'fixable' ELSE 'warning' END, z_outliers,
      z_pct, true FROM ({out}) WHERE z_outliers > 0
    UNION ALL SELECT "column", 'iqr_outliers', 'warning', iqr_outliers, iqr_pct, true FROM ({out})
      WHERE iqr_outliers > z_outliers
    UNION ALL SELECT NULL, 'duplicates', CASE WHEN d / n * 100 > 5 THEN 'blocking' WHEN d / n * 100 > 1
      THEN 'fixable' ELSE 'warning' END, d, round(d / n * 100, 4), true FROM (
        SELECT (SELECT count(*) FROM {source}) AS n, (SELECT count(*) FROM {source})
          - (SELECT count(*) FROM (SELECT DISTINCT {names} FROM {source})) AS d) WHERE d > 0
    UNION ALL SELECT NULL, 'insufficient_sample', 'blocking', n, 100, false
      FROM (SELECT count(*) AS n FROM {source}) WHERE n < 30"""


SURVEY_NUMBERS = ("respondent_id", "satisfaction_score", "nps_score", "spend")
RULES = (
    "minimum 1000000000 records required",
    "column: nps_score between 1 and 9",
    "column: gender not null",
    "min 100 records",
)
BUSINESS_SQL = """SELECT CAST(NULL AS VARCHAR) AS "column", 'blocking' AS severity, count(*) AS affected_rows,
    100.0::DOUBLE AS affected_pct FROM survey
    UNION ALL SELECT 'nps_score', 'fixable', count(*) FILTER (nps_score < 1 OR nps_score > 9),
      round(count(*) FILTER (nps_score < 1 OR nps_score > 9) / count(*) * 100, 4) FROM survey
    UNION ALL SELECT 'gender', 'blocking', count(*) - count(gender),
      round((count(*) - count(gender)) / count(*) * 100, 4) FROM survey"""


@query(
    "quality_issues",
    with_survey(
        f"""SELECT "column", issue_type, severity, CAST(affected_rows AS BIGINT) AS affected_rows,
        round(CAST(affected_pct AS DOUBLE), 4) AS affected_pct, is_fixable
        FROM ({issues_sql("survey", SURVEY_COLUMNS, SURVEY_NUMBERS)})"""
    ),
)
def quality_issues(spark, folder):
    issues = ql.detect_issues(survey(spark, folder))
    return rounded(issues.drop("description", "suggested_fix"))


@query("business_rules", with_survey(BUSINESS_SQL))
def business_rules(spark, folder):
    found = va.business_issues(survey(spark, folder), RULES)
    return rounded(found.select("column", "severity", "affected_rows", "affected_pct"))


SCORE_SQL = with_survey(
    f"""SELECT total_issues, blocking, fixable, warning, round(avg_null_pct, 4) AS avg_null_pct,
    round(greatest(0, least(100, 100 - blocking * 10 - fixable * 2 - warning * 0.5 - avg_null_pct * 0.5))::DOUBLE, 4)
      AS quality_score,
    blocking = 0 AND 100 - blocking * 10 - fixable * 2 - warning * 0.5 - avg_null_pct * 0.5 >= 60 AS is_acceptable
    FROM (SELECT count(*) AS total_issues, count(*) FILTER (severity = 'blocking') AS blocking,
          count(*) FILTER (severity = 'fixable') AS fixable, count(*) FILTER (severity = 'warning') AS warning
          FROM ({issues_sql("survey", SURVEY_COLUMNS, SURVEY_NUMBERS)})),
         (SELECT avg(null_pct) AS avg_null_pct FROM ({stats_sql("survey", SURVEY_COLUMNS)}))"""
)


@query("quality_score", SCORE_SQL)
def quality_score(spark, folder):
    return rounded(quality_analysis(survey(spark, folder))["summary"].drop("recommendations", "ignorable"))


def _report(spark, folder):
    return quality_analysis(survey(spark, folder))


@query(
    "issues_by_type",
    with_survey(
        f"""SELECT issue_type, count(*) AS issues FROM ({issues_sql("survey", SURVEY_COLUMNS, SURVEY_NUMBERS)})
        GROUP BY 1"""
    ),
)
def issues_by_type(spark, folder):
    return _report(spark, folder)["by_type"]


@query(
    "issues_by_severity",
    with_survey(
        f"""SELECT CASE WHEN severity IN ('blocking', 'fixable') THEN severity ELSE 'ignorable' END AS severity,
        count(*) AS issues FROM ({issues_sql("survey", SURVEY_COLUMNS, SURVEY_NUMBERS)}) GROUP BY 1"""
    ),
)
def issues_by_severity(spark, folder):
    return _report(spark, folder)["by_severity"]


@query(
    "run_summary",
    f"""SELECT 'warning' AS status, 0.8::DOUBLE AS confidence, quality_score, is_acceptable, blocking, fixable,
    total_issues - blocking - fixable AS ignorable, total_issues FROM ({SCORE_SQL})""",
)
def run_summary(spark, folder):
    return rounded(ql.run_summary(_report(spark, folder)["summary"], True, 0.8))


@query(
    "leading_issues",
    f"""WITH survey AS ({SURVEY_SQL}) SELECT "column", issue_type, severity, CAST(affected_rows AS BIGINT) AS affected_rows
    FROM (SELECT "column", issue_type, severity, affected_rows FROM ({issues_sql("survey", SURVEY_COLUMNS, SURVEY_NUMBERS)})
          UNION ALL SELECT "column", 'business_rule_violation', severity, affected_rows FROM ({BUSINESS_SQL}))
    WHERE severity IN ('blocking', 'fixable') ORDER BY severity, issue_type, "column" NULLS FIRST LIMIT 10""",
)
def leading_issues(spark, folder):
    df = survey(spark, folder)
    issues = ql.detect_issues(df, business_issues=va.business_issues(df, RULES))
    return ql.leading_issues(issues).select("column", "issue_type", "severity", "affected_rows")


def quick_sql(source: str, names) -> str:
    listed = ", ".join(names)
    return f"""SELECT rows, null_cells, CAST({len(names)} AS BIGINT) AS columns,
        round(null_cells / (rows * {len(names)}) * 100, 2) AS null_pct, duplicates,
        round(null_cells / (rows * {len(names)}) * 100, 2) < 50 AS can_proceed
        FROM (SELECT count(*) AS rows, CAST(sum({null_sum(names)}) AS BIGINT) AS null_cells,
          count(*) - (SELECT count(*) FROM (SELECT DISTINCT {listed} FROM {source})) AS duplicates FROM {source})"""


NARROW = tuple(c for c, _, _ in SURVEY_COLUMNS)


@query("quick_assessment", with_survey(quick_sql("survey", NARROW)))
def quick_assessment(spark, folder):
    return ql.quick_assessment(survey(spark, folder))


@query(
    "column_completeness",
    with_survey(f"""SELECT "column", round(100 - missing_pct, 2) AS completeness FROM ({missing_sql("survey", SURVEY_NAMES)})"""),
)
def column_completeness(spark, folder):
    return ql.completeness(survey(spark, folder))


@query(
    "simple_score",
    with_survey(
        f"""SELECT rows, columns, round(null_cells / (rows * columns) * 100, 4) AS missing_pct, duplicates,
        round(greatest(0, least(100, 100 - null_cells / (rows * columns) * 100 * 0.5 - duplicates / rows * 10))::DOUBLE, 4)
        AS quality_score FROM ({quick_sql("survey", NARROW)})"""
    ),
)
def simple_score(spark, folder):
    return rounded(ql.simple_score(survey(spark, folder)))


SUMMARY_NAMES = ("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")


@query(
    "aggregate_summary",
    with_customer(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count({c}) AS non_null_count, count(*) - count({c}) AS null_count,
            round((count(*) - count({c})) / count(*) * 100, 4) AS null_pct,
            {f"round(min({c})::DOUBLE, 4)" if c != "c_mktsegment" else "NULL::DOUBLE"} AS min,
            {f"round(max({c})::DOUBLE, 4)" if c != "c_mktsegment" else "NULL::DOUBLE"} AS max,
            {f"round(avg({c})::DOUBLE, 4)" if c != "c_mktsegment" else "NULL::DOUBLE"} AS mean FROM c"""
            for c in SUMMARY_NAMES
        )
    ),
)
def aggregate_summary(spark, folder):
    found = pr.aggregate_summary(customer(spark, folder).select(*SUMMARY_NAMES))
    return rounded(found.drop("ord", "data_type", "top_values"))


def samples_sql(source: str, names, k: int = 5) -> str:
    return f"""SELECT "column", list(value ORDER BY value) AS sample_values FROM (
        SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY value) AS rank
        FROM ({levels_sql(source, names)})) WHERE rank <= {k} GROUP BY "column" """


@query(
    "source_schema",
    with_survey(
        f"""SELECT s."column", data_type, inferred_type, non_null_count, null_count, unique_count,
        array_to_string(sample_values, '|') AS samples, CASE WHEN s."column" = 'nps_score' THEN 'Recommendation' END AS label
        FROM ({stats_sql("survey", SURVEY_COLUMNS)}) s JOIN ({samples_sql("survey", SURVEY_NAMES)}) v
        ON s."column" = v."column" WHERE s."column" <> 'spend'"""
    ),
)
def source_schema(spark, folder):
    labels = spark.createDataFrame([("nps_score", "Recommendation")], "column string, label string")
    found = pr.source_schema(survey(spark, folder).drop("spend"), labels)
    return found.select(
        "column", "data_type", "inferred_type", "non_null_count", "null_count", "unique_count",
        F.array_join("sample_values", "|").alias("samples"), "label",
    )


@query(
    "profile_levels",
    with_survey(top_sql("survey", ("survey_date", "country", "region", "age", "gender", "channel", "purchase_intent", "status"), 20)),
)
def profile_levels(spark, folder):
    return pr.structural_profile(survey(spark, folder), ["respondent_id"])["levels"]


@query(
    "profile_head_tail",
    """SELECT 'head' AS part, o_orderkey, o_custkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 5)
       UNION ALL SELECT 'tail', o_orderkey, o_custkey FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 5)""",
)
def profile_head_tail(spark, folder):
    profile = pr.structural_profile(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"])
    return cols_part(profile["head"], "head").unionByName(cols_part(profile["tail"], "tail"))


def cols_part(df, name):
    return df.select(F.lit(name).alias("part"), "o_orderkey", "o_custkey")


@query(
    "artifact_counts",
    with_survey(
        """SELECT 'cleaned' AS artifact, count(*) AS rows FROM survey
        UNION ALL SELECT 'anomalies', count(*) FROM survey WHERE nps_score > 9
        UNION ALL SELECT 'valid_nulls', count(*) FROM survey WHERE spend IS NULL
        UNION ALL SELECT 'drift_alerts', 0"""
    ),
)
def artifact_counts(spark, folder):
    df = survey(spark, folder)
    return ql.artifact_counts(
        {
            "cleaned": df,
            "anomalies": va.range_violations(df, "nps_score", 0, 9),
            "valid_nulls": df.where("spend IS NULL"),
            "drift_alerts": None,
        }
    )
