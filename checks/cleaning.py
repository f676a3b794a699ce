"""Imputation and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.profiles import SURVEY_NAMES, missing_sql, null_sum
from checks.registry import SURVEY_SQL, customer, query, rounded, survey, table, with_customer, with_survey
from tablemeld.operators import impute as im, validate as va

MODE = "(SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def mode_sql(column: str, source: str = "survey") -> str:
    return MODE.format(c=column, t=source)


def typed_sql(column: str, source: str = "survey") -> str:
    """Median of skewed numbers, else mean (DuckDB's skewness is bias-corrected)."""
    return f"(SELECT CASE WHEN abs(skewness({column})) > 1 THEN median({column}) ELSE avg({column}) END FROM {source})"


TYPED_SQL = with_survey(
    f"""SELECT respondent_id, coalesce(gender, {mode_sql("gender")}) AS gender,
    round(coalesce(satisfaction_score, {typed_sql("satisfaction_score")})::DOUBLE, 4) AS satisfaction_score,
    round(coalesce(nps_score, {typed_sql("nps_score")})::DOUBLE, 4) AS nps_score,
    round(coalesce(spend, {typed_sql("spend")}), 4) AS spend,
    coalesce(channel, {mode_sql("channel")}) AS channel FROM survey"""
)
IMPUTED = ("respondent_id", "gender", "satisfaction_score", "nps_score", "spend", "channel")


@query("impute_typed", TYPED_SQL)
def impute_typed(spark, folder):
    imputed, _ = im.impute_typed(survey(spark, folder).select(*IMPUTED), "survey")
    return rounded(imputed)


SKEWED = "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS value FROM {events}"


@query(
    "impute_skewed",
    f"""WITH e AS ({SKEWED.format(events="events")}) SELECT event_id, round(coalesce(value, {typed_sql("value", "e")}), 4) AS value FROM e""",
)
def impute_skewed(spark, folder):
    events = spark.sql(SKEWED, events=table(spark, folder, "events"))
    return rounded(im.impute_typed(events, "events")[0])


NAN_VALUES = SKEWED.replace("NULL", "{nan}")


@query(
    "nan_impute",
    f"""WITH e AS ({SKEWED.format(events="events")}) SELECT event_id, round(coalesce(value, {typed_sql("value", "e")}), 4) AS value FROM e""",
)
def nan_impute(spark, folder):
    events = spark.sql(NAN_VALUES.replace("{nan}", "double('NaN')"), events=table(spark, folder, "events"))
    return rounded(im.impute_typed(events, "events")[0])


@query(
    "imputation_summary",
    f"""WITH e AS ({SKEWED.format(events="events")}), survey AS ({SURVEY_SQL})
    SELECT 'events' AS dataset, 'value' AS "column", CASE WHEN abs(skewness(value)) > 1 THEN 'median' ELSE 'mean' END AS strategy,
      round(CASE WHEN abs(skewness(value)) > 1 THEN median(value) ELSE avg(value) END, 4) AS fill_number,
      CAST(NULL AS VARCHAR) AS fill_text, count(*) - count(value) AS missing_count FROM e
    UNION ALL SELECT 'survey', 'gender', 'mode', NULL, {mode_sql("gender")}, count(*) - count(gender) FROM survey""",
)
def imputation_summary(spark, folder):
    _, events = im.impute_typed(spark.sql(SKEWED, events=table(spark, folder, "events")), "events")
    _, answers = im.impute_typed(survey(spark, folder).select("respondent_id", "gender"), "survey")
    number = F.col("fill_value").try_cast("double")
    return events.unionByName(answers).select(
        "dataset", "column", "strategy", F.round(number, 4).alias("fill_number"),
        F.when(number.isNull(), F.col("fill_value")).alias("fill_text"), "missing_count",
    )


STRATEGIES = {
    "gender": "Replace with MODE",
    "satisfaction_score": "Replace with MEDIAN",
    "nps_score": "Replace with 0",
    "spend": "Remove rows",
}


@query(
    "impute_strategies",
    with_survey(
        f"""SELECT respondent_id, coalesce(gender, {mode_sql("gender")}) AS gender,
        coalesce(satisfaction_score, (SELECT median(satisfaction_score) FROM survey))::DOUBLE AS satisfaction_score,
        coalesce(nps_score, 0)::DOUBLE AS nps_score, round(spend, 4) AS spend, coalesce(channel, 'Unknown') AS channel
        FROM survey WHERE spend IS NOT NULL"""
    ),
)
def impute_strategies(spark, folder):
    df = survey(spark, folder).select(*IMPUTED)
    done = im.apply_plan(df, im.fit_strategies(df, STRATEGIES))
    return rounded(done.withColumns({c: F.col(c).cast("double") for c in ("satisfaction_score", "nps_score")}))


@query(
    "impute_defaults",
    with_survey(
        """SELECT respondent_id, coalesce(gender, 'Unknown') AS gender,
        round(coalesce(satisfaction_score, (SELECT avg(satisfaction_score) FROM survey))::DOUBLE, 4) AS satisfaction_score,
        round(coalesce(nps_score, (SELECT avg(nps_score) FROM survey))::DOUBLE, 4) AS nps_score
        FROM survey"""
    ),
)
def impute_defaults(spark, folder):
    df = survey(spark, folder).select(*IMPUTED)
    plan = im.fit_strategies(df, {"spend": "Drop column", "channel": "Drop column"})
    return rounded(im.apply_plan(df, plan))


RULES = [
    im.SkipRule({"satisfaction_score": 1}, ("nps_score", "spend")),
    im.SkipRule({"purchase_intent": "VU"}, ("channel",)),
]
SKIPPED = {
    "nps_score": "coalesce(satisfaction_score = 1, false)",
    "spend": "coalesce(satisfaction_score = 1, false)",
    "channel": "coalesce(purchase_intent = 'VU', false)",
}


@query(
    "skip_logic_nulls",
    with_survey(
        " UNION ALL ".join(
            f"""SELECT respondent_id AS row_id, '{c}' AS "column",
            CASE WHEN {SKIPPED.get(c, "false")} THEN 'valid' ELSE 'uncertain' END AS null_class FROM survey WHERE {c} IS NULL"""
            for c in ("gender", "satisfaction_score", "nps_score", "spend", "channel")
        )
    ),
)
def skip_logic_nulls(spark, folder):
    return im.classify_nulls(survey(spark, folder), "respondent_id", RULES)


CODES = {"nps_score": "zero", "spend": "mean", "channel": "unknown", "gender": "mode", "satisfaction_score": "keep"}
MASKED_SQL = with_survey(
    f"""SELECT respondent_id, coalesce(gender, {mode_sql("gender")}) AS gender,
    CASE WHEN {SKIPPED["nps_score"]} THEN nps_score ELSE coalesce(nps_score, 0) END::DOUBLE AS nps_score,
    round(CASE WHEN {SKIPPED["spend"]} THEN spend ELSE coalesce(spend, (SELECT avg(spend) FROM survey)) END, 4) AS spend,
    CASE WHEN {SKIPPED["channel"]} THEN channel ELSE coalesce(channel, 'Unknown') END AS channel FROM survey"""
)


def _masked(df):
    return rounded(df.select("respondent_id", "gender", F.col("nps_score").cast("double").alias("nps_score"), "spend", "channel"))


@query("impute_skip_logic", MASKED_SQL)
def impute_skip_logic(spark, folder):
    return _masked(im.impute_with_skip_logic(survey(spark, folder), CODES, RULES))


@query("impute_masked", MASKED_SQL)
def impute_masked(spark, folder):
    df = survey(spark, folder)
    nulls = im.classify_nulls(df, "respondent_id", RULES)
    return _masked(im.impute_masked(df, "respondent_id", CODES, nulls.where("null_class = 'valid'")))


@query(
    "impute_listed_cells",
    with_survey(
        f"""SELECT respondent_id, nps_score, round(CASE WHEN spend IS NULL AND respondent_id % 2 = 0
        THEN (SELECT median(spend) FROM survey) ELSE spend END, 4) AS spend
        FROM survey WHERE nps_score IS NOT NULL OR {SKIPPED["nps_score"]}"""
    ),
)
def impute_listed_cells(spark, folder):
    df = survey(spark, folder)
    nulls = im.classify_nulls(df, "respondent_id", RULES)
    done = im.impute_masked(
        df, "respondent_id", {"spend": "median", "nps_score": "remove"},
        nulls.where("null_class = 'valid' AND column = 'nps_score'"),
        nulls.where("column = 'spend' AND row_id % 2 = 0"),
    )
    return rounded(done.select("respondent_id", "nps_score", "spend"))


@query(
    "imputation_effect",
    f"""SELECT 'before' AS stage, count(*) AS rows, CAST(sum({null_sum(("gender", "nps_score", "spend", "channel"))}) AS BIGINT) AS missing
    FROM ({SURVEY_SQL}) UNION ALL
    SELECT 'after', count(*), CAST(sum({null_sum(("gender", "nps_score", "spend", "channel"))}) AS BIGINT) FROM ({MASKED_SQL})""",
)
def imputation_effect(spark, folder):
    names = ("gender", "nps_score", "spend", "channel")
    before = survey(spark, folder)
    return im.imputation_effect(before.select(*names), im.impute_with_skip_logic(before, CODES, RULES).select(*names))


@query(
    "columns_needing_imputation",
    with_survey(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) FILTER (NOT {SKIPPED.get(c, "false")}) AS uncertain_count, '{t}' AS data_type,
            {str(t != "string").lower()} AS is_numeric, count(*) AS missing_count FROM survey WHERE {c} IS NULL"""
            for c, t in (("gender", "string"), ("satisfaction_score", "bigint"), ("nps_score", "bigint"), ("spend", "double"), ("channel", "string"))
        )
    ),
)
def columns_needing_imputation(spark, folder):
    df = survey(spark, folder)
    nulls = im.classify_nulls(df, "respondent_id", RULES)
    return im.columns_needing_imputation(df, nulls.where("null_class = 'uncertain'"))


@query(
    "fallback_clean",
    with_survey(
        """SELECT respondent_id, coalesce(gender, 'Unknown') AS gender,
        round(coalesce(spend, (SELECT avg(spend) FROM survey)), 4) AS spend FROM survey"""
    ),
)
def fallback_clean(spark, folder):
    df = survey(spark, folder).select("respondent_id", "gender", "spend")
    return rounded(im.fallback_clean(df, df))


STANDARDS = {
    "nps_score": {"data_type": "integer", "min": 1, "max": 9, "impute_strategy": "median"},
    "spend": {"data_type": "float", "min": 1000.0, "max": 400000.0, "impute_strategy": "mean"},
    "channel": {"data_type": "categorical", "allowed_values": ["Web", "store"], "impute_strategy": "mode"},
    "status": {"data_type": "categorical", "allowed_values": ["O", "F", "P"], "impute_strategy": "none"},
}
SUGGESTION_SQL = """SELECT 'nps_score' AS "column", count(*) - count(nps_score) AS missing,
      count(*) FILTER (nps_score < 1 OR nps_score > 9) AS out_of_range, 0 AS not_allowed,
      'Replace with MEDIAN' AS strategy, 'Dictionary suggests median for integer' AS reason FROM survey
    UNION ALL SELECT 'spend', count(*) - count(spend), count(*) FILTER (spend < 1000 OR spend > 400000), 0,
      'Replace with MEAN', 'Dictionary suggests mean for float' FROM survey
    UNION ALL SELECT 'channel', count(*) - count(channel), 0, count(*) FILTER (channel NOT IN ('Web', 'store')),
      'Replace with MODE', 'Dictionary suggests mode for categorical' FROM survey
    UNION ALL SELECT 'status', 0, 0, count(*) FILTER (status NOT IN ('O', 'F', 'P')), NULL, NULL FROM survey"""


@query("dictionary_suggestions", with_survey(SUGGESTION_SQL))
def dictionary_suggestions(spark, folder):
    return im.dictionary_suggestions(survey(spark, folder), STANDARDS)


@query(
    "reconcile_strategies",
    with_survey(
        f"""SELECT coalesce(p."column", d."column") AS "column", coalesce(p.strategy, d.strategy, 'Keep missing') AS strategy,
        CASE WHEN p.strategy IS NOT NULL THEN 'proposal' WHEN d.strategy IS NOT NULL THEN 'dictionary' END AS origin
        FROM (SELECT 'nps_score' AS "column", 'Replace with 0' AS strategy
              UNION ALL SELECT 'gender', CASE WHEN count(gender) < count(*) THEN 'Replace with ''Unknown''' END FROM survey) p
        FULL JOIN (SELECT "column", strategy FROM ({SUGGESTION_SQL})) d ON p."column" = d."column" """
    ),
)
def reconcile_strategies(spark, folder):
    df = survey(spark, folder)
    gap = df.agg(
        F.lit("gender").alias("column"), F.when(F.count("gender") < F.count(F.lit(1)), "unknown").alias("strategy")
    )
    proposals = spark.createDataFrame([("nps_score", "zero")], "column string, strategy string").unionByName(gap)
    return im.reconcile_strategies(proposals, im.dictionary_suggestions(df, STANDARDS).select("column", "strategy"))


# --- validation -----------------------------------------------------------------

CHECKS = [
    va.Rule("l_quantity", min=5, max=45),
    va.Rule("l_returnflag", allowed_values=("A", "R")),
    va.Rule("l_tax", min=0.02, required=True),
    va.Rule("absent", min=0),
]
FLAGS_SQL = """SELECT 'lineitem' AS dataset, CAST(l_orderkey AS VARCHAR) AS record_id, {} AS "column", {} AS issue_type, {} AS details
    FROM lineitem WHERE {}"""


def flags_sql(column: str, issue: str, details: str, where: str) -> str:
    return FLAGS_SQL.format(f"'{column}'", f"'{issue}'", details, where)


@query(
    "validation_flags",
    " UNION ALL ".join(
        [
            flags_sql("l_quantity", "below_min", "'Value ' || l_quantity || ' below min 5'", "l_quantity < 5"),
            flags_sql("l_quantity", "above_max", "'Value ' || l_quantity || ' above max 45'", "l_quantity > 45"),
            flags_sql("l_returnflag", "invalid_value", "'Value ' || l_returnflag || ' not in allowed list'", "l_returnflag NOT IN ('A', 'R')"),
            flags_sql("l_tax", "below_min", "'Value ' || l_tax || ' below min 0.02'", "l_tax < 0.02"),
        ]
    ),
)
def validation_flags(spark, folder):
    return va.record_flags(table(spark, folder, "lineitem"), CHECKS, "lineitem", "l_orderkey")


@query(
    "required_flags",
    with_survey(
        """SELECT 'survey' AS dataset, CAST(respondent_id AS VARCHAR) AS record_id, 'gender' AS "column",
        'required_missing' AS issue_type, 'Required value missing' AS details FROM survey WHERE gender IS NULL"""
    ),
)
def required_flags(spark, folder):
    df = survey(spark, folder)
    return va.record_flags(df, [va.Rule("gender", required=True)], "survey", va.record_id_column(df))


@query(
    "record_count_flags",
    """SELECT 'events' AS dataset, CAST(NULL AS VARCHAR) AS record_id, CAST(NULL AS VARCHAR) AS "column", 'min_records' AS issue_type,
    'Dataset has ' || count(*) || ' rows, minimum is 1000000000' AS details FROM events
    UNION ALL SELECT 'events', NULL, NULL, 'max_records', 'Dataset has ' || count(*) || ' rows, maximum is 10' FROM events""",
)
def record_count_flags(spark, folder):
    rules = [va.Rule(min_records=1_000_000_000), va.Rule(max_records=10), va.Rule(min_records=1)]
    return va.table_flags(table(spark, folder, "events"), rules, "events")


@query(
    "members_outside_list",
    """SELECT 'lineitem' AS dataset, CAST(l_orderkey AS VARCHAR) AS record_id, 'l_partkey' AS "column", 'invalid_value' AS issue_type,
    'Value ' || l_partkey || ' not in allowed list' AS details FROM lineitem
    WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)""",
)
def members_outside_list(spark, folder):
    allowed = table(spark, folder, "part").where("p_size < 40").select(F.col("p_partkey").cast("string"))
    return va.members_outside(table(spark, folder, "lineitem"), "l_partkey", allowed, "lineitem", "l_orderkey")


@query(
    "missing_flags",
    with_survey(
        f"""SELECT 'survey' AS dataset, CAST(NULL AS VARCHAR) AS record_id, "column",
        CASE WHEN missing_pct = 100 THEN 'structural_missing' ELSE 'random_missing' END AS issue_type,
        printf('%.1f%% missing', share) AS details FROM (
        SELECT m.*, missing_count / (SELECT count(*) FROM survey) * 100 AS share FROM ({missing_sql("survey", SURVEY_NAMES)}) m)
        WHERE missing_count > 0 UNION ALL SELECT 'survey', NULL, 'empty', 'structural_missing', '100.0% missing'"""
    ),
)
def missing_flags(spark, folder):
    return va.missing_flags(survey(spark, folder).withColumn("empty", F.lit(None).cast("string")), "survey")


ROW_MISSING = with_survey(
    f"""SELECT 'survey' AS dataset, CAST(respondent_id AS VARCHAR) AS record_id, 'multiple' AS "column", 'row_missing' AS issue_type,
    ({null_sum(SURVEY_NAMES)}) || ' fields missing' AS details FROM survey WHERE {null_sum(SURVEY_NAMES)} > 0"""
)


@query("row_missing_flags", ROW_MISSING)
def row_missing_flags(spark, folder):
    return va.row_missing_flags(survey(spark, folder), "survey", "respondent_id")


@query("row_missing_first", ROW_MISSING + " ORDER BY respondent_id LIMIT 500")
def row_missing_first(spark, folder):
    return va.row_missing_flags(survey(spark, folder), "survey", "respondent_id", 500)


@query(
    "range_violations",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 3 OR l_quantity > 48",
)
def range_violations(spark, folder):
    lineitem = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return va.range_violations(lineitem, "l_quantity", 3, 48)


@query(
    "flag_counts",
    with_customer(
        """SELECT 'customer' AS dataset, 'c_acctbal' AS "column", 'below_min' AS issue_type, count(*) AS flags FROM c WHERE c_acctbal < 0
        UNION ALL SELECT 'customer', 'c_mktsegment', 'required_missing', count(*) FROM c WHERE c_mktsegment IS NULL"""
    ),
)
def flag_counts(spark, folder):
    rules = [va.Rule("c_acctbal", min=0), va.Rule("c_mktsegment", required=True)]
    return va.flag_counts(va.record_flags(customer(spark, folder), rules, "customer", "c_custkey"))
