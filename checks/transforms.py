"""Value maps, scales, dates, text, codes and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import (
    case_sql, query, r4, rounded, survey, table, values_sql, with_customer, with_survey, customer,
)
from tablemeld.columns import ref
from tablemeld.functions import casts, fixed_values as fv, scales, text, values
from tablemeld.operators import ranks, transform as tf
from tablemeld.sources.metadata import ColumnSpec, MasterSchema, value_map_table

SEGMENTS = {"BUILDING": "Construction", "MACHINERY": "Industry", "HOUSEHOLD": "Home"}


@query(
    "value_map",
    with_customer(f"SELECT c_custkey, {case_sql('c_mktsegment', SEGMENTS, 'c_mktsegment')} AS segment FROM c"),
)
def value_map(spark, folder):
    return customer(spark, folder).select(
        "c_custkey", values.value_map(F.col("c_mktsegment"), SEGMENTS).alias("segment")
    )


@query(
    "value_map_default",
    with_customer(
        f"""SELECT c_custkey, CASE WHEN c_mktsegment IS NULL THEN NULL ELSE
        {case_sql('lower(c_mktsegment)', {k.lower(): v for k, v in SEGMENTS.items()}, "'Other'")} END AS segment FROM c"""
    ),
)
def value_map_default(spark, folder):
    mapped = values.value_map(F.col("c_mktsegment"), SEGMENTS, "Other", case_sensitive=False)
    return customer(spark, folder).select("c_custkey", mapped.alias("segment"))


@query(
    "value_map_join",
    """SELECT l_orderkey, l_linenumber, coalesce(p_brand, CAST(l_partkey AS VARCHAR)) AS part
       FROM lineitem LEFT JOIN (SELECT p_partkey, p_brand FROM part WHERE p_size <= 25) ON l_partkey = p_partkey""",
)
def value_map_join(spark, folder):
    mapping = table(spark, folder, "part").where("p_size <= 25").select(
        F.col("p_partkey").cast("string").alias("raw"), F.col("p_brand").alias("canonical")
    )
    lineitem = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"))
    return tf.map_values(lineitem, "part", mapping)


@query(
    "default_value_maps",
    with_survey(
        f"""SELECT respondent_id, {case_sql("age", fv.AGE_BANDS, "age")} AS age,
        {case_sql("upper(trim(country))", fv.MARKET_NAMES, "upper(trim(country))")} AS market FROM survey"""
    ),
)
def default_value_maps(spark, folder):
    maps = values.merge_value_maps({})
    return survey(spark, folder).select(
        "respondent_id",
        values.value_map(F.col("age"), maps["age"]).alias("age"),
        values.value_map(F.upper(F.trim("country")), maps["market"]).alias("market"),
    )


def code_sql(column: str, codes, otherwise: str) -> str:
    return case_sql(f"lower(trim({column}))", codes, f"{otherwise}(trim({column}))")


@query("region_codes", with_survey(f"SELECT respondent_id, {code_sql('region', fv.REGION_CODES, 'upper')} AS region FROM survey"))
def region_codes(spark, folder):
    return tf.standardize_codes(survey(spark, folder).select("respondent_id", "region"), "region")


@query("country_codes", with_survey(f"SELECT respondent_id, {code_sql('country', fv.COUNTRY_CODES, 'upper')} AS country FROM survey"))
def country_codes(spark, folder):
    return tf.standardize_codes(survey(spark, folder).select("respondent_id", "country"), "country")


@query(
    "category_codes",
    with_survey(
        f"""SELECT respondent_id, {code_sql('channel', fv.CATEGORY_CODES, 'lower')} AS channel,
        {code_sql('status', fv.CATEGORY_CODES, 'lower')} AS status FROM survey"""
    ),
)
def category_codes(spark, folder):
    return tf.standardize_codes(survey(spark, folder).select("respondent_id", "channel", "status"), "category")


# --- scales ---------------------------------------------------------------------


@query(
    "scale_minmax",
    """SELECT event_id, round((value - lo) / (hi - lo) * 100, 4) AS value FROM events,
       (SELECT min(value) AS lo, max(value) AS hi FROM events)""",
)
def scale_minmax(spark, folder):
    events = table(spark, folder, "events").select("event_id", "value")
    fits = {"value": tf.ScaleFit(**{**tf.fit_scales(events, {"value": (0.0, 100.0)})["value"].__dict__, "method": "linear"})}
    return rounded(tf.apply_scales(events, fits))


@query(
    "scale_parameters",
    """SELECT 'value' AS "column", lo, hi, CASE WHEN (p99 - p01) / (hi - lo) < 0.7 THEN 'percentile' ELSE 'linear' END AS method
       FROM (SELECT min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.99) AS p99 FROM events)
       UNION ALL SELECT 'user_id', lo, hi, CASE WHEN (p99 - p01) / (hi - lo) < 0.7 THEN 'percentile' ELSE 'linear' END
       FROM (SELECT min(user_id)::DOUBLE AS lo, max(user_id)::DOUBLE AS hi, quantile_cont(user_id, 0.01) AS p01, quantile_cont(user_id, 0.99) AS p99 FROM events)""",
)
def scale_parameters(spark, folder):
    fits = tf.fit_scales(table(spark, folder, "events"), {"value": (0.0, 100.0), "user_id": (0.0, 100.0)})
    rows = [(c, f.low, f.high, f.method) for c, f in fits.items()]
    return spark.createDataFrame(rows, '`column` string, lo double, hi double, method string')


PERCENTILE_SQL = """SELECT event_id, round(avg_rank / n * 100, 4) AS value FROM (
    SELECT event_id, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS avg_rank,
           count(*) OVER () AS n FROM events)"""


@query("scale_percentile", PERCENTILE_SQL.replace("avg_rank / n", "CAST(avg_rank AS DOUBLE) / n"))
def scale_percentile(spark, folder):
    events = table(spark, folder, "events").select("event_id", "value")
    return rounded(tf.apply_scales(events, tf.fit_scales(events, {"value": (0.0, 100.0)})))


@query(
    "percentile_rank",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(CAST(r AS DOUBLE) / n, 6) AS rank FROM (
       SELECT l_orderkey, l_linenumber, l_partkey, rank() OVER (ORDER BY l_partkey)
         + (count(*) OVER (PARTITION BY l_partkey) - 1) / 2.0 AS r, count(*) OVER () AS n FROM lineitem)""",
)
def percentile_rank(spark, folder):
    lineitem = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return rounded(ranks.with_percentile_rank(lineitem, "l_partkey", "rank"), 6)


MIXED = "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 4 = 0 THEN l_discount * 10 ELSE l_quantity * 2 END AS score FROM {lineitem}"


@query(
    "scale_mixed",
    f"""WITH m AS ({MIXED.format(lineitem="lineitem")}), b AS (
      SELECT count(*) FILTER (score BETWEEN 0 AND 1.05) / count(*) >= 0.15 AS b1,
             count(*) FILTER (score BETWEEN 1 AND 5.05) / count(*) >= 0.15 AS b2,
             count(*) FILTER (score BETWEEN 0 AND 10.05) / count(*) >= 0.15 AS b3,
             count(*) FILTER (score BETWEEN 0 AND 100.05) / count(*) >= 0.15 AS b4 FROM m)
    SELECT l_orderkey, l_linenumber, round(CASE
      WHEN b1 AND score BETWEEN 0 AND 1.05 THEN score / 1.05::DOUBLE * 200
      WHEN b2 AND score BETWEEN 1 AND 5.05 THEN (score - 1) / 4.05::DOUBLE * 200
      WHEN b3 AND score BETWEEN 0 AND 10.05 THEN score / 10.05::DOUBLE * 200
      WHEN b4 AND score BETWEEN 0 AND 100.05 THEN score / 100.05::DOUBLE * 200 ELSE score END, 4) AS score FROM m, b""",
)
def scale_mixed(spark, folder):
    mixed = spark.sql(MIXED, lineitem=table(spark, folder, "lineitem"))
    return rounded(tf.apply_scales(mixed, tf.fit_scales(mixed, {"score": (0.0, 200.0)}, detect_mixed=True)))


@query(
    "scale_fixed",
    with_survey("SELECT respondent_id, (satisfaction_score - 1) / 4 * 100.0::DOUBLE AS satisfaction_score FROM survey"),
)
def scale_fixed(spark, folder):
    return tf.convert_scale(survey(spark, folder).select("respondent_id", "satisfaction_score"), "1-5")


@query(
    "scale_declared",
    "SELECT p_partkey, round((p_size - 1) / 49.0::DOUBLE * 100, 4) AS p_size FROM part",
)
def scale_declared(spark, folder):
    return table(spark, folder, "part").select("p_partkey", r4(scales.linear(F.col("p_size"), 1, 50)).alias("p_size"))


@query(
    "nps_category",
    with_survey(
        """SELECT respondent_id, CASE WHEN nps_score >= 9 THEN 'Promoter' WHEN nps_score >= 7 THEN 'Passive'
        WHEN nps_score IS NOT NULL THEN 'Detractor' END AS nps_score FROM survey"""
    ),
)
def nps_category(spark, folder):
    return tf.convert_scale(survey(spark, folder).select("respondent_id", "nps_score"), "nps")


# --- dates and casts ------------------------------------------------------------


@query(
    "date_patterns",
    with_survey(
        """SELECT 'survey_date' AS "column", count(survey_date) AS present,
        count(try_strptime(survey_date, '%d/%m/%Y')) AS day_first, count(try_strptime(survey_date, '%m/%d/%Y')) AS month_first,
        'd/M/yyyy' AS detected FROM survey"""
    ),
)
def date_patterns(spark, folder):
    counts = tf.fit_date_patterns(survey(spark, folder), ["survey_date"])["survey_date"]
    row = ("survey_date", counts["present"], counts["d/M/yyyy"], counts["M/d/yyyy"], tf.detect_date_pattern(counts))
    return spark.createDataFrame([row], "column string, present bigint, day_first bigint, month_first bigint, detected string")


@query(
    "date_format",
    with_survey("SELECT respondent_id, strftime(try_strptime(survey_date, '%d/%m/%Y'), '%Y-%m-%d') AS survey_date FROM survey"),
)
def date_format(spark, folder):
    return survey(spark, folder).select("respondent_id", casts.format_date(F.col("survey_date"), "d/M/yyyy").alias("survey_date"))


BROKEN_DATES = """SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN 'unknown' WHEN o_orderkey % 19 = 0 THEN NULL
    ELSE {date} END AS order_date FROM {orders}"""


@query(
    "date_standardize",
    f"""SELECT o_orderkey, strftime(try_strptime(replace(order_date, ' > ', '-'), '%Y-%m-%d'), '%Y-%m-%d') AS order_date
    FROM ({BROKEN_DATES.format(date="strftime(o_orderdate, '%Y > %m > %d')", orders="orders")})""",
)
def date_standardize(spark, folder):
    dates = spark.sql(
        BROKEN_DATES.replace("{date}", "date_format(o_orderdate, 'yyyy > MM > dd')"), orders=table(spark, folder, "orders")
    )
    repaired = tf.repair_separators(dates)
    return tf.standardize_dates(repaired, tf.fit_dates(repaired))


MIXED_DATES = """SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN 'unknown' WHEN o_orderkey % 5 = 0 THEN {slashed} ELSE {iso} END AS order_date FROM {orders}"""
MIXED_DATES_SQL = MIXED_DATES.format(slashed="strftime(o_orderdate, '%d-%m-%Y')", iso="strftime(o_orderdate, '%Y-%m-%d')", orders="orders")


def mixed_date_rows(spark, folder):
    text = MIXED_DATES.replace("{slashed}", "date_format(o_orderdate, 'dd-MM-yyyy')").replace("{iso}", "date_format(o_orderdate, 'yyyy-MM-dd')")
    return spark.sql(text, orders=table(spark, folder, "orders"))


@query(
    "mixed_dates",
    f"""SELECT o_orderkey, CASE WHEN order_date LIKE '__-__-____' THEN strftime(try_strptime(order_date, '%d-%m-%Y'), '%Y-%m-%d')
    ELSE strftime(try_strptime(order_date, '%Y-%m-%d'), '%Y-%m-%d') END AS order_date FROM ({MIXED_DATES_SQL})""",
)
def mixed_dates(spark, folder):
    dates = mixed_date_rows(spark, folder)
    return tf.standardize_dates(dates, tf.fit_dates(dates))


@query(
    "date_losses",
    f"""SELECT 'order_date' AS "column", count(*) AS present, count(*) FILTER (order_date LIKE '____-__-__') AS by_fitted,
    count(*) FILTER (order_date LIKE '__-__-____') AS by_other, count(*) FILTER (order_date = 'unknown') AS lost FROM ({MIXED_DATES_SQL})""",
)
def date_losses(spark, folder):
    dates = mixed_date_rows(spark, folder)
    return tf.date_losses(dates, tf.fit_dates(dates))


@query(
    "separator_repair",
    f"""SELECT o_orderkey, replace(order_date, ' > ', '-') AS order_date
    FROM ({BROKEN_DATES.format(date="strftime(o_orderdate, '%Y > %m > %d')", orders="orders")})""",
)
def separator_repair(spark, folder):
    dates = spark.sql(
        BROKEN_DATES.replace("{date}", "date_format(o_orderdate, 'yyyy > MM > dd')"), orders=table(spark, folder, "orders")
    )
    return tf.repair_separators(dates)


TEXT_NUMBERS = """SELECT l_orderkey, l_linenumber,
    CASE WHEN l_partkey % 10 = 0 THEN 'n/a' ELSE CAST(l_quantity AS {string}) END AS quantity,
    CASE WHEN l_partkey % 3 = 0 THEN 'n/a' ELSE CAST(l_suppkey AS {string}) END AS supplier,
    CASE WHEN l_partkey % 2 = 0 THEN 'true' WHEN l_partkey % 5 = 0 THEN 'maybe' ELSE 'false' END AS flag
    FROM {lineitem}"""
TEXT_NUMBERS_SQL = TEXT_NUMBERS.format(string="VARCHAR", lineitem="lineitem")


def text_numbers(spark, folder):
    return spark.sql(TEXT_NUMBERS.replace("{string}", "STRING"), lineitem=table(spark, folder, "lineitem"))


@query("auto_numeric", f"SELECT * REPLACE (try_cast(quantity AS DOUBLE) AS quantity) FROM ({TEXT_NUMBERS_SQL})")
def auto_numeric(spark, folder):
    df = text_numbers(spark, folder)
    return tf.to_numeric(df, tf.fit_numeric(df))


@query(
    "type_cast",
    f"""SELECT l_orderkey, l_linenumber, CAST(try_cast(quantity AS DOUBLE) AS BIGINT) AS quantity_int,
    try_cast(supplier AS DOUBLE) AS supplier_float, try_cast(flag AS BOOLEAN) AS flag_bool,
    CAST(l_orderkey AS VARCHAR) AS key_text FROM ({TEXT_NUMBERS_SQL})""",
)
def type_cast(spark, folder):
    return text_numbers(spark, folder).select(
        "l_orderkey", "l_linenumber",
        casts.cast_to(F.col("quantity"), "integer").alias("quantity_int"),
        casts.cast_to(F.col("supplier"), "float").alias("supplier_float"),
        casts.cast_to(F.col("flag"), "boolean").alias("flag_bool"),
        casts.cast_to(F.col("l_orderkey"), "string", "integer").alias("key_text"),
    )


# --- text -----------------------------------------------------------------------


def clean_sql(column: str) -> str:
    steps = f"regexp_replace({column}, '&[a-zA-Z]+;', ' ', 'g')"
    steps = f"regexp_replace({steps}, '<[^>]+>', ' ', 'g')"
    steps = f"regexp_replace({steps}, '[^\\x00-\\x7F]', '', 'g')"
    steps = f"regexp_replace({steps}, '[^\\w\\s\\-.,''\"/()]', '', 'g')"
    steps = f"trim(regexp_replace({steps}, '\\s+', ' ', 'g'))"
    steps = f"regexp_replace({steps}, '\\s*[>\\-/]\\s*', ' > ', 'g')"
    return f"nullif({steps}, '')"


@query("clean_text", f"SELECT doc_id, {clean_sql('text')} AS text FROM documents")
def clean_text(spark, folder):
    return tf.clean_text_columns(table(spark, folder, "documents").select("doc_id", "text"))


@query("clean_html", f"SELECT page_id, {clean_sql('html')} AS html FROM pages")
def clean_html(spark, folder):
    return tf.clean_text_columns(table(spark, folder, "pages").select("page_id", "html"))


@query(
    "standardize_text",
    r"""SELECT conv_id, turn, regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')),
        '[^\p{L}\p{M}\p{N}\p{Pc}\s]', '', 'g') AS text, upper(role) AS role FROM conversations""",
)
def standardize_text(spark, folder):
    return table(spark, folder, "conversations").select(
        "conv_id", "turn",
        text.standardize(F.col("text"), ["strip", "lowercase", "replace_special"]).alias("text"),
        text.standardize(F.col("role"), ["uppercase"]).alias("role"),
    )


WAVES = """SELECT o_orderkey, CASE o_orderkey % 5
    WHEN 0 THEN 'Wave ' || CAST(o_custkey % 4 + 1 AS {string}) || ' 2024' WHEN 1 THEN '2024-W' || CAST(o_custkey % 4 + 1 AS {string})
    WHEN 2 THEN 'Q' || CAST(o_custkey % 4 + 1 AS {string}) || ' 2024' WHEN 3 THEN '2024Q' || CAST(o_custkey % 4 + 1 AS {string})
    ELSE 'spring' END AS wave, o_custkey % 4 + 1 AS n FROM {orders}"""


@query(
    "wave_labels",
    f"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'W' || n || '_2024' WHEN 1 THEN 'W' || n || '_2024'
    WHEN 2 THEN 'Q' || n || '_2024' WHEN 3 THEN 'Q' || n || '_2024' ELSE 'spring' END AS wave
    FROM ({WAVES.format(string="VARCHAR", orders="orders")})""",
)
def wave_labels(spark, folder):
    waves = spark.sql(WAVES.replace("{string}", "STRING"), orders=table(spark, folder, "orders"))
    return waves.select("o_orderkey", text.wave_label(F.col("wave")).alias("wave"))


# --- projections and chosen transforms ------------------------------------------


@query(
    "project_mapping",
    with_customer("SELECT c_custkey AS customer_id, c_name AS name, c_acctbal AS balance FROM c"),
)
def project_mapping(spark, folder):
    pairs = [
        ("c_custkey", "customer_id"), ("c_name", "name"), ("c_mktsegment", "name"), ("c_nationkey", "UNMAPPED"),
        ("c_phone", "phone"), ("c_acctbal", "balance"),
    ]
    return tf.project_mapping(customer(spark, folder), pairs)[0]


@query(
    "mapping_decisions",
    with_customer("SELECT c_custkey AS customer_id, c_name, c_acctbal AS balance, c_mktsegment FROM c"),
)
def mapping_decisions(spark, folder):
    decisions = {
        "c_custkey": {"action": "map_to", "target": "customer_id"},
        "c_nationkey": {"action": "skip"},
        "c_acctbal": {"action": "confirm", "target": "balance"},
        "c_mktsegment": {"action": "map_to", "target": "balance"},
        "c_name": {"action": "add_new"},
    }
    return tf.apply_decisions(customer(spark, folder), decisions)


@query(
    "required_and_order",
    with_customer("SELECT c_custkey AS key, 'EU' AS region, CAST(1.5 AS DOUBLE) AS weight, c_name AS name FROM c"),
)
def required_and_order(spark, folder):
    df = customer(spark, folder).select(F.col("c_name").alias("name"), F.col("c_custkey").alias("key"))
    added, _ = tf.add_required(df, [("region", "string", "EU"), ("weight", "float", "1.5"), ("name", "string", "x")])
    return tf.reorder(added, ["key", "region", "weight", "name"])


@query(
    "listwise_deletion",
    with_customer(
        "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM c "
        "WHERE c_nationkey IS NOT NULL AND c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL"
    ),
)
def listwise_deletion(spark, folder):
    return customer(spark, folder).drop("c_name").dropna("any")


SURVEY_SCHEMA = MasterSchema(
    "survey", "1.0",
    (
        ColumnSpec("respondent_id", "respondent_id", "integer", True, True),
        ColumnSpec("survey_date", "survey_date", "datetime"),
        ColumnSpec("country", "country", "categorical", aliases=("market",)),
        ColumnSpec("age", "age", "categorical", aliases=("age_group",)),
        ColumnSpec("gender", "gender", "categorical"),
        ColumnSpec("satisfaction_score", "satisfaction_score", "float", min_value=0.0, max_value=100.0, aliases=("csat",)),
        ColumnSpec("nps_score", "nps_score", "integer", min_value=0.0, max_value=10.0, aliases=("nps",)),
        ColumnSpec("purchase_intent", "purchase_intent", "categorical", aliases=("purchase_likelihood",)),
        ColumnSpec("channel", "channel", "categorical"),
        ColumnSpec("weight", "weight", "float", True, default_value="1.0"),
    ),
)
SURVEY_MAPS = {
    "gender": {"M": "M", "F": "F", "Male": "M", "Female": "F"},
    "purchase_intent": {"VU": "Very Unlikely", "U": "Unlikely", "N": "Neutral", "L": "Likely", "VL": "Very Likely"},
}
OLD_NAMES = {
    "respondent_id": "respondent_id", "survey_date": "survey date", "country": "market", "age": "age_group",
    "satisfaction_score": "csat", "nps_score": "nps", "purchase_intent": "purchase_likelihood",
}

HARMONIZED_SQL = f"""SELECT respondent_id,
    strftime(try_strptime(survey_date, '%d/%m/%Y'), '%Y-%m-%d') AS survey_date, trim(country) AS country,
    trim(age) AS age, {case_sql("gender", SURVEY_MAPS["gender"], "gender")} AS gender,
    CAST(satisfaction_score - 1 AS DOUBLE) / 4 * 100 AS satisfaction_score, nps_score,
    {case_sql("purchase_intent", SURVEY_MAPS["purchase_intent"], "purchase_intent")} AS purchase_intent,
    trim(channel) AS channel, CAST(1.0 AS DOUBLE) AS weight FROM survey"""


def vendor_survey(spark, folder):
    """The survey under an older vendor's names."""
    return survey(spark, folder).withColumnsRenamed(OLD_NAMES)


@query("harmonize_to_schema", with_survey(HARMONIZED_SQL))
def harmonize_to_schema(spark, folder):
    from tablemeld.operators import match as ma
    from tablemeld.plans import reports as rp

    df = vendor_survey(spark, folder)
    pairs = ma.mapping_pairs(ma.match_columns(ma.column_table(df), SURVEY_SCHEMA))
    plan = rp.fit_harmonization(df, pairs, SURVEY_SCHEMA, SURVEY_MAPS)
    return rp.apply_harmonization(df, plan)


@query(
    "custom_transform",
    "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, upper(l_returnflag) AS flag FROM lineitem",
)
def custom_transform(spark, folder):
    tf.register_transform("shout", lambda c, o: F.upper(c))
    sources = {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "net": "l_extendedprice", "flag": "l_returnflag"}
    transforms = {
        "net": tf.Transform("custom", {"sql": "l_extendedprice * (1 - l_discount)"}),
        "flag": tf.Transform("shout"),
    }
    return rounded(tf.apply_transforms(table(spark, folder, "lineitem"), sources, transforms))


@query(
    "transform_outcomes",
    f"""SELECT 'quantity' AS "column", 'quantity' AS source_column, 'type_cast' AS transformation, count(*) AS records,
    count(*) FILTER (quantity = 'n/a') AS records_failed FROM ({TEXT_NUMBERS_SQL})
    UNION ALL SELECT 'flag', 'flag', 'string_standardize', count(*), 0 FROM ({TEXT_NUMBERS_SQL})""",
)
def transform_outcomes(spark, folder):
    transforms = {
        "quantity": tf.Transform("type_cast", {"target": "float", "source": "string"}),
        "flag": tf.Transform("string_standardize"),
    }
    return tf.transform_outcomes(text_numbers(spark, folder), {c: c for c in transforms}, transforms)


@query(
    "transform_samples",
    with_customer(
        f"""SELECT 'c_mktsegment' AS "column", 'value_map' AS transformation, c_mktsegment AS original,
        {case_sql('c_mktsegment', SEGMENTS, 'c_mktsegment')} AS transformed FROM c WHERE c_mktsegment IS NOT NULL
        ORDER BY c_custkey LIMIT 5"""
    ),
)
def transform_samples(spark, folder):
    return tf.transform_samples(
        customer(spark, folder), "c_mktsegment", tf.Transform("value_map", {"entries": SEGMENTS}), ["c_custkey"]
    )


@query(
    "mapping_table_join",
    f"""SELECT n_nationkey, coalesce(canonical, n_name) AS n_name, c FROM (
      SELECT n_nationkey, n_name, count(c_custkey) AS c FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY ALL)
    LEFT JOIN (VALUES {values_sql({"NATION_0": "US", "NATION_1": "GB"})}) m(raw, canonical) ON n_name = raw""",
)
def mapping_table_join(spark, folder):
    counted = (
        table(spark, folder, "nation")
        .join(table(spark, folder, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .groupBy("n_nationkey", "n_name")
        .agg(F.count("c_custkey").alias("c"))
    )
    maps = value_map_table(spark, {"n_name": {"NATION_0": "US", "NATION_1": "GB"}})
    return tf.map_values(counted, "n_name", maps.where(ref("column") == "n_name"))
