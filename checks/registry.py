"""Registry of queries and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablemeld.session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        def tuned(spark: SparkSession, folder: str) -> DataFrame:
            return function(tune(spark), folder)

        QUERIES[name] = tuned
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that the order of additions does not matter."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
            if f.dataType.simpleString() == "double"
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def r4(column: str | Column) -> Column:
    return F.round(column, 4)


# --- inputs with gaps, written so that Spark and DuckDB read the same text ------

CUSTOMER = """
SELECT c_custkey, c_name,
       CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
FROM {customer}
"""

SURVEY = """
SELECT o_orderkey AS respondent_id,
       {date} AS survey_date,
       CASE o_custkey % 6 WHEN 0 THEN 'USA' WHEN 1 THEN ' uk ' WHEN 2 THEN 'Deutschland'
            WHEN 3 THEN 'España' WHEN 4 THEN 'Belgium' ELSE 'France' END AS country,
       CASE o_orderkey % 5 WHEN 0 THEN 'north' WHEN 1 THEN 'California' WHEN 2 THEN ' EMEA'
            WHEN 3 THEN 'Nowhere' ELSE 'Deutschland' END AS region,
       CASE o_custkey % 5 WHEN 0 THEN '18 to 24' WHEN 1 THEN '25_34' WHEN 2 THEN '35-44'
            WHEN 3 THEN '55 plus' ELSE 'unknown' END AS age,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN 'M' ELSE 'Female' END AS gender,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 5 + 1 END AS satisfaction_score,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE (o_orderkey * 7) % 11 END AS nps_score,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS spend,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Web' WHEN '2-HIGH' THEN 'store' WHEN '3-MEDIUM' THEN 'App'
            WHEN '5-LOW' THEN NULL ELSE 'Fax Line' END AS channel,
       CASE o_orderkey % 4 WHEN 0 THEN 'VU' WHEN 1 THEN 'N' WHEN 2 THEN 'VL' ELSE 'Maybe' END AS purchase_intent,
       o_orderstatus AS status
FROM {orders}
"""

CUSTOMER_SQL = CUSTOMER.format(customer="customer")
SURVEY_SQL = SURVEY.format(date="strftime(o_orderdate, '%d/%m/%Y')", orders="orders")


def customer(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(CUSTOMER, customer=table(spark, folder, "customer"))


def survey(spark: SparkSession, folder: str) -> DataFrame:
    text = SURVEY.replace("{date}", "date_format(o_orderdate, 'dd/MM/yyyy')")
    return spark.sql(text, orders=table(spark, folder, "orders"))


def with_survey(body: str) -> str:
    return f"WITH survey AS ({SURVEY_SQL}) {body}"


def with_customer(body: str) -> str:
    return f"WITH c AS ({CUSTOMER_SQL}) {body}"


def values_sql(entries: dict[str, str]) -> str:
    """Entries as rows of a VALUES list."""
    return ", ".join(f"('{k.replace(chr(39), chr(39) * 2)}', '{v}')" for k, v in entries.items())


def case_sql(expression: str, entries: dict[str, str], otherwise: str) -> str:
    whens = " ".join(f"WHEN '{k.replace(chr(39), chr(39) * 2)}' THEN '{v}'" for k, v in entries.items())
    return f"CASE {expression} {whens} ELSE {otherwise} END"
