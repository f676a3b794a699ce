"""Small survey tables of our own for tests: seeded by row number, any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LIKELY = ("Very Unlikely", "Unlikely", "Neutral", "Likely", "Very Likely")


def draw(name: str, seed: int, size: int) -> Column:
    """A number below ``size`` that depends on the row and the column only."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(name), F.lit(seed)), F.lit(size)).cast("int")


def pick(name: str, seed: int, options: Sequence[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), draw(name, seed, len(options)) + 1)


def day(first: str, step: Column) -> Column:
    return F.date_format(F.date_add(F.lit(first).cast("date"), step.cast("int")), "yyyy-MM-dd")


def survey(spark: SparkSession, rows: int = 500, seed: int = 3) -> DataFrame:
    """One source with gaps, extreme scores and repeated rows."""
    score = F.when(draw("gap", seed, 15) > 0, 1.0 + draw("score", seed, 9))
    base = spark.range(rows).select(
        "id", (F.col("id") + 70).alias("respondent_id"), day("2022-03-05", F.col("id") / 9).alias("survey_date"),
        pick("region", seed, ("Coast", "Hills", "Plain")).alias("region"),
        pick("country", seed, ("Portugal", "Norway", "Chile")).alias("country"),
        F.when(draw("far", seed, 60) == 0, 40.0).otherwise(score).alias("satisfaction_score"),
        draw("nps", seed, 11).alias("nps_score"), pick("intent", seed, LIKELY).alias("purchase_intent"),
        pick("age", seed, ("young", "middle", "old")).alias("age_group"), (0.8 + draw("w", seed, 400) / 1000).alias("weight"),
        F.nullif(pick("note", seed, ("fine", "slow", "")), F.lit("")).alias("comments"),
    )
    return base.withColumn("__n", F.explode(F.sequence(F.lit(1), F.when(draw("copy", seed, 30) == 0, 2).otherwise(1)))).drop("id", "__n")


def historical(spark: SparkSession, rows: int = 200, seed: int = 4) -> DataFrame:
    """An older vendor: other names, a 1-5 score, short codes."""
    return spark.range(rows).select(
        (F.col("id") + 1000).alias("resp_id"), day("2021-02-01", F.col("id")).alias("interview_date"),
        pick("market", seed, ("US", "UK", "DE", "FR")).alias("market"), pick("age", seed, ("18-24", "25-34", "55+")).alias("age_group"),
        pick("gender", seed, ("Male", "Female", "Other")).alias("gender"), (1 + draw("csat", seed, 5)).cast("bigint").alias("csat"),
        draw("nps", seed, 11).cast("bigint").alias("nps"), pick("buy", seed, ("VU", "U", "N", "L", "VL")).alias("purchase_likelihood"),
        pick("channel", seed, ("ONL", "RET", "MOB", "SOC")).alias("channel"),
    )


def canonical(spark: SparkSession, rows: int, seed: int, first: int, start: str, low: int, high: int, genders, ages, countries) -> DataFrame:
    return spark.range(rows).select(
        (F.col("id") + first).alias("respondent_id"), day(start, F.col("id")).alias("survey_date"),
        pick("country", seed, countries).alias("country"), pick("age", seed, ages).alias("age"), pick("gender", seed, genders).alias("gender"),
        (low + draw("score", seed, high - low + 1)).cast("bigint").alias("satisfaction_score"), draw("nps", seed, 11).cast("bigint").alias("nps_score"),
        pick("intent", seed, LIKELY).alias("purchase_intent"), pick("channel", seed, ("Online", "Retail", "Mobile", "Social")).alias("channel"),
    )


def current(spark: SparkSession, rows: int = 180, seed: int = 5) -> DataFrame:
    """The current vendor: canonical names, a 0-100 score."""
    return canonical(spark, rows, seed, 2000, "2023-05-01", 0, 100, ("M", "F", "Other"), ("18 to 24", "25 to 34", "55 plus"), ("USA", "UK", "Germany", "France"))


def incremental(spark: SparkSession, rows: int = 40, seed: int = 6) -> DataFrame:
    """New records: canonical names, a 1-10 score."""
    return canonical(spark, rows, seed, 3000, "2023-09-01", 1, 10, ("Male", "Female", "Other"), ("18-24", "25-34", "55+"), ("USA", "UK", "Germany"))
