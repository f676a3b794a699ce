import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def answers(spark):
    """Twelve survey rows with gaps, an outlier-free score and a repeated row."""
    return spark.createDataFrame(
        [
            (1, "2024-06-01", "France", "M", 10.0, 1),
            (2, None, "uk ", "F", 20.0, None),
            (3, "2024-06-03", None, "F", None, 3),
            (4, "2024-06-04", "España", None, 40.0, 4),
            (5, "2024-06-05", "USA", "F", 50.0, 5),
            (5, "2024-06-05", "USA", "F", 50.0, 5),
            (7, "2024-06-07", "Chile", "M", 1000.0, 9),
        ],
        "respondent_id bigint, survey_date string, country string, gender string, score double, nps int",
    )
