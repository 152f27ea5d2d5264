import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "2g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows and ids, and extra columns with clashing names."""
    long_text = "word " * 20_000 + "x" * 70_000 + "\n" + "tail ünd  mehr\t" * 500
    rows = [
        (1, "Alpha beta gamma delta epsilon.", "a"), (1, "Alpha beta gamma delta epsilon.", "a"), (2, None, None), (3, "", "b"), (None, "no id here", "c"),
        (4, "   \n\t ", "d"), (5, long_text, "e"), (6, "é 中文 \U0001f600 \x1c x", None), (7, "Released under the MIT License.", "f"),
    ]
    return spark.createDataFrame([(i, t, x, x, 1, 2) for i, t, x in rows], "doc_id long, text string, fp string, key string, row_id int, score int")
