import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


#: Nulls, empty and odd texts that every operator has to take.
EDGE_TEXTS = [None, "", " ", "\n\t", "a", "é", "A b", "one two three four five six", "one two three four five six", "x" * 200_000, "0" * 30_000, "ab " * 40_000, "日本語 テキスト", "\x00", "🙂🙂 🙂"]


@pytest.fixture
def edge_docs(spark):
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "src", None, f"text{i}", 0.5) for i, t in enumerate(EDGE_TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rep string, score double")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
