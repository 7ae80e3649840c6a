import os

import pytest
from pyspark.sql import SparkSession

os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and very long texts, repeated rows and a clash of names (extra columns).
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one", "en", "a", 3), (4, "one two three four five six\n\n" * 9, "en", None, 9), (4, "one two three four five six\n\n" * 9, "en", None, 9), (None, "a b c d e f", "en", "b", 1), (7, "zebra " * 30000, "en", "b", 1), (8, "x\ty z Ünï", "en", "b", 1)]


@pytest.fixture(scope="session")
def odd(spark):
    clash = "size long, start long, key string, drop long, line_th long, line_drop long, copies long, mix_row long, quality_score double, quality_text string, near_th long, h long, node long, th long"
    return spark.createDataFrame([(*r, 0, 0, "k", 1, 2, 3, 4, 5, 0.5, "q", 6, 7, 8, 9) for r in ODD], DOC + ", " + clash)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)
