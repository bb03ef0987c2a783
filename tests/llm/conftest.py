import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(__file__), os.path.dirname(os.path.dirname(__file__))]

from llm_helpers import CASES  # noqa: E402


@pytest.fixture(scope="session")
def cases(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in CASES], "doc_id long, text string, lang string, source string, n_chars long")
    for clash in ("score", "line", "fp", "node", "copies", "rank", "words", "n_tokens"):
        rows = rows.withColumn(clash, F.lit(1))
    return rows


@pytest.fixture(scope="session")
def empty(cases):
    return cases.where("false")
