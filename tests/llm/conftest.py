import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts):
    return [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]


@pytest.fixture
def docs(spark):
    return lambda texts: spark.createDataFrame(rows_of(texts), DOCS)
