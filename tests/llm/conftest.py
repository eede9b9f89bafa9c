import os
import sys

import pytest

os.environ["PYTHONPATH"] = os.pathsep.join(
    p for p in (os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), os.environ.get("PYTHONPATH")) if p
)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from odd_rows import SCHEMA, rows_of_documents  # noqa: E402


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(rows_of_documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
