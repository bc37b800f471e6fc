import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return corpus.documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, corpus.DDL).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], corpus.DDL)
