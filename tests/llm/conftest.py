import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cases import DOC_SCHEMA, documents


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(documents(), DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
