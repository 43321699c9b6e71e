import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lotwise.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return get_spark("tests", "4", **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture
def one(spark):
    """Value of a column expression."""

    def value(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return value
