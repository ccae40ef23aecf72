import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wardline import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="wardline-tests-")
    spark = session.build(4, spark__sql__shuffle__partitions="2", spark__checkpoint__dir=folder)
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def make(spark):
    """Build a DataFrame; times given as text become timestamps without a zone."""

    def build(schema, *rows):
        return spark.createDataFrame([tuple(map(_value, row)) for row in rows], schema)

    return build


def _value(value):
    if isinstance(value, str) and len(value) >= 19 and value[4:5] == "-" and value[10] in " T":
        return dt.datetime.fromisoformat(value)
    return value


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
