"""Shared local session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from marketloom import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build("local[8]", 8, **{"spark.driver.memory": "8g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def one(spark):
    """Evaluate column expressions on one row of literals."""

    def evaluate(*columns, **values):
        import pyspark.sql.functions as F

        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], "id")
        result = row.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
        return tuple(result) if len(columns) > 1 else result[0]

    return evaluate
