"""Every query of the package against its SQL in another engine, over the smallest tables."""

from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from quillon.plans.catalogue import QUERIES, SQL
from tests.compare import database, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark: SparkSession, db, name: str) -> None:
    assert name in SQL
    assert difference(QUERIES[name](spark, SF), db, SQL[name]) is None
