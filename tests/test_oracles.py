"""Every registered query against its SQL oracle, on whole tables."""

import pytest

from oracles import ORACLES
from plumbline.plans.registry import QUERIES
from tests.compare import connect, oracle_result, spark_result


@pytest.fixture(scope="module")
def duck(data_dir):
    return connect(data_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, data_dir, name):
    columns, rows = spark_result(QUERIES[name](spark, data_dir))
    wanted_columns, wanted_rows = oracle_result(duck, ORACLES[name])
    assert columns == wanted_columns
    assert rows == wanted_rows
