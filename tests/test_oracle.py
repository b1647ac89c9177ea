"""Every core query against its SQL."""

import os

import pytest
from compare import DATA, oracle, spark_rows

from weir.plans.registry import ORACLE, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, name):
    assert spark_rows(QUERIES[name](spark, DATA)) == oracle(ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0
