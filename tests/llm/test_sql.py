"""The queries of the subpackage that SQL can say, against their SQL."""

import os

import pytest

pytest.importorskip("weir.llm.registry")

from compare import DATA, oracle, spark_rows  # noqa: E402

from weir.llm.registry import ORACLE, QUERIES  # noqa: E402


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, name):
    assert spark_rows(QUERIES[name](spark, DATA)) == oracle(ORACLE[name])
