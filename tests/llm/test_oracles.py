"""The queries of the subpackage against their SQL."""

from __future__ import annotations

import pytest

from loomgraph.llm.queries import oracle_sql, queries

from .. import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    assert oracle.differences(queries()[name](spark, SF), oracle.connect(SF), oracle_sql()[name]) == ""
