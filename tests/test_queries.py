"""Every registered query against its SQL on the smallest tables; queries without SQL at least run and are told apart here."""

from __future__ import annotations

import pytest

from loomgraph.plans.oracles import ORACLES
from loomgraph.plans.queries import QUERIES

from . import oracle

SF = "/root/testdata/sf0.001"
#: Checked by other tests: iterative algorithms, the text of reports, and JSON whose spelling differs between engines.
WITHOUT_SQL = {"a20_graph_json", "a28_report", "b_build_notes", "b_built_note_nodes", "d13_questions", "e1_communities", "e5_labels", "e6_betweenness", "e7_edge_betweenness", "g4_links"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert not set(ORACLES) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert oracle.differences(QUERIES[name](spark, SF), con, ORACLES[name]) == ""
