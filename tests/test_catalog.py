"""Queries against their SQL; all of them are compared when the driver runs."""

import pytest
import sqlcheck

from lucidgraph import catalog

SOME = (
    "mine_paths", "pat_injective", "pat_cycle", "pat_constant_bindings_top", "fn_measures", "ded_infer", "fb_rule_nodes", "ev_partition_scores", "ev_predictions", "graph_slice_two_hops",
    "graph_encoded", "vec_scores", "src_dictionary", "snk_quads",
)


@pytest.mark.skipif(not sqlcheck.HERE, reason="the driver's tables are not here")
@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, name):
    assert sqlcheck.rows_of_query(spark, catalog.QUERIES[name]) == sqlcheck.rows_of_sql(catalog.SQL[name])


def test_names():
    assert set(catalog.SQL) <= set(catalog.QUERIES) and all(callable(q) for q in catalog.QUERIES.values())
