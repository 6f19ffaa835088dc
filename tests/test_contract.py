"""Columns and types that the statement of the test tables fixes for results."""

import pytest

from shelfmark.problem_queries import QUERIES

TINY = "/root/testdata/sf0.001"
# The columns of the queries, as the statement gives them.
COLUMNS = {
    "p1_found": [("snapshot_id", "bigint"), ("path_id", "bigint"), ("change", "string")],
    "p2_found": [("pair_id", "bigint"), ("path_id", "bigint"), ("diff", "string")],
    "p4_found": [("size", "bigint"), ("partial_hash", "string")],
    "p6_found": [("src", "string"), ("node_id", "bigint"), ("defect", "string")],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_types(spark, name):
    assert QUERIES[name](spark, TINY).dtypes == COLUMNS[name]
