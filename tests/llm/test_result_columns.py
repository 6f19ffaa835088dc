"""Columns and types that the statement of the test tables fixes for results."""

import pytest

from shelfmark.llm.queries import QUERIES

TINY = "/root/testdata/sf0.001"
# The columns of the queries, as the statement gives them.
COLUMNS = {
    "p3_found": [("full_hash", "string"), ("keep_id", "bigint")],
    "p5_found": [("path_id_a", "bigint"), ("path_id_b", "bigint")],
    "p7_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p9_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_types(spark, name):
    assert QUERIES[name](spark, TINY).dtypes == COLUMNS[name]
