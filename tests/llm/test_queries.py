"""Every text query runs over the smallest tables."""

from __future__ import annotations

import pytest

from tidemark.llm import queries

COLUMNS = {"p5_found": ["source_table", "record_id", "club_id"], "p6_found": ["match_id", "market_id"], "p9_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(queries.R.queries))
def test_query_runs(spark, data, name):
    df = queries.R.queries[name](spark, data)
    assert len(df.columns) == len(set(df.columns))
    assert df.columns == COLUMNS.get(name, df.columns)
    assert df.count() >= 0
