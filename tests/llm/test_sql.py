"""Training-data queries against their SQL on whole tables."""

from __future__ import annotations

import compare
import pytest

from lakeside.llm.oracles import ORACLES
from lakeside.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    cols, rows = compare.duck_rows(compare.connect(sf), ORACLES[name])
    assert sorted(df.columns) == cols
    assert compare.spark_rows(df) == rows
